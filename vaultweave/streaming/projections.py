"""Ledger projections kept up to date by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "seq long, artifact_id string, event_type string, ts timestamp, actor string, errors int"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of JSON lines as a stream of events."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def current_status(events: DataFrame) -> DataFrame:
    """(artifact_id, status, seq) in update mode: the last lifecycle event by ``seq``, however late it comes."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, seq = state.get if state.exists else (None, -1)
        for pdf in batches:
            top = pdf.loc[pdf.seq.idxmax()]
            if top.seq > seq:
                failed = top.event_type == "validated" and (top.errors or 0) > 0
                status, seq = "rejected" if failed else top.event_type, int(top.seq)
        state.update((status, seq))
        yield pd.DataFrame({"artifact_id": [key[0]], "status": [status], "seq": [seq]})

    lifecycle = events.where(F.col("event_type").isin("created", "validated", "approved", "executed", "rejected", "superseded"))
    return lifecycle.groupBy("artifact_id").applyInPandasWithState(step, "artifact_id string, status string, seq long", "status string, seq long", "update", "NoTimeout")


def keep_latest(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's latest row per key below ``path``/batch=N; :func:`latest` reads them together."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The latest row per key over all micro-batches."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
