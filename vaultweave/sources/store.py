"""Sinks: a content-addressed store, graph tables, CSV bundles and generated blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultweave.session import exists


def store_content(spark: SparkSession, blobs: DataFrame, path: str) -> DataFrame:
    """Adds the texts of ``blobs`` (body) the store at ``path`` does not hold; returns (content_id) of all given.

    A text is stored once however often it is given; null texts are passed over.
    """
    named = blobs.where("body is not null").select(F.sha2("body", 256).alias("content_id"), "body").dropDuplicates(["content_id"])
    fresh = named
    if exists(spark, path):
        fresh = named.join(spark.read.parquet(path).select("content_id"), "content_id", "left_anti")
    fresh.withColumn("shard", F.substr("content_id", F.lit(1), F.lit(2))).write.mode("append").partitionBy("shard").parquet(path)
    return named.select("content_id")


def read_content(spark: SparkSession, path: str, content_id: str | None = None) -> DataFrame:
    """(content_id, body) of the store, or of one address: its shard alone is read."""
    rows = spark.read.schema("content_id string, body string, shard string").parquet(path)
    if content_id is not None:
        rows = rows.where((F.col("shard") == content_id[:2]) & (F.col("content_id") == content_id))
    return rows.select("content_id", "body")


def verify_content(rows: DataFrame) -> DataFrame:
    """Addresses whose body has another hash."""
    return rows.where(F.sha2("body", 256) != F.col("content_id")).select("content_id")


def write_graph(notes: DataFrame, links: DataFrame, depends: DataFrame, path: str, rebuild: bool = True) -> None:
    """Writes the graph's tables; ``rebuild`` replaces the notes, otherwise they are merged by ``note_id`` and only the edges replaced."""
    if not rebuild and exists(notes.sparkSession, f"{path}/notes"):
        old = notes.sparkSession.read.parquet(f"{path}/notes").withColumn("_new", F.lit(0))
        both = old.unionByName(notes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        last = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("_new")))
        merged = both.withColumn("_k", last).where("_k = 1").drop("_k", "_new")
        merged.write.mode("overwrite").parquet(f"{path}/notes.next")
        notes = notes.sparkSession.read.parquet(f"{path}/notes.next")
    notes.write.mode("overwrite").parquet(f"{path}/notes")
    links.write.mode("overwrite").parquet(f"{path}/links")
    depends.write.mode("overwrite").parquet(f"{path}/depends")


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of CSV files with header."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").csv(f"{path}/{name}", header=True, quoteAll=True)


def replace_block(text: Column, block: Column, start: str, end: str) -> Column:
    """``text`` with what stands between the markers replaced, or the marked block added at its end."""
    has = text.contains(start) & text.contains(end)
    head, tail = F.substring_index(text, start, 1), F.substring_index(text, end, -1)
    marked = F.concat(F.lit(f"{start}\n"), block, F.lit(f"\n{end}"))
    return F.when(has, F.concat(head, marked, tail)).otherwise(F.concat(F.rtrim(text), F.lit("\n\n"), marked, F.lit("\n")))


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): size and order-free content hash of each table."""
    out = []
    for name, f in sorted(frames.items()):
        row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(f.columns)])
        out.append(f.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest"))
    return reduce(DataFrame.unionByName, out)
