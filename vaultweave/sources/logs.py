"""Append-only logs as JSON lines, and view exports as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultweave.functions.keys import blank_trim
from vaultweave.session import exists


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines log; malformed and blank lines are passed over, or raise when read if ``strict``.

    A ``seq`` the writer gave is kept.  Where lines have none, their order in
    one file is not kept by a distributed read: write ``seq`` with the lines.
    """
    fields = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    wide = fields if strict else T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": mode} | ({} if strict else {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select(F.from_json("value", wide, options).alias("r")).select("r.*")
    return parsed if strict else parsed.where("_bad is null").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log; the only way a log is written."""
    rows.write.mode("append").json(path)


def read_exports(spark: SparkSession, folder: str, views: Sequence[str]) -> dict[str, DataFrame]:
    """The CSV exports of the views that are there, by name."""
    return {v: spark.read.csv(f"{folder}/{v}.csv", header=True, multiLine=True, escape='"') for v in views if exists(spark, f"{folder}/{v}.csv")}


def yes_no(column):
    """A yes/no cell as a boolean; null and other texts count as no."""
    return F.coalesce(F.lower(blank_trim(column)) == "yes", F.lit(False))
