"""Orders over whole tables without bringing them into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultweave.session import written


def numbered(df: DataFrame, *order: str | Column, number: str = "number") -> DataFrame:
    """``df`` with ``number`` from 1 in the order given; equal rows in any order.

    Ranges of the order are sorted side by side and numbered from where the
    range before ends; one row per range comes to the driver.
    """
    spread = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r[0], before))
        before += r[1]
    known = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    at = F.col("_start") + F.col("_at") - F.shiftleft("_part", 33) + 1
    return spread.withColumn("_part", part).join(F.broadcast(known), "_part").select(*df.columns, at.alias(number))


def listed_first(name: str | Column, listed: Sequence[str]) -> list[Column]:
    """Sort keys: names of a list by their place in it, all others after them by name."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    place = F.array_position(F.array(*[F.lit(x.strip().lower()) for x in listed]).cast("array<string>"), c)
    return [F.when(place > 0, place).asc_nulls_last(), c.asc()]


def clamped(df: DataFrame, limit: int, most: int = 500) -> DataFrame:
    """The first rows of ``df``: as many as asked for, between 1 and ``most``."""
    return df.limit(max(1, min(limit, most)))
