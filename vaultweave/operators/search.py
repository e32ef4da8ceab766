"""Prefix search over the fields of notes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.functions.signals import search_tokens


def token_hits(notes: DataFrame, field: str, prefix: str, key: str) -> DataFrame:
    """Keys of the notes in whose ``field`` a token begins with ``prefix`` (lower case)."""
    low = prefix.lower()
    # A text without the prefix anywhere is passed over before it is cut into tokens.
    near = notes.where(F.lower(field).contains(low))
    return near.where(F.exists(search_tokens(F.col(field)), lambda t: t.startswith(low))).select(key)


def prefix_search(notes: DataFrame, prefix: str, fields: Sequence[str], key: str, limit: int = 8) -> DataFrame:
    """(key, field, rank): up to ``limit`` notes of each field by key, fields in order, each note once."""
    hits = [token_hits(notes, f, prefix, key).orderBy(key).limit(limit).withColumn("field", F.lit(i)) for i, f in enumerate(fields)]
    best = reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.min("field").alias("field"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("field", key)))


def tag_search(tags: DataFrame, prefix: str, key: str, limit: int = 8) -> DataFrame:
    """(key, rank): up to ``limit`` notes with a tag that begins with ``prefix``."""
    hits = tags.where(F.lower("tag").startswith(prefix.lower())).select(key).distinct().orderBy(key).limit(limit)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(key)))


def tag_text_search(notes: DataFrame, tags: DataFrame, tag: str, prefix: str, fields: Sequence[str], key: str, limit: int = 8) -> DataFrame:
    """(key, rank): notes with a tag ``tag`` among all that match ``prefix`` in any field."""
    tagged = tags.where(F.lower("tag") == tag.lower()).select(key).distinct()
    hits = reduce(DataFrame.unionByName, [token_hits(notes, f, prefix, key).withColumn("field", F.lit(i)) for i, f in enumerate(fields)])
    best = hits.join(tagged, key, "left_semi").groupBy(key).agg(F.min("field").alias("field")).orderBy("field", key).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("field", key))).select(key, "rank")
