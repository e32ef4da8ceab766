"""Events as rows: their construction, those a rule engine emits, the logs of files and operations."""

from __future__ import annotations

import secrets
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.operators.ordering import numbered
from vaultweave.operators.rules import Rule

# The types of events a ledger takes.
EVENT_TYPES = (
    "artifact.created", "artifact.validated", "artifact.approved", "artifact.executed", "artifact.rejected", "artifact.superseded",
    "constraint.evaluated", "invariant.checked", "execution.logged",
)
LEDGER = "seq long, event_type string, artifact_id string, ts timestamp, actor string, payload string"
_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(moment_ms: int | None = None, noise: int | None = None) -> str:
    """A sortable id: 48 bits of time in milliseconds, then 80 random ones, in base 32."""
    ms = int(time.time() * 1000) if moment_ms is None else moment_ms
    value = (ms << 80) | (secrets.randbits(80) if noise is None else noise)
    return "".join(_BASE32[(value >> shift) & 31] for shift in range(125, -1, -5))


def ulids(ts: Column, seed: Column) -> Column:
    """The same as a column: the time of each row and 80 bits hashed out of ``seed``."""
    digit = lambda n: F.substr(F.lit(_BASE32), (n + 1).cast("int"), F.lit(1))
    ms = (ts.cast("timestamp").cast("double") * 1000).cast("long")
    when = F.concat(*[digit(F.shiftright(ms, s).bitwiseAND(31)) for s in range(45, -1, -5)])
    a, b = F.xxhash64(seed), F.xxhash64(seed, F.lit(1))
    noise = [digit(F.shiftrightunsigned(x, s).bitwiseAND(31)) for x in (a, b) for s in range(35, -1, -5)]
    return F.concat(when, *noise)


def created(spark: SparkSession, event_type: str, artifact_id: str, actor: str, payload: Mapping, seq: int | None = None) -> DataFrame:
    """One event of now; raises for a type no ledger takes."""
    import json

    if event_type not in EVENT_TYPES:
        raise ValueError(f"{event_type!r} is no type of event")
    row = spark.createDataFrame([(seq, event_type, artifact_id, actor, json.dumps(payload, sort_keys=True))], "seq long, event_type string, artifact_id string, actor string, payload string")
    return row.withColumn("ts", F.current_timestamp()).select("seq", "event_type", "artifact_id", "ts", "actor", "payload")


def evaluated(results: DataFrame, rules: Sequence[Rule], items: DataFrame, ruleset: str, version: int) -> DataFrame:
    """(kind, ruleset_id, ruleset_version, rule_id, scope, invariant, item, result, message, line): one row per rule and item looked at.

    ``results`` are those of :func:`vaultweave.operators.rules.run` and ``items``
    (item) all that was looked at; an item a rule has nothing to say of passes.
    Levels ``error`` fail, ``warning`` and ``info`` warn.
    """
    spark = results.sparkSession
    listed = spark.createDataFrame([(r.id, r.scope, r.invariant) for r in rules], "rule_id string, scope string, invariant string")
    found = results.select(F.col("rule").alias("rule_id"), F.col("file").alias("item"), F.when(F.col("level") == "error", "fail").otherwise("warning").alias("result"), "message", "line")
    # The rules are a handful and part of the plan: each item stands beside each of them once.
    every = items.select(F.col("item").cast("string").alias("item")).distinct().withColumn("rule_id", F.explode(F.array(*[F.lit(r.id) for r in rules])))
    said = every.join(found, ["rule_id", "item"], "left").withColumn("result", F.coalesce("result", F.lit("pass")))
    out = said.join(F.broadcast(listed), "rule_id")
    return out.select(F.lit("constraint.evaluated").alias("kind"), F.lit(ruleset).alias("ruleset_id"), F.lit(version).alias("ruleset_version"), "rule_id", "scope", "invariant", "item", "result", "message", "line")


def checked(events: DataFrame) -> DataFrame:
    """(kind, invariant, status, rules_checked, violations, affected): one row per invariant of :func:`evaluated`, those without violation included."""
    bad = F.col("result") == "fail"
    return events.groupBy(F.coalesce("invariant", F.lit("structural")).alias("invariant")).agg(
        F.when(F.bool_or(bad), F.lit("fail")).otherwise(F.lit("pass")).alias("status"), F.count_distinct("rule_id").alias("rules_checked"), F.count_if(bad).alias("violations"), F.count_distinct(F.when(bad, F.col("item"))).alias("affected")
    ).select(F.lit("invariant.checked").alias("kind"), "invariant", "status", "rules_checked", "violations", "affected")


def sequenced(rows: DataFrame, first: int, *order: str) -> DataFrame:
    """``rows`` with ``seq`` from ``first`` in the order given, ready to be appended to a ledger together."""
    return numbered(rows, *order, number="_n").withColumn("seq", F.col("_n") + (first - 1)).drop("_n")


def logged(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Appends entries of a file or operation log as JSON lines, each with the time it is written unless it has one."""
    from vaultweave.sources.logs import append_log

    out = rows if "timestamp" in rows.columns else rows.withColumn("timestamp", F.current_timestamp())
    append_log(out.select("timestamp", *fields), path)


def operation(spark: SparkSession, name: str, erased: Mapping[str, int] | None = None, made: Mapping[str, int] | None = None) -> DataFrame:
    """One entry of the operation log: what an operation erased and created, by kind."""
    kinds = "map<string,bigint>"
    return spark.createDataFrame([(name, dict(erased or {}), dict(made or {}))], f"operation string, erased {kinds}, created {kinds}").withColumn("timestamp", F.current_timestamp())
