"""Append-only event ledgers: composed filters, cursors, folds and summaries.

The order of a ledger is its ``seq``; timestamps only inform.  All operators
are plain plans over (seq, artifact_id, event_type, ts, actor, payload ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_events(
    events: DataFrame,
    artifact: str | int | None = None,
    kinds: Sequence[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    actor: str | int | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Events that satisfy every filter given; times are inclusive on both sides."""
    tests = [
        None if artifact is None else F.col("artifact_id") == artifact,
        None if kinds is None else F.col("event_type").isin(list(kinds)),
        None if since is None else F.col("ts") >= F.lit(since).cast("timestamp_ntz"),
        None if until is None else F.col("ts") <= F.lit(until).cast("timestamp_ntz"),
        None if actor is None else F.col("actor") == actor,
        where,
    ]
    out = events
    for t in tests:
        out = out if t is None else out.where(t)
    return out


def after_artifact(events: DataFrame, artifact: str | int) -> DataFrame:
    """Events after the first one of ``artifact`` among those given, that one left out; none if it has no event."""
    first = events.where(F.col("artifact_id") == artifact).agg(F.min("seq").alias("_at"))
    return events.join(F.broadcast(first)).where(F.col("seq") > F.col("_at")).drop("_at")


def after_seq(events: DataFrame, seq: int) -> DataFrame:
    """Events after a place in the ledger."""
    return events.where(F.col("seq") > seq)


def having(events: DataFrame, column: str, value: str) -> DataFrame:
    """Events whose array ``column`` holds ``value``."""
    return events.where(F.array_contains(column, value))


def affecting(changes: DataFrame, invariant: str) -> DataFrame:
    """Changes with an impact on an invariant; ``invariant_impacts`` is an array of (invariant, direction, detail)."""
    return changes.where(F.exists("invariant_impacts", lambda i: i["invariant"] == invariant))


def shown(changes: DataFrame, note: str | None = None, kind: str | None = None, last: int = 20) -> DataFrame:
    """The last ``last`` changes in ledger order, of notes whose id contains ``note`` and of one type, if given."""
    out = changes if note is None else changes.where(F.lower("note_id").contains(note.lower()))
    out = out if kind is None else out.where(F.array_contains("change_types", kind))
    return limited(out, last, latest=True)


def latest_first(found: DataFrame) -> DataFrame:
    """Snapshots in the order of a listing: by creation, then id."""
    return found.orderBy("created_at", "artifact_id")


def limited(events: DataFrame, limit: int, descending: bool = False, latest: bool = False) -> DataFrame:
    """The first ``limit`` events in ledger order, turned round afterwards if ``descending``; ``latest`` takes the last ones instead."""
    cut = events.orderBy(F.desc("seq") if latest else "seq").limit(limit)
    return cut.orderBy(F.desc("seq") if descending else "seq")


def by_field(payload: Column, name: str, kind: str = "string") -> Column:
    """A field of a JSON payload, null if absent or of another kind."""
    value = F.get_json_object(payload, f"$.{name}")
    return value if kind == "string" else value.try_cast(kind)


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("seq")))


def snapshots(events: DataFrame, strict: bool = False) -> DataFrame:
    """Current state of each artifact: the last writer of each field wins, in ledger order.

    Needs seq, artifact_id, event_type (created, validated, approved, executed,
    rejected, superseded), ts and errors (a validation's number of errors, which
    turns it into a rejection).  An artifact whose first event is no creation is
    left out; ``strict`` raises instead (it looks first).
    """
    lifecycle = events.where(F.col("event_type").isin("created", "validated", "approved", "executed", "rejected", "superseded"))
    kind = F.col("event_type")
    failed = (kind == "validated") & (F.coalesce("errors", F.lit(0)) > 0)
    at = lambda k: _last(F.col("ts"), kind == k)
    folded = lifecycle.groupBy("artifact_id").agg(
        F.min_by("event_type", "seq").alias("_first"),
        F.max_by(F.when(failed, F.lit("rejected")).otherwise(kind), "seq").alias("status"),
        F.min("ts").alias("created_at"), at("validated").alias("validated_at"), at("approved").alias("approved_at"), at("executed").alias("executed_at"),
        F.max_by(F.when(failed, F.lit("validation")).when(kind == "rejected", F.lit("rejection")), F.when(failed | (kind == "rejected"), F.col("seq"))).alias("rejection_stage"),
        F.count(F.lit(1)).alias("n_events"),
    )
    if strict and not folded.where("_first <> 'created'").isEmpty():
        raise ValueError("an artifact's first event is no creation")
    return folded.where("_first = 'created'").drop("_first")


def execution_summaries(logs: DataFrame) -> DataFrame:
    """One row per execution of (seq, execution_id, artifact_id, phase, status, attempt, duration_ms, error, ts).

    The last completed duration of a phase counts; any failure fails the whole;
    the first failure gives error and phase; attempts are the highest number plus one.
    """
    phase = logs.where("status = 'completed' and duration_ms is not null").groupBy("execution_id", "phase").agg(F.max_by("duration_ms", "seq").alias("d"))
    times = phase.groupBy("execution_id").agg(F.sum("d").alias("total_duration_ms"), F.count(F.lit(1)).alias("n_phases"))
    failed = F.col("status") == "failed"
    whole = logs.groupBy("execution_id").agg(
        F.min_by("artifact_id", "seq").alias("artifact_id"),
        F.when(F.bool_or(failed), F.lit("failure")).otherwise(F.lit("success")).alias("overall_status"),
        (F.max("attempt") + 1).alias("attempts"),
        F.min_by("error", F.when(failed, F.col("seq"))).alias("first_error"), F.min_by("phase", F.when(failed, F.col("seq"))).alias("failure_phase"),
        F.count_if(F.col("status") == "completed").alias("n_completed"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )
    return whole.join(times, "execution_id", "left").na.fill(0, ["total_duration_ms", "n_phases"])


def merged_resources(logs: DataFrame) -> DataFrame:
    """(execution_id, name, total, first_text): resources of all logs, numbers summed, else the first text; ``resources`` is a map of strings."""
    each = logs.select("execution_id", "seq", F.explode("resources").alias("name", "value")).withColumn("number", F.col("value").try_cast("double"))
    return each.groupBy("execution_id", "name").agg(F.sum("number").alias("total"), F.min_by("value", F.when(F.col("number").isNull(), F.col("seq"))).alias("first_text"))


def constraint_summaries(evaluations: DataFrame, checks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per artifact: whether its constraint data is present, partial or missing, and its results.

    ``evaluations`` have (seq, artifact_id, ruleset_id, result, ts), ``checks``
    (artifact_id, invariant_id, status), ``artifacts`` (artifact_id) the ones asked for.
    """
    ev = evaluations.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("rules_checked"), F.count_if(F.col("result") == "pass").alias("passed"), F.count_if(F.col("result") == "fail").alias("failed"),
        F.count_if(F.col("result") == "warning").alias("warnings"), F.count_distinct("ruleset_id").alias("rulesets"), F.min_by("ts", "seq").alias("evaluated_at"),
    )
    ch = checks.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("checks"), F.count_distinct(F.when(F.col("status") == "fail", F.col("invariant_id"))).alias("violated_invariants"))
    joined = artifacts.select("artifact_id").distinct().join(ev, "artifact_id", "left").join(ch, "artifact_id", "left")
    has_e, has_c = F.col("rules_checked").isNotNull(), F.col("checks").isNotNull()
    status = F.when(has_e & has_c, "present").when(has_e | has_c, "partial").otherwise("missing")
    return joined.withColumn("data_status", status).na.fill(0, ["rules_checked", "passed", "failed", "warnings", "rulesets", "checks", "violated_invariants"])


def invariant_summaries(checks: DataFrame) -> DataFrame:
    """(artifact_id, checked, violated, overall): distinct invariants checked and violated at any time."""
    bad = F.col("status") == "fail"
    return checks.groupBy("artifact_id").agg(
        F.count_distinct("invariant_id").alias("checked"), F.count_distinct(F.when(bad, F.col("invariant_id"))).alias("violated"),
        F.when(F.bool_or(bad), F.lit("fail")).otherwise(F.lit("pass")).alias("overall"),
    )


def affected_items(checks: DataFrame) -> DataFrame:
    """(artifact_id, invariant_id, status, items): of each invariant the last check's status and affected items; ``checks`` have seq and affected_items."""
    return checks.groupBy("artifact_id", "invariant_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("affected_items", "seq").alias("items"))


def validation_summary(events: DataFrame) -> DataFrame:
    """(rules_checked, passed, failed, warnings, invariants, violated, violations) of constraint events (kind, rule_id, invariant, result)."""
    is_rule, is_check = F.col("kind") == "constraint.evaluated", F.col("kind") == "invariant.checked"
    of = lambda r: F.count_if(is_rule & (F.col("result") == r))
    return events.agg(
        F.count_distinct(F.when(is_rule, F.col("rule_id"))).alias("rules_checked"), of("pass").alias("passed"), of("fail").alias("failed"), of("warning").alias("warnings"),
        F.count_distinct(F.when(is_check, F.col("invariant"))).alias("invariants"), F.count_distinct(F.when(is_check & (F.col("result") == "fail"), F.col("invariant"))).alias("violated"),
        F.coalesce(F.sum(F.when(is_check, F.col("violations"))), F.lit(0)).alias("violations"),
    )


def effective(events: DataFrame, content: str, key: str = "artifact_id", order: str = "seq") -> DataFrame:
    """Events that change the content of their key; the first of each counts."""
    was = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != F.col(content))).drop("_was")


def latest_per(events: DataFrame, key: str = "artifact_id", order: str = "seq") -> DataFrame:
    """The last event of each key, as an incremental rebuild needs it."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def latest_execution(logs: DataFrame) -> DataFrame:
    """(artifact_id, execution_id) of the last log of each artifact."""
    return logs.groupBy("artifact_id").agg(F.max_by("execution_id", "seq").alias("execution_id"))


def audit_trail(events: DataFrame, artifact: str | int) -> DataFrame:
    """All events of an artifact with their place in its history, and the type of the one before and the seconds since."""
    order = Window.partitionBy("artifact_id").orderBy("seq")
    own = events.where(F.col("artifact_id") == artifact)
    since = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(order)
    return own.withColumn("step", F.row_number().over(order)).withColumn("previous", F.lag("event_type").over(order)).withColumn("seconds", F.round(since, 6))
