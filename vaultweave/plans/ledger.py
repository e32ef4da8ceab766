"""Ledger and change queries over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.operators import changes, ledger
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Events as a ledger: signup creates, view validates (with errors where the value is high), click approves, purchase executes, error rejects.
_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'validated' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'executed' ELSE 'rejected' END"
_LEDGER = f"""led AS (SELECT event_id AS seq, user_id AS artifact_id, {_KIND} AS event_type, ts, user_id % 7 AS actor, value, CAST(value > 100 AS INTEGER) AS errors,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  logs AS (SELECT event_id AS seq, user_id || '-' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS execution_id, user_id AS artifact_id,
    CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 WHEN 0 THEN 'prepare' WHEN 1 THEN 'execute' ELSE 'commit' END AS phase,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'started' WHEN 'click' THEN 'skipped' ELSE 'completed' END AS status,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS attempt, value AS duration_ms, CASE WHEN event_type = 'error' THEN 'E' || event_id END AS error, ts FROM events)"""


def query(oracle: str | None = None, base: str = _LEDGER):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {base}{' ' if oracle.lstrip().startswith('SELECT') else ', '}{oracle}"
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"signup": "created", "view": "validated", "click": "approved", "purchase": "executed"}
    kind = F.lit("rejected")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("artifact_id"), kind.alias("event_type"), "ts", (F.col("user_id") % 7).alias("actor"), "value",
        (F.col("value") > 100).cast("int").alias("errors"), ledger.by_field(F.col("props"), "k", "int").alias("k"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    k = ledger.by_field(F.col("props"), "k", "int")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "skipped").otherwise("completed")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), (k % 5).cast("string")).alias("execution_id"), F.col("user_id").alias("artifact_id"),
        F.when(k % 3 == 0, "prepare").when(k % 3 == 1, "execute").otherwise("commit").alias("phase"), status.alias("status"), (k % 4).alias("attempt"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), F.col("event_id"))).alias("error"), "ts",
    )


@query("SELECT seq, artifact_id, event_type, value FROM led WHERE event_type IN ('created', 'rejected') AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND actor = 3 AND value > 20")
def ledger_query(spark, sf):
    """Composed filters: types, time range, actor and a condition of one's own."""
    found = ledger.select_events(events(spark, sf), kinds=["created", "rejected"], since="2024-01-03", until="2024-01-20 12:00:00", actor=3, where=F.col("value") > 20)
    return found.select("seq", "artifact_id", "event_type", "value")


@query("c AS (SELECT * FROM led WHERE event_type = 'created') SELECT seq, artifact_id FROM c WHERE seq > (SELECT min(seq) FROM c WHERE artifact_id = 5) ORDER BY seq LIMIT 25")
def ledger_cursor(spark, sf):
    """A page of creations after the cursor artifact."""
    page = ledger.after_artifact(ledger.select_events(events(spark, sf), kinds=["created"]), 5)
    return ledger.limited(page, 25).select("seq", "artifact_id")


@query("SELECT seq, artifact_id, event_type FROM (SELECT * FROM led WHERE actor = 2 ORDER BY seq LIMIT 40)")
def ledger_first_descending(spark, sf):
    """The oldest forty events of an actor, newest first."""
    return ledger.limited(ledger.select_events(events(spark, sf), actor=2), 40, descending=True).select("seq", "artifact_id", "event_type")


@query("SELECT seq, artifact_id, event_type FROM led ORDER BY seq DESC LIMIT 30")
def ledger_tail(spark, sf):
    """The last thirty events."""
    return ledger.limited(events(spark, sf), 30, latest=True).select("seq", "artifact_id", "event_type")


@query(
    """f AS (SELECT artifact_id, arg_min(event_type, seq) AS first, arg_max(CASE WHEN event_type = 'validated' AND errors > 0 THEN 'rejected' ELSE event_type END, seq) AS status, min(ts) AS created_at,
      max(CASE WHEN event_type = 'validated' THEN ts END) AS validated_at, max(CASE WHEN event_type = 'approved' THEN ts END) AS approved_at, max(CASE WHEN event_type = 'executed' THEN ts END) AS executed_at,
      arg_max(CASE WHEN event_type = 'validated' THEN 'validation' ELSE 'rejection' END, seq) FILTER (WHERE event_type = 'rejected' OR (event_type = 'validated' AND errors > 0)) AS rejection_stage, count(*) AS n_events FROM led GROUP BY 1)
    SELECT * EXCLUDE (first) FROM f WHERE first = 'created'"""
)
def ledger_snapshots(spark, sf):
    """Current state of each artifact."""
    return ledger.snapshots(events(spark, sf))


@query(
    """f AS (SELECT artifact_id, arg_min(event_type, seq) AS first, arg_max(CASE WHEN event_type = 'validated' AND errors > 0 THEN 'rejected' ELSE event_type END, seq) AS status FROM led GROUP BY 1)
    SELECT status, count(*) AS n FROM f WHERE first = 'created' GROUP BY 1"""
)
def ledger_by_status(spark, sf):
    """Artifacts by state."""
    return ledger.snapshots(events(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """p AS (SELECT execution_id, phase, arg_max(duration_ms, seq) AS d FROM logs WHERE status = 'completed' AND duration_ms IS NOT NULL GROUP BY 1, 2), t AS (SELECT execution_id, sum(d) AS total, count(*) AS n FROM p GROUP BY 1),
      w AS (SELECT execution_id, arg_min(artifact_id, seq) AS artifact_id, CASE WHEN bool_or(status = 'failed') THEN 'failure' ELSE 'success' END AS overall_status, CAST(max(attempt) + 1 AS INTEGER) AS attempts,
        arg_min(error, seq) FILTER (WHERE status = 'failed') AS first_error, arg_min(phase, seq) FILTER (WHERE status = 'failed') AS failure_phase, count(*) FILTER (WHERE status = 'completed') AS n_completed, min(ts) AS started_at, max(ts) AS ended_at FROM logs GROUP BY 1)
    SELECT w.*, round(coalesce(total, 0), 4) AS total_duration_ms, coalesce(n, 0) AS n_phases FROM w LEFT JOIN t USING (execution_id)"""
)
def execution_summaries(spark, sf):
    """Summary of each execution."""
    return ledger.execution_summaries(logs(spark, sf)).withColumn("total_duration_ms", F.round("total_duration_ms", 4))


@query("SELECT artifact_id, arg_max(execution_id, seq) AS execution_id FROM logs GROUP BY 1")
def latest_executions(spark, sf):
    """The latest execution of each artifact."""
    return ledger.latest_execution(logs(spark, sf))


_EVAL = """ev AS (SELECT seq, artifact_id, 'rs-' || k % 3 AS ruleset_id, CASE WHEN value < 10 THEN 'fail' WHEN value < 20 THEN 'warning' ELSE 'pass' END AS result, ts FROM led WHERE event_type = 'validated'),
  ch AS (SELECT artifact_id, 'inv-' || k % 5 AS invariant_id, CASE WHEN value < 5 THEN 'fail' ELSE 'pass' END AS status FROM led WHERE event_type = 'approved')"""


def _checks(spark, sf):
    e = events(spark, sf)
    result = F.when(F.col("value") < 10, "fail").when(F.col("value") < 20, "warning").otherwise("pass")
    ev = e.where("event_type = 'validated'").select("seq", "artifact_id", F.concat(F.lit("rs-"), F.col("k") % 3).alias("ruleset_id"), result.alias("result"), "ts")
    ch = e.where("event_type = 'approved'").select("artifact_id", F.concat(F.lit("inv-"), F.col("k") % 5).alias("invariant_id"), F.when(F.col("value") < 5, "fail").otherwise("pass").alias("status"))
    return e, ev, ch


@query(
    f"""{_EVAL}, a AS (SELECT DISTINCT artifact_id FROM led),
      e AS (SELECT artifact_id, count(*) AS rules_checked, count(*) FILTER (WHERE result = 'pass') AS passed, count(*) FILTER (WHERE result = 'fail') AS failed, count(*) FILTER (WHERE result = 'warning') AS warnings, count(DISTINCT ruleset_id) AS rulesets, arg_min(ts, seq) AS evaluated_at FROM ev GROUP BY 1),
      c AS (SELECT artifact_id, count(*) AS checks, count(DISTINCT CASE WHEN status = 'fail' THEN invariant_id END) AS violated_invariants FROM ch GROUP BY 1)
    SELECT artifact_id, coalesce(rules_checked, 0) AS rules_checked, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(warnings, 0) AS warnings, coalesce(rulesets, 0) AS rulesets, evaluated_at, coalesce(checks, 0) AS checks,
      coalesce(violated_invariants, 0) AS violated_invariants, CASE WHEN rules_checked IS NOT NULL AND checks IS NOT NULL THEN 'present' WHEN rules_checked IS NOT NULL OR checks IS NOT NULL THEN 'partial' ELSE 'missing' END AS data_status
    FROM a LEFT JOIN e USING (artifact_id) LEFT JOIN c USING (artifact_id)"""
)
def constraint_summaries(spark, sf):
    """Constraint data of each artifact."""
    e, ev, ch = _checks(spark, sf)
    return ledger.constraint_summaries(ev, ch, e)


@query(f"{_EVAL} SELECT artifact_id, count(DISTINCT invariant_id) AS checked, count(DISTINCT CASE WHEN status = 'fail' THEN invariant_id END) AS violated, CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'pass' END AS overall FROM ch GROUP BY 1".replace("WITH", ""))
def invariant_summaries(spark, sf):
    """Invariants of each artifact."""
    return ledger.invariant_summaries(_checks(spark, sf)[2])


@query("SELECT seq, event_type, CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS step, lag(event_type) OVER (ORDER BY seq) AS previous, round(epoch(ts - lag(ts) OVER (ORDER BY seq)), 6) AS seconds FROM led WHERE artifact_id = 3")
def audit_trail(spark, sf):
    """The history of artifact 3."""
    return ledger.audit_trail(events(spark, sf), 3).select("seq", "event_type", "step", "previous", "seconds")


@query("SELECT event_type, actor, count(*) AS n, count(DISTINCT artifact_id) AS artifacts, min(ts) AS first_at, max(ts) AS last_at, round(sum(value), 4) AS total FROM led GROUP BY 1, 2")
def event_counts(spark, sf):
    """Events by type and actor."""
    return events(spark, sf).groupBy("event_type", "actor").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("artifact_id").alias("artifacts"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    """s AS (SELECT *, lag(ts) OVER (PARTITION BY artifact_id ORDER BY ts) AS before FROM led), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY ts) AS run FROM s)
    SELECT artifact_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, arg_max(event_type, ts) AS last_type FROM g GROUP BY artifact_id, run"""
)
def debounced_bursts(spark, sf):
    """Bursts of events of an artifact, closed by thirty quiet minutes, with the last event of each."""
    from vaultweave.streaming.files import debounce

    return debounce(events(spark, sf), "artifact_id", "ts", "30 minutes", "event_type")


@query("s AS (SELECT *, lag(k) OVER (PARTITION BY artifact_id ORDER BY seq) AS was FROM led) SELECT seq, artifact_id, k FROM s WHERE was IS NULL OR was <> k")
def effective_changes(spark, sf):
    """Events that change their artifact's content, repeats left out."""
    return ledger.effective(events(spark, sf), "k").select("seq", "artifact_id", "k")


@query("SELECT d.seq AS deleted, c.seq AS created, d.k FROM led d JOIN led c ON c.k = d.k AND c.artifact_id <> d.artifact_id AND c.ts BETWEEN d.ts AND d.ts + INTERVAL 10 MINUTE WHERE d.event_type = 'rejected' AND c.event_type = 'created'")
def rename_pairs(spark, sf):
    """Deletions and creations of the same content within ten minutes."""
    from vaultweave.streaming.files import renames

    e = events(spark, sf)
    return renames(e.where("event_type = 'rejected'"), e.where("event_type = 'created'"), "k", "artifact_id", "10 minutes").select(F.col("d.seq").alias("deleted"), F.col("c.seq").alias("created"), F.col("d.k").alias("k"))


@query("SELECT artifact_id, arg_max(event_type, seq) AS last_type, max(seq) AS last_seq FROM led GROUP BY 1")
def latest_per_artifact(spark, sf):
    """The last change of each artifact, as an incremental rebuild needs it."""
    return ledger.latest_per(events(spark, sf)).select("artifact_id", F.col("event_type").alias("last_type"), F.col("seq").alias("last_seq"))


# Two states of customers: what they bought before and since a day.
_STATE = """o AS (SELECT o_custkey AS note_id, o_orderdate < TIMESTAMP '1995-06-17' AS early, o_orderpriority AS section, l_suppkey AS link, l_partkey % 40 AS dep, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  st AS (SELECT note_id, early, arg_max(section, o_orderkey) AS role, list(DISTINCT CAST(dep AS VARCHAR)) AS deps, list(DISTINCT CAST(link AS VARCHAR)) AS links, list(DISTINCT section) AS sections FROM o GROUP BY 1, 2)"""


def _states(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    rows = o.join(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    early = F.col("o_orderdate") < F.lit("1995-06-17").cast("timestamp_ntz")
    text = lambda c: F.collect_set(c.cast("string"))
    none = F.lit(None).cast("array<string>")

    def state(frame):
        return frame.groupBy(F.col("o_custkey").alias("note_id")).agg(
            F.max_by("o_orderpriority", "o_orderkey").alias("role"), text(F.col("l_partkey") % 40).alias("deps"), text(F.col("l_suppkey")).alias("links"), text(F.col("o_orderpriority")).alias("sections")
        ).select("note_id", "role", F.lit(None).cast("string").alias("layer"), "deps", "links", "sections", none.alias("aliases"), F.lit(None).cast("string").alias("definition"))

    return state(rows.where(early)), state(rows.where(~early))


@query(
    """b AS (SELECT * FROM st WHERE early), a AS (SELECT * FROM st WHERE NOT early),
      j AS (SELECT coalesce(a.note_id, b.note_id) AS note_id, coalesce(b.deps, []) AS bd, coalesce(a.deps, []) AS ad, coalesce(b.links, []) AS bl, coalesce(a.links, []) AS al, coalesce(b.sections, []) AS bs, coalesce(a.sections, []) AS s, b.role AS br, a.role AS ar FROM b FULL JOIN a ON a.note_id = b.note_id),
      d AS (SELECT note_id, len(list_filter(ad, lambda x: NOT list_contains(bd, x))) AS da, len(list_filter(bd, lambda x: NOT list_contains(ad, x))) AS dr, list_filter(al, lambda x: NOT list_contains(ad, x)) AS fa, list_filter(bl, lambda x: NOT list_contains(bd, x)) AS fb,
        len(list_filter(s, lambda x: NOT list_contains(bs, x))) AS sa, len(list_filter(bs, lambda x: NOT list_contains(s, x))) AS sr, br, ar FROM j),
      k AS (SELECT *, len(list_filter(fa, lambda x: NOT list_contains(fb, x))) AS la, len(list_filter(fb, lambda x: NOT list_contains(fa, x))) AS lr FROM d)
    SELECT note_id, CAST(da AS INTEGER) AS deps_added, CAST(dr AS INTEGER) AS deps_removed, CAST(la AS INTEGER) AS links_added, CAST(lr AS INTEGER) AS links_removed, CAST(sa AS INTEGER) AS sections_added, CAST(sr AS INTEGER) AS sections_removed, CAST(dr - da AS INTEGER) AS ambiguity_delta,
      coalesce(nullif(concat_ws(',', CASE WHEN da > 0 THEN 'dependency_addition' END, CASE WHEN dr > 0 THEN 'dependency_removal' END, CASE WHEN la > 0 THEN 'link_addition' END, CASE WHEN lr > 0 THEN 'link_removal' END,
        CASE WHEN sa > 0 THEN 'section_addition' END, CASE WHEN sr > 0 THEN 'section_removal' END, CASE WHEN br IS DISTINCT FROM ar THEN 'role_change' END), ''), 'unknown') AS change_types FROM k""",
    base=_STATE,
)
def change_classification(spark, sf):
    """What changed in each customer between two states."""
    found = changes.classify(*_states(spark, sf))
    n = lambda c: F.size(c).alias(c.replace("dependencies", "deps"))
    return found.select("note_id", *map(n, ["dependencies_added", "dependencies_removed", "links_added", "links_removed", "sections_added", "sections_removed"]), "ambiguity_delta", F.array_join("change_types", ",").alias("change_types"))


@query(
    """b AS (SELECT * FROM st WHERE early), a AS (SELECT * FROM st WHERE NOT early),
      j AS (SELECT coalesce(b.deps, []) AS bd, coalesce(a.deps, []) AS ad, coalesce(b.links, []) AS bl, coalesce(a.links, []) AS al, coalesce(b.sections, []) AS bs, coalesce(a.sections, []) AS s, b.role AS br, a.role AS ar FROM b FULL JOIN a ON a.note_id = b.note_id),
      d AS (SELECT len(list_filter(ad, lambda x: NOT list_contains(bd, x))) AS da, len(list_filter(bd, lambda x: NOT list_contains(ad, x))) AS dr, list_filter(al, lambda x: NOT list_contains(ad, x)) AS fa, list_filter(bl, lambda x: NOT list_contains(bd, x)) AS fb,
        len(list_filter(s, lambda x: NOT list_contains(bs, x))) AS sa, len(list_filter(bs, lambda x: NOT list_contains(s, x))) AS sr, br, ar FROM j),
      k AS (SELECT dr - da AS delta, list_filter([CASE WHEN da > 0 THEN 'dependency_addition' END, CASE WHEN dr > 0 THEN 'dependency_removal' END, CASE WHEN len(list_filter(fa, lambda x: NOT list_contains(fb, x))) > 0 THEN 'link_addition' END,
        CASE WHEN len(list_filter(fb, lambda x: NOT list_contains(fa, x))) > 0 THEN 'link_removal' END, CASE WHEN sa > 0 THEN 'section_addition' END, CASE WHEN sr > 0 THEN 'section_removal' END, CASE WHEN br IS DISTINCT FROM ar THEN 'role_change' END], lambda x: x IS NOT NULL) AS kinds FROM d),
      u AS (SELECT unnest(CASE WHEN len(kinds) = 0 THEN ['unknown'] ELSE kinds END) AS change_type, delta FROM k)
    SELECT change_type, count(*) AS n, CAST(sum(delta) AS BIGINT) AS ambiguity FROM u GROUP BY 1""",
    base=_STATE,
)
def change_summary(spark, sf):
    """How often each type of change occurs."""
    return changes.summary(changes.classify(*_states(spark, sf)))
