import datetime as dt

import pytest
from pyspark.sql import functions as F

from vaultweave.operators import changes, ledger, rules, views
from vaultweave.operators.search import tag_search, tag_text_search
from vaultweave.streaming.files import fold_pending

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_snapshots_and_pages(spark):
    rows = [(0, "a", "created", at(0), 0), (1, "a", "validated", at(1), 0), (2, "a", "approved", at(2), 0), (3, "b", "created", at(3), 0), (4, "b", "validated", at(4), 2), (5, "c", "executed", at(5), 0), (6, "a", "execution.logged", at(6), 0)]
    events = spark.createDataFrame(rows, "seq long, artifact_id string, event_type string, ts timestamp_ntz, errors int").withColumn("actor", F.lit("x"))
    got = {r.artifact_id: (r.status, r.approved_at, r.rejection_stage) for r in ledger.snapshots(events).collect()}
    assert got == {"a": ("approved", at(2), None), "b": ("rejected", None, "validation")}
    with pytest.raises(ValueError):
        ledger.snapshots(events, strict=True)
    assert [r.seq for r in ledger.limited(events, 2, descending=True).collect()] == [1, 0]
    assert [r.seq for r in ledger.limited(events, 2, latest=True).collect()] == [5, 6]
    assert [r.seq for r in ledger.after_artifact(events, "b").orderBy("seq").collect()] == [4, 5, 6]
    assert ledger.after_artifact(events, "none").count() == 0
    assert ledger.select_events(events, since="2024-01-01 00:00:02", until="2024-01-01 00:00:03").count() == 2
    assert ledger.snapshots(events.limit(0)).count() == 0


def test_executions(spark):
    schema = "seq long, execution_id string, artifact_id string, phase string, status string, attempt int, duration_ms double, error string, ts timestamp_ntz"
    rows = [
        (0, "e1", "a", "prepare", "started", 0, None, None, at(0)), (1, "e1", "a", "prepare", "completed", 0, 50.0, None, at(1)), (2, "e1", "a", "execute", "completed", 0, 150.0, None, at(2)),
        (3, "e1", "a", "commit", "skipped", 0, 9.0, None, at(3)), (4, "e2", "b", "execute", "failed", 1, 75.0, "boom", at(4)), (5, "e2", "b", "execute", "failed", 1, 75.0, "later", at(5)),
    ]
    got = {r.execution_id: r for r in ledger.execution_summaries(spark.createDataFrame(rows, schema)).collect()}
    assert (got["e1"].overall_status, got["e1"].total_duration_ms, got["e1"].attempts, got["e1"].n_phases) == ("success", 200.0, 1, 2)
    assert (got["e2"].overall_status, got["e2"].first_error, got["e2"].failure_phase, got["e2"].attempts, got["e2"].total_duration_ms) == ("failure", "boom", "execute", 2, 0.0)
    logs = spark.createDataFrame([(0, "e", {"items": "100", "host": "h1"}), (1, "e", {"items": "5", "host": "h2"})], "seq long, execution_id string, resources map<string,string>")
    assert {r.name: (r.total, r.first_text) for r in ledger.merged_resources(logs).collect()} == {"items": (105.0, None), "host": (None, "h1")}


def test_constraints(spark):
    ev = spark.createDataFrame([(0, "a", "core", "pass", at(0)), (1, "b", "core", "fail", at(1))], "seq long, artifact_id string, ruleset_id string, result string, ts timestamp_ntz")
    ch = spark.createDataFrame([("a", "i1", "fail"), ("c", "i1", "pass")], "artifact_id string, invariant_id string, status string")
    got = {r.artifact_id: (r.data_status, r.passed, r.violated_invariants) for r in ledger.constraint_summaries(ev, ch, spark.createDataFrame([(x,) for x in "abcd"], "artifact_id string")).collect()}
    assert got == {"a": ("present", 1, 1), "b": ("partial", 0, 0), "c": ("partial", 0, 0), "d": ("missing", 0, 0)}


def test_changes(spark):
    schema = "note_id string, role string, layer string, deps array<string>, links array<string>, sections array<string>, aliases array<string>, definition string"
    before = spark.createDataFrame([("n", "concept", "primitive", ["a"], ["a", "x"], ["Definition"], None, "old"), ("same", None, None, None, None, None, None, None), ("gone", "r", None, ["q"], [], [], [], None)], schema)
    after = spark.createDataFrame([("n", "concept", "mechanism", ["a", "b"], ["a", "b", "y"], ["Definition", "What this is NOT"], ["z"], "new"), ("same", None, None, [], [], [], [], None)], schema)
    got = {r.note_id: r for r in changes.classify(before, after).collect()}
    assert got["n"].change_types == ["dependency_addition", "link_addition", "link_removal", "section_addition", "definition_refinement", "layer_change", "alias_change"]
    assert got["n"].ambiguity_delta == -2 and got["n"].links_added == ["y"] and got["n"].improved == "decomposition"
    assert got["same"].change_types == ["unknown"] and got["gone"].change_types == ["dependency_removal", "role_change"] and got["gone"].ambiguity_delta == 1
    assert {r.change_type: r.n for r in changes.summary(changes.classify(before, after)).collect()}["unknown"] == 1


NOTES = [
    # name, kind, role, layer, dependencies, extra text
    ("primitive-ok", "concept", "concept", "primitive", [], "## Structural dependencies\nNone (primitive)"),
    ("object-ok", "concept", "concept", "first-order", ["primitive-ok"], "## Structural dependencies\n[[primitive-ok]]"),
    ("admissibility", "concept", "concept", "selector", ["object-ok"], "## Structural dependencies\n[[object-ok]]"),
    ("object-bad", "concept", "concept", "first-order", ["admissibility"], "## Structural dependencies\n[[admissibility]]"),
    ("cycle-a", "concept", "concept", "first-order", ["cycle-b"], "## Structural dependencies\n[[cycle-b]]"),
    ("cycle-b", "concept", None, "first-order", ["cycle-a"], "## Structural dependencies\n[[cycle-a]]"),
    ("links-paper", "concept", "concept", "first-order", [], "see [[test-paper]] and [[nowhere]] and [[old name]]"),
    ("test-paper", "paper", "paper", None, [], "text"),
    ("check", "diagnostic", "diagnostic", None, [], "The keeper is responsible for all."),
]


@pytest.fixture()
def vault(spark):
    from vaultweave.functions.markdown import links

    df = spark.createDataFrame([(n, n, k, r, la, True, t, d, ["old name"] if n == "object-ok" else []) for n, k, r, la, d, t in NOTES], "note_id string, name string, kind string, role string, layer string, canonical boolean, content string, deps array<string>, aliases array<string>")
    return rules.Vault(df.withColumn("links", links(F.col("content"))))


def test_lint(spark, vault):
    found = rules.run(vault, rules.BUILT_IN)
    got = sorted((r.rule, r.file) for r in found.collect())
    assert got == sorted([
        ("forbidden-edge", "links-paper"), ("missing-dependencies", "links-paper"), ("alias-drift", "links-paper"), ("dependency-cycle", "cycle-a"), ("missing-role", "cycle-b"),
        ("broken-link", "links-paper"), ("layer-violation", "object-bad"), ("kind-violation", "object-bad"), ("responsibility-scope", "check"),
    ])
    by = {r.invariant: (r.violations, r.status) for r in rules.by_invariant(found, rules.BUILT_IN).collect()}
    assert by == {"governance": (2, "fail"), "irreversibility": (1, "fail"), "attribution": (1, "fail"), "decomposition": (2, "fail"), "structural": (3, "fail")}
    assert {r.file: r.worst for r in rules.per_file(found).collect()}["links-paper"] == "error"
    assert rules.run(vault, rules.BUILT_IN, only_invariant="attribution").count() == 1


TOML = """
ruleset_id = "core"
version = 2
[defaults]
severity = "warning"
scope = "concept"
[[rules]]
id = "keys"
message = "one must set the layer"
predicate = { name = "has_keys", params = { keys = ["role", "layer"] } }
[[rules]]
id = "heads"
severity = "info"
predicate = { name = "has_headings", params = { headings = ["Structural dependencies"] } }
[[rules]]
id = "roles"
predicate = { name = "outlinks_to_roles", params = { roles = ["Paper"] } }
[[rules]]
id = "odd"
predicate = { name = "no_such" }
"""


def test_ruleset(spark, vault):
    core = rules.load_ruleset(TOML)
    got = sorted((r.rule, r.level, r.file) for r in rules.run(vault, core.rules).collect())
    assert got == [("heads", "info", "links-paper"), ("keys", "warning", "cycle-b"), ("odd", "error", "vault"), ("roles", "warning", "links-paper")]
    assert [r.rule for r in rules.ruleset_language(spark, core).collect()] == ["keys"]
    for bad in ('version = 1', 'ruleset_id = "x"\nversion = 0'):
        with pytest.raises(ValueError):
            rules.load_ruleset(bad)


def test_views_and_search(spark):
    notes = spark.createDataFrame([("b", "x", 2, ["lens"]), ("a", "x", None, []), ("c", None, 5, ["lens", "y"])], "name string, layer string, n int, links array<string>")
    v = views.View(["name", "n", "lens"], {"lens": views.has_link("links", "lens")}, any_of=["layer = 'x'", "n > 4"], sort=["-n"], footers={"n": "Average"})
    assert [(r.name, r.lens) for r in views.rows(notes, v).collect()] == [("c", "yes"), ("b", "yes"), ("a", "no")]
    assert views.footers(notes, v).first().n_average == 3.5
    texts = spark.createDataFrame([(1, "Harbor note", "x"), (2, "Other", "the harbour"), (3, "Third", "nothing")], "id int, title string, body string")
    tags = spark.createDataFrame([(1, "core"), (2, "core/a"), (2, "core")], "id int, tag string")
    assert [r.id for r in tag_search(tags, "core", "id").orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in tag_text_search(texts, tags, "core", "harb", ["title", "body"], "id").orderBy("rank").collect()] == [1, 2]


def test_pending():
    assert fold_pending(["created", "modified"]) == "created" and fold_pending(["created", "deleted"]) is None
    assert fold_pending(["deleted", "created"]) == "modified" and fold_pending(["modified", "modified"]) == "modified" and fold_pending(["modified", "deleted"]) == "deleted"


def test_every_event_is_checked(spark, small):
    from vaultweave.plans import ledger as plans
    from vaultweave.session import table

    kinds = [r.event_type for r in table(spark, small, "events").collect()]
    found = plans.constraint_summaries(spark, small).collect()
    assert sum(r.rules_checked for r in found) == kinds.count("view")
    assert sum(r.checks for r in found) == kinds.count("click")
    clicked = {r.user_id for r in table(spark, small, "events").where("event_type = 'click'").collect()}
    assert {r.artifact_id for r in plans.invariant_summaries(spark, small).collect()} == clicked
