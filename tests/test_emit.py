"""Engine events, configuration and source scans, reports, further rules and the pending stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vaultweave.operators import emit, reports, rules
from vaultweave.sources import configs, logs
from vaultweave.streaming.files import pending_changes


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("1", "alpha", "concept", "concept", "primitive", True, "# A\n## Definition\nIt is. More.\nsee [[beta]] and [[gone]] x [[papers/beta|B]]\n## Residuals", ["beta", "gone"], ["beta"], []),
        ("2", "beta", "concept", None, "mechanism", True, "## Definition\n[[alpha]]", ["alpha"], ["alpha"], ["bee"]), ("3", "gamma", "paper", "paper", None, False, None, [], [], []),
    ]
    return spark.createDataFrame(rows, "note_id string, name string, kind string, role string, layer string, canonical boolean, content string, links array<string>, deps array<string>, aliases array<string>")


def test_engine_events(spark, notes):
    picked = [r for r in rules.BUILT_IN if r.id in ("missing-role", "missing-dependencies", "forbidden-edge")]
    results = rules.run(rules.Vault(notes), picked)
    events = emit.evaluated(results, picked, notes.select(F.col("note_id").alias("item")), "core", 2)
    got = {(r.rule_id, r.item): r.result for r in events.collect()}
    assert len(got) == 9 and got["missing-role", "2"] == "warning" and got["missing-dependencies", "1"] == "fail" and got["forbidden-edge", "1"] == "pass"
    by = {r.invariant: r for r in emit.checked(events).collect()}
    assert (by["irreversibility"].status, by["irreversibility"].violations, by["governance"].status, by["governance"].rules_checked) == ("fail", 2, "pass", 2)
    seq = [r.seq for r in emit.sequenced(events, 11, "rule_id", "item").orderBy("rule_id", "item").collect()]
    assert seq == list(range(11, 20))
    with pytest.raises(ValueError):
        emit.created(spark, "artifact.unknown", "a", "me", {})
    one = emit.created(spark, "artifact.created", "a", "me", {"b": 1, "a": 2}, 5).first()
    assert (one.seq, json.loads(one.payload)) == (5, {"a": 2, "b": 1})
    assert emit.ulid(0, 0) == "0" * 26 and emit.ulid(1, 0) < emit.ulid(2, 0) and len(emit.ulid()) == 26
    ids = [r[0] for r in spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 1)], "t string, s int").select(emit.ulids(F.col("t").cast("timestamp"), F.col("s"))).collect()]
    assert len(set(ids)) == 3 and max(ids[:2]) < ids[2] and all(len(i) == 26 for i in ids)


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    emit.logged(emit.operation(spark, "graph.load", {"edges": 3}, {"notes": 2}), path, ["operation", "erased", "created"])
    emit.logged(emit.operation(spark, "lint"), path, ["operation", "erased", "created"])
    got = {r.operation: r.erased for r in logs.read_log(spark, path, "timestamp string, operation string, erased map<string,bigint>").collect()}
    assert got == {"graph.load": {"edges": 3}, "lint": {}}


def test_configs(spark, tmp_path):
    (tmp_path / "hubs.yml").write_text("required_headings: ['## A']\nhubs:\n  Alpha: Primitive hub\n  beta: {class: X, required_headings: ['## B', '## Definition']}\n")
    assert configs.read_yaml(spark, str(tmp_path / "none.yml")) == {}
    policy = configs.hub_policy(spark, configs.read_yaml(spark, str(tmp_path / "hubs.yml")))
    assert {(r.name, r.hub_class, tuple(r.headings)) for r in policy.collect()} == {("alpha", "Primitive hub", ("## A",)), ("beta", "X", ("## B", "## Definition"))}
    over, orders = configs.registry_overrides(spark, {"concept_overrides": {"A": {"role": "r"}}, "section_orders": {"Mechanisms": ["x"]}})
    assert over.first().name == "a" and orders == {"Mechanisms": ["x"]}
    code = tmp_path / "src"
    (code / "tests").mkdir(parents=True)
    (code / "a.py").write_text('import os.path\nfrom x import y\n"""We must do it."""\nstore.write(1)\n')
    (code / "b.py").write_text("store.write(2)\nlog_event()\n")
    (code / "bad.py").write_text("def (")
    (code / "tests" / "t.py").write_text("store.write(3)\n")
    found = configs.read_statements(spark, str(code))
    rows = {(r.path, r.line, r.kind, r.text) for r in found.collect()}
    assert {("a.py", 1, "import", "os.path"), ("a.py", 2, "import", "x.y"), ("a.py", 4, "call", "store.write")} <= rows and {r[0] for r in rows if r[2] == "error"} == {"bad.py"} and not {r for r in rows if "tests" in r[0]}
    assert [r.path for r in configs.prescriptive_strings(found).collect()] == ["a.py"] and [tuple(r) for r in configs.calls_without(found, ["write"], ["log_event"]).collect()] == [("a.py", 1)]
    listed = {(r.path, r.is_page) for r in configs.read_files(spark, str(tmp_path), ignored=["src/*"]).collect()}
    assert listed == {("hubs.yml", False)}


def test_more_rules(spark, notes):
    policy = spark.createDataFrame([("alpha", ["## Definition", "## Use"]), ("beta", ["## Definition"])], "name string, headings array<string>")
    assert [(r.file, r.message) for r in rules.lacking_headings(notes, policy).collect()] == [("1", "hub lacks: ## Use")]
    got = {tuple(r) for r in rules.spans(notes, notes.select("name")).collect()}
    assert got == {("1", 3, 17, 25, "gone")}
    v = rules.Vault(notes)
    cyc = rules.run(v, [rules.Rule("c", "cycle_paths")]).collect()
    assert [(r.file, r.message) for r in cyc] == [("alpha", "dependency cycle: alpha -> beta -> alpha")]
    results = rules.run(v, rules.BUILT_IN)
    levels = [r.level for r in rules.ordered(results).collect()]
    assert levels == sorted(levels, key=["error", "warning", "info"].index) and rules.status(results)[1] == 1 and rules.status(results.where("level = 'warning'"))[1] == 0 and rules.status(results.where("level = 'warning'"), strict=True)[1] == 1
    assert sum(len(r.findings) for r in rules.by_file(results).collect()) == len(levels)
    assert "missing-role" in rules.explain("missing-role")
    with pytest.raises(LookupError):
        rules.explain("no-such-rule")
    assert rules.without_failure_modes(spark.createDataFrame([(1, None), (2, []), (3, ["x"])], "id int, failure_modes array<string>")).count() == 2


def test_reports(spark, notes):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "n string, k int")
    assert reports.as_markdown(df, "T") == "# T\n\n| n | k |\n|---|---|\n| a\\|b | 1 |\n|  | 2 |\n" and json.loads(reports.as_json(df, "T"))["rows"][1] == {"n": None, "k": 2}
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a")], "src string, dst string")
    assert reports.as_dot(edges, "g") == 'digraph "g" {\n  "a" -> "b";\n  "c" -> "a";\n}\n'
    assert reports.difference("a\nb\n", "a\nb\n") == "" and "+c" in reports.difference("a\n", "a\nc\n")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    assert {tuple(r) for r in reports.row_difference(rows((1, "a"), (2, "b"), (3, None)), rows((2, "x"), (3, None), (4, "d")), "k").collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    aliases = spark.createDataFrame([("bee", "beta")], "alias string, canonical string")
    titled = notes.withColumn("title", F.initcap("name"))
    assert reports.card(titled, "BEE", aliases)["name"] == "beta" and reports.card(titled, "alpha")["says"] == "It is." and reports.card(titled, "zeta") is None
    assert [r.node for r in reports.neighbours(edges, "a").collect()] == ["b"] and [r.node for r in reports.neighbours(edges, "a", inward=True).collect()] == ["c"]
    assert reports.members(spark.createDataFrame([("x", "c1"), ("y", "c2")], "node string, community string"), "c1").count() == 1
    assert reports.chained(df, [lambda d: d.where("k = 1")], ["n"]).count() == 1
    with pytest.raises(ValueError):
        reports.chained(df, [lambda d: d.drop("n")], ["n"])
    state = configs.vault_state(notes.withColumn("path", F.col("name")))
    again = configs.vault_state(notes.withColumn("path", F.col("name")).orderBy(F.desc("name")))
    assert tuple(state.first()) == tuple(again.first()) and state.first().concepts == 2


def test_pending_stream(spark, tmp_path):
    """What waits in one micro-batch meets what comes in the next."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rows = [
        [("p", "created", 1, "h1", 0), ("q", "created", 2, "h1", 0), ("r", "modified", 3, "h1", 0)], [("p", "deleted", 4, None, 0.5), ("q", "modified", 5, "h2", 0.5), ("z", "created", 6, "h", 100)],
        [("q", "modified", 7, "h2", 101), ("z", "deleted", 8, None, 140), ("y", "created", 9, "h", 200)], [("w", "created", 10, "h", 400)], [("w", "modified", 11, "h", 800)],
    ]
    for i, batch in enumerate(rows):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "seq", "hash", "s"), r))) for r in batch))
        # Files come in the order of their times.
        os.utime(src / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    stream = spark.readStream.schema("path string, kind string, seq long, hash string, s double").option("maxFilesPerTrigger", 1).json(str(src))
    stamped = stream.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    query = pending_changes(stamped).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    query.stop()
    got = sorted((r.path, r.kind, r.hash) for r in spark.read.parquet(out).collect())
    assert ("q", "created", "h2") in got and ("r", "modified", "h1") in got and not [g for g in got if g[0] == "p"]
    assert [g for g in got if g[0] == "q"] == [("q", "created", "h2")] and ("z", "created", "h") in got and ("z", "deleted", None) in got
