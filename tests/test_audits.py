"""Note types, registry, audits and cycles on small fixtures."""

import pytest
from pyspark.sql import functions as F

from vaultweave.operators import audits, graph, ledger, ordering, registry, typing

REGISTRY = """
[defaults]
requires_frontmatter = true
[[types]]
type_id = "concept"
[types.locations]
allowed_patterns = ["concepts/*.md"]
forbidden_patterns = ["concepts/_*"]
allowed_extensions = [".md"]
[types.metadata]
required = ["role", "layer"]
[types.metadata.constraints]
role = { type = "literal", value = "concept" }
layer = { type = "enum", values = ["primitive", "mechanism"] }
canonical = { type = "boolean" }
size = { type = "integer" }
tags = { type = "list", item_type = "string", allowed = ["a", "b"] }
[[types]]
type_id = "diagnostic"
[types.locations]
allowed_patterns = ["diagnostics/**/*.md"]
"""


def test_note_types(spark):
    types = typing.load_types(REGISTRY)
    with pytest.raises(ValueError):
        typing.load_types("x = 1")
    notes = [
        ("ok", "concepts/a.md", '{"role":"concept","layer":"primitive","canonical":true,"size":3,"tags":["a"]}'), ("bad", "concepts/b.md", '{"role":"x","layer":"y","canonical":"true","size":1.5,"tags":["c",1]}'),
        ("none", "concepts/c.md", None), ("part", "concepts/d.md", '{"role":"concept"}'), ("private", "concepts/_e.md", "{}"), ("deep", "diagnostics/x/f.md", '{"k":1}'), ("other", "misc/g.md", None), ("text", "concepts/h.md", '{"role":"concept","layer":"primitive","tags":"a"}'),
    ]
    df = spark.createDataFrame(notes, "note_id string, path string, front string")
    kinds = {r.note_id: r.t for r in df.select("note_id", typing.type_of(F.col("path"), types).alias("t")).collect()}
    assert kinds == {"ok": "concept", "bad": "concept", "none": "concept", "part": "concept", "private": None, "deep": "diagnostic", "other": None, "text": "concept"}
    got = {(r.note_id, r.field) for r in typing.validate(df, types).collect()}
    assert got == {("bad", "role"), ("bad", "layer"), ("bad", "canonical"), ("bad", "size"), ("bad", "tags"), ("none", None), ("part", "layer"), ("text", "tags")}
    assert typing.validate(df.limit(0), types).count() == 0 and typing.listing(spark, types).count() == 2
    rules = spark.createDataFrame([("note:*", "error"), ("graph|note:x", "warning"), ("vault", "error")], "scope string, severity string")
    assert typing.rules_in_scope(rules, "note:x").count() == 2 and typing.rules_in_scope(rules, "graph", "warning").count() == 1


def test_registry(spark):
    concepts = spark.createDataFrame([("B", "primitive", "r", []), ("a", "mechanism", "r", ["z", "y"]), ("c", "odd", None, None), ("d", "foundational", "r", None), ("e", "mechanism", "r", None)], "name string, layer string, role string, deps array<string>")
    over = spark.createDataFrame([("b", "Own", "Primitive hub")], "name string, role string, hub_class string")
    rows = registry.rows(concepts, over, {"mechanisms": ["E"]})
    text = registry.text(rows).first().text
    assert text.startswith("### Concepts :: Primitives\n\n| Concept | Role | Depends On |\n|---|---|---|\n| [[B]] | Own (hub: Primitive hub) | None (primitive) |\n| [[d]] | r | None (axiomatic) |\n\n### Concepts :: Mechanisms")
    assert text.index("[[e]]") < text.index("| [[a]] | r | [[y]], [[z]] |") and text.endswith("### Concepts :: Unclassified (odd)\n\n| Concept | Role | Depends On |\n|---|---|---|\n| [[c]] |  | None |\n")
    assert [tuple(r) for r in registry.unknown_layers(concepts).collect()] == [("odd", 1)]
    note = lambda *rows: spark.createDataFrame(list(rows), "name string, role string, content string")
    fresh = registry.drift(rows, note(("r", "registry", f"# x\n{text}\n## After\n| [[no]] |")))
    assert [tuple(r) for r in fresh.collect()] == [("ok", "current", None)]
    stale = registry.drift(rows, note(("Concept Registry", None, text.replace("| [[c]] |  | None |", "| [[gone]] | | |"))))
    assert {(r.kind, r.line) for r in stale.collect()} == {("missing", "| [[c]] |  | None |"), ("stale", "| [[gone]] | | |")}
    assert registry.drift(rows, note(("x", "paper", ""))).first().status == "ok" and registry.drift(rows, note(("a", "registry", ""), ("b", "registry", ""))).first().status == "error"


def test_mentions(spark):
    names = spark.createDataFrame([("gated-seam", "Gated Seam", ["old fence"]), ("ox", "Ox", None), ("seam", "Seam", [])], "node string, title string, aliases array<string>")
    texts = spark.createDataFrame([("n", "The gated seam, a Gated-Seam; seams. Old\nfence. ox"), ("seam", "seam"), ("e", None), ("f", "")], "src string, text string")
    got = {(r.src, r.dst): r.n for r in audits.mentions(texts, names).collect()}
    assert got == {("n", "gated-seam"): 2, ("n", "seam"): 2}
    links, deps = (spark.createDataFrame([e], "src string, dst string") for e in (("n", "seam"), ("n", "gated-seam")))
    assert [tuple(r) for r in audits.unlinked_mentions(audits.mentions(texts, names), links, deps).collect()] == [("n", "gated-seam", 2, True)]
    assert {tuple(r) for r in audits.disagreements(links, deps).collect()} == {("n", "seam", "link"), ("n", "gated-seam", "depends")}


def test_definitions(spark):
    text = "---\nrole: concept\n---\n# T\n\nFirst para.\n\n## Definition\nA seam is not a fence. You must cross. [[gate]] and old fence.\n\n## What this is NOT\n- Not x\n\n## Structural dependencies\n- [[gate]]\n- [[lone]]\n"
    notes = spark.createDataFrame([("seam", "mechanism", text, ["Lone"]), ("empty", None, None, None)], "node string, layer string, content string, deps array<string>")
    names = spark.createDataFrame([(n,) for n in ("seam", "gate", "old-fence", "lone", "fence")], "node string")
    implied = audits.implicit_dependencies(notes, names)
    assert {tuple(r) for r in implied.collect()} == {("seam", "old-fence"), ("seam", "fence")}
    assert audits.implicit_clusters(implied).count() == 2
    d = {r.node: r for r in audits.definitions(notes).collect()}["seam"]
    assert d.negations == 2 and d.prescriptive == 1 and d.assessment == "mixed" and d.nots == 1
    one = audits.definition_summary(audits.definitions(notes.where("node = 'seam'")), implied).first()
    assert (one.notes, one.prescriptive, one.implicit) == (1, 1, 1)
    a = {r.node: r for r in audits.concept_audit(notes, spark.createDataFrame([("seam", "gate")], "src string, dst string")).collect()}
    assert (a["seam"].has_definition, a["seam"].only_declared, a["seam"].out_degree, a["empty"].has_definition) == (True, 1, 1, False)
    roles = notes.select("node", audits.short_role(F.col("content"), F.col("node")).alias("r")).collect()
    assert dict(roles) == {"seam": "A seam is not a fence. You must cross. [[gate]] and old fence.", "empty": "empty"}
    assert spark.range(1).select(audits.ghost_id(F.lit(" Some (term)! "))).first()[0] == "ghost/some-term"


def test_simple_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    assert {tuple(r.cycle) for r in graph.simple_cycles(edges).collect()} == {("a", "b"), ("a", "b", "c"), ("d",)}
    found = {r.node: r for r in graph.trace(edges, spark.createDataFrame([("x",)], "node string"), spark.createDataFrame([("x",)], "node string")).collect()}
    assert found["y"].missing and found["y"].direct and found["x"].level == 1


def test_numbered_and_ledger(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.v + 1 == r.number for r in ordering.numbered(df, "v").collect()) and ordering.numbered(df.limit(0), "v").count() == 0
    assert ordering.clamped(df, 0).count() == 1 and ordering.clamped(df, 9999).count() == 500
    changes = spark.createDataFrame([(1, "Alpha", ["link_addition"], [("decomposition", "improved", None)]), (2, "beta", ["role_change"], []), (3, "alphabet", ["link_addition"], None)], "seq int, note_id string, change_types array<string>, invariant_impacts array<struct<invariant:string,direction:string,detail:string>>")
    assert [r.seq for r in ledger.shown(changes, "alpha", "link_addition", 1).collect()] == [3] and ledger.affecting(changes, "decomposition").count() == 1
    assert ledger.having(changes, "change_types", "role_change").first().seq == 2 and ledger.after_seq(changes, 2).count() == 1
