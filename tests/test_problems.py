import datetime as dt
from collections import Counter

import brute
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultweave.functions.keys import note_key
from vaultweave.operators.hierarchy import ancestors, descendants, hierarchy, resolve_paths, several_parents
from vaultweave.operators.orphans import orphan_references
from vaultweave.operators.packed import split_packed
from vaultweave.plans import problems
from vaultweave.session import table

ODD = [
    "a, b;; c", '["a", "b\\u00a0c", null, " "]', "- \"x, y\"\n* '[[a|b; c]]'\n", '"The ""hub"" reading; 23", Drofik\'s wheel notes',
    '[[a|b, "c"]]<br>x / y/z | q', '""," ",a', None, "   ", "", "'a''b', c", "* hello", "[x, y", "n/a", "- ", "x" * 50000 + ", " + '"' * 50000 + ",y",
    "a • b · c\td", "a - b, c * d", "- a\n\n- b, c\n * d", "[not json]", ",".join(["v"] * 20000), ",;|", '"x"', "[]",
]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_split_odd(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] * 2, "i int, text string, value2 string")
    got = rows(split_packed(df, "text", ["i"]))
    want = Counter((i, k, v) for i, t in enumerate(ODD) for k, v in enumerate(brute.split(t), 1) for _ in range(2))
    assert got == want
    assert rows(split_packed(df.limit(0), "text", ["i"])) == Counter()


def test_split_whole_tables(spark, small):
    got = rows(problems.p3_found(spark, small))
    want = Counter()
    for name, column in problems.PACKED_FIELDS:
        for r in table(spark, small, name).select("row_id", column).collect():
            want.update((f"{name}.{column}", r[0], i, v) for i, v in enumerate(brute.split(r[1]), 1))
    assert got == want and got


def test_keys(spark):
    given = ["[[A|b]]", "![[x/y/Z.md#h|d]]", "[[a\\|b]]", " B.MD ", "p/q", None, "", "[[ a b ]]", "[[#h]]"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in given], "v string").select(note_key(F.col("v"))).collect()]
    assert got == ["a", "z", "a", "b", "q", None, "", "a b", ""]


def test_hierarchy_small(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "nowhere"), ("s", "s"), ("t", "s"), ("x", "y"), ("y", "z"), ("z", "y"), (None, "a"), ("m", "a"), ("m", "c")]
    links += [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(100)]
    df = spark.createDataFrame(links, "node string, parent string")
    paths = resolve_paths(df)
    assert {tuple(r) for r in ancestors(paths).collect()} == brute.ancestors(links)
    h = {r.node: r for r in hierarchy(paths).collect()}
    assert (h["c"].path, h["c"].depth, h["c"].root) == ("a/b/c", 2, "a") and h["x"].path is None and h["x"].depth is None and h["x"].cycle == "y"
    assert resolve_paths(df.limit(0)).count() == 0


def test_hierarchy_long(spark):
    """One cycle of 100,000 nodes with a tail, and a path of 1,000: pointers alone go round the cycle."""
    n = 100_000
    ring = spark.range(n).select(F.format_string("r%06d", "id").alias("node"), F.format_string("r%06d", (F.col("id") + 1) % n).alias("parent"))
    path = spark.range(1000).select(F.format_string("p%04d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("p%04d", F.col("id") - 1)).alias("parent"))
    tail = spark.createDataFrame([("t1", "t2"), ("t2", "r054321"), ("a", "b"), ("b", "a")], "node string, parent string")
    found = resolve_paths(ring.unionByName(path).unionByName(tail))
    cycles = {r.cycle: r["count"] for r in found.where("cycle is not null").groupBy("cycle").count().collect()}
    assert cycles == {"r000000": n + 2, "a": 2}
    depth = hierarchy(found.where("cycle is null")).agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.min("root").alias("r")).first()
    assert (depth.n, depth.d, depth.r) == (1000, 999, "p0000")


def test_descendants_and_parents(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "nowhere"), ("x", "y"), ("y", "x"), ("z", "x")]
    df = spark.createDataFrame(links, "node string, parent string")
    assert {tuple(r) for r in descendants(resolve_paths(df)).collect()} == {("a", "b", 1), ("a", "c", 1)}
    assert [tuple(r) for r in several_parents(df).collect()] == [("c", 2, "a")]
    assert several_parents(df.limit(0)).count() == 0


def test_hierarchy_tables(spark, small):
    got = [tuple(r) for r in problems.p2_found(spark, small).collect()]
    links = [tuple(r) for r in problems.node_links(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.ancestors(links)


def test_orphans_tables(spark, small):
    got = rows(problems.p5_found(spark, small))
    life = {}
    for name in ("concepts", "notes"):
        for r in table(spark, small, name).collect():
            life[brute.key(r.name)] = (r.created, r.removed)
    want = Counter()
    for name, column, bare in (("papers", "concepts_linked", True), ("primitives_and_foundational", "depends_on", False)):
        for r in table(spark, small, name).select("row_id", column, "exported_at").collect():
            for i, v in enumerate(brute.split(r[1]), 1):
                if not bare and not brute.is_link(v):
                    continue
                k = brute.key(v)
                kind = None
                if k not in life:
                    kind = "missing"
                elif life[k][0] and life[k][0] > r.exported_at:
                    kind = "late"
                elif life[k][1] and life[k][1] <= r.exported_at:
                    kind = "deleted"
                if kind:
                    want[(name, r.row_id, i, k, kind, f"{r.exported_at:%Y-%m}")] += 1
    assert got == want and len({k[4] for k in want}) == 3


def test_orphans_composite(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    targets = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, n int")
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", None), (4, None, 3), (5, None, 9), (6, None, None), (7, "z", None), (2, "a", 2)], "id int, k string, n int").selectExpr("*", "'x' as kind", "'y' as created")
    ids = lambda m: sorted(r.id for r in orphan_references(refs, targets, ["k", "n"], match=m).collect())
    assert ids("simple") == [2, 2] and ids("partial") == [2, 2, 5, 7] and ids("full") == [2, 2, 3, 4, 5, 7]
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("made", T.TimestampNTZType()), T.StructField("gone", T.TimestampNTZType())])
    timed = spark.createDataFrame([("a", day(5), None), ("a", day(3), None), ("b", None, day(4)), ("c", None, None)], schema)
    r = spark.createDataFrame([(k, day(d)) for k in "abc" for d in (2, 4)] + [("a", None), ("q", None)], T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.TimestampNTZType())]))
    for lookup in (None, timed.limit(0), timed):
        got = rows(orphan_references(r, timed, ["k"], "at", "made", "gone", lookup=lookup).select("k", "at", "kind"))
        assert got == Counter({("a", day(2), "late"): 1, ("b", day(4), "deleted"): 1, ("q", None, "missing"): 1})


def test_domain_notes_without_links_are_gaps(spark, tmp_path):
    from vaultweave.plans import vault as plans

    rows = [(1, "domain", "s", "On [[plateau]] and [[Yoke]]."), (2, "Domain", "s", "No link at all."), (3, "domain", None, None), (4, "concept", "s", "[[yoke]]")]
    spark.createDataFrame(rows, "doc_id long, note_kind string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in plans.view_coverage(spark, str(tmp_path)).collect()}
    assert {i: tuple(r)[1:].count("yes") for i, r in got.items()} == {1: 2, 2: 0, 3: 0} and set(got[3][1:]) == {"no"}
    assert {r.missing: r.n for r in plans.audit_domain_gaps(spark, str(tmp_path)).collect()} == {3: 1, 5: 2}
