"""Site grammar, paths, links and transclusion: golden pairs and small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vaultweave.functions import show, site, slugs
from vaultweave.operators import files, guard, resolve
from vaultweave.operators.highlight import best_window, marked, search_terms


def values(spark, f, given):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_slugs(spark):
    pairs = {
        "content/index.md": "content/index", "content/_index.md": "content/index", "/content/index.md": "content/index", "content/cool.png": "content/cool.png", "note with spaces.md": "note-with-spaces",
        "notes.with.dots.md": "notes.with.dots", "test/special chars?.md": "test/special-chars", "test/special chars #3.md": "test/special-chars-3", "cool/what about r&d?.md": "cool/what-about-r-and-d",
    }
    assert values(spark, slugs.slugify_path, pairs) == list(pairs.values())
    simple = {"index": "/", "abc": "abc", "abc/index": "abc/", "abc/def": "abc/def"}
    assert values(spark, slugs.simplify_slug, simple) == list(simple.values())
    keys = ["n2", "n10", "n1", "n10000000000000000000000", "n9999999999999999999999", "n010"]
    by_key = dict(zip(keys, values(spark, slugs.natural_key, keys)))
    assert sorted(keys, key=by_key.get)[:2] == ["n1", "n2"] and by_key["n9999999999999999999999"] < by_key["n10000000000000000000000"]


def test_kinds_of_paths(spark):
    got = values(spark, site.slug_kind, ["a/b.md", "a/b", "./a", "/a", "a b", "index", "https://x.org", "a/index", "../x.md"])
    flags = [{k for k, v in r.asDict().items() if v} for r in got]
    assert flags == [{"file", "full"}, {"full", "simple"}, {"relative"}, set(), set(), {"full"}, {"absolute", "file", "full"}, {"full"}, set()]
    assert values(spark, site.path_to_root, ["a/b/c", "a", "a/index", ""]) == ["../..", ".", "..", "."]
    assert values(spark, site.is_folder_path, ["a/", "index", "a/index.md", "a/b"]) == [True, True, True, False]
    assert values(spark, lambda c: F.concat_ws("|", *site.split_anchor(c)), ["a#My Head", "a", "x.pdf#Page 3"]) == ["a|#my-head", "a|", "x.pdf|#Page 3"]
    assert values(spark, site.slug_tag, ["a b/c&d"]) == ["a-b/c-and-d"]


def test_link_strategies(spark):
    pages = spark.createDataFrame([(s,) for s in ("a/b/c", "a/b/d", "a/b/index", "e/f", "e/g/h", "index", "a/test.png")], "slug string")
    want = {
        "shortest": {"d": "../../a/b/d", "h": "../../e/g/h", "test.png": "../../a/test.png", "index#abc": "../../#abc"},
        "absolute": {"a/b/index": "../../a/b/", "tag/test": "../../tag/test", "a/b/d": "../../a/b/d"},
        "relative": {"d": "./d", "../x": "../x", "../../e/g/h": "../../e/g/h"},
    }
    for strategy, pairs in want.items():
        links = spark.createDataFrame([("a/b/c", k) for k in pairs], "page string, link string")
        assert {r.link: r.href for r in resolve.transform_links(links, pages, strategy).collect()} == pairs
    with pytest.raises(ValueError):
        resolve.transform_links(pages, pages, "nearest")


def test_wikilinks_in_parts(spark):
    text = "![[a/B#Head|Al ias]] [[#only]] [[x#^blk]] | [[t\\|u]] | [[]] [[plain]]"
    got = [tuple(x) for x in values(spark, site.site_links, [text, None, ""])[0]]
    assert got == [(True, "a/B", "Head", None, "Al ias"), (False, None, "only", None, None), (False, "x", None, "blk", None), (False, "t", None, None, "u"), (False, None, None, None, None), (False, "plain", None, None, None)]
    assert values(spark, site.site_links, [None, ""]) == [[], []]


def test_marks(spark):
    text = "line ^id-1\n> [!Hint]- Look here\n> x\n- [ ] a\n- [x] b\n==hot== %%gone\nagain%% a --> b <= c"
    one = lambda f: values(spark, f, [text])[0]
    assert one(site.block_references) == ["id-1"] and [tuple(c) for c in one(site.callouts)] == [("tip", "Look here", "-")]
    assert one(site.highlights) == ["hot"] and "gone" not in one(site.without_comments) and one(site.with_arrows).endswith("a &rArr; b &lArr; c")
    assert one(lambda c: F.array(*site.checkboxes(c))) == [1, 1]
    assert values(spark, site.video_id, ["https://www.youtube.com/watch?v=dQw4w9WgXcQ", "https://youtu.be/dQw4w9WgXcQ?t=1", "https://x.org"]) == ["dQw4w9WgXcQ", "dQw4w9WgXcQ", None]
    assert values(spark, site.embed_kind, ["a.PNG", "b.mp4", "c.flac", "d.pdf", "e"]) == ["image", "video", "audio", "pdf", "page"]
    assert values(spark, site.from_roam, ["{{[[TODO]]}} ^^hot^^ __it__ {{or:a|b}}\n[[>]] said"]) == ["[ ] ==hot== *it* (a|b)\n> said"]
    hugo = '[t]({{< relref "p" >}})\n# Head {#anchor}\n< figure src="i.png" >\n{{< x >}}\n\\\\(a\\_b\\\\)'
    assert values(spark, site.from_hugo, [hugo]) == ["[t](p)\n# Head\n![](i.png)\n< x >\n$a_b$"]


def test_transclusion(spark):
    pages = [
        ("a", "start ![[b]] end"), ("b", "B says ![[c#Two]] and ![[a]]"), ("c", "# One\nx\n## Two\ny\n### Deep\nz\n## Three\nw ^blk\n"), ("d", "see ![[c#^blk]] ![[nowhere]]"), ("n", None), ("e", ""),
    ]
    got = {r.slug: r.text for r in resolve.transcluded(spark.createDataFrame(pages, "slug string, text string")).collect()}
    assert got["a"] == "start B says ## Two\ny\n### Deep\nz and ![[a]] end" and got["d"] == "see w ![[nowhere]]"
    assert len(got) == 6 and got["n"] is None and got["c"] == pages[2][1]


def test_names_and_overlay(spark):
    notes = spark.createDataFrame([("Constraint Load", 1), ("load", 2), ("overload", 3)], "name string, id int")
    assert resolve.one(resolve.named(notes, "LOAD"), "LOAD").id == 2 and resolve.one(resolve.named(notes, "straint"), "x").id == 1
    for asked in ("loa", "nothing"):
        with pytest.raises(LookupError):
            resolve.one(resolve.named(notes, asked), asked)
    base = spark.createDataFrame([("f", "default", "x"), ("g", "default", "y")], "key string, title string, kept string")
    over = spark.createDataFrame([("g", "mine"), ("h", "none")], "key string, title string")
    assert {tuple(r) for r in resolve.overlaid(base, over, "key").collect()} == {("f", "default", "x", False), ("g", "mine", "y", True)}


def test_files(spark):
    rows = [("a.md", "b.md"), ("a.md", "x.bin"), ("x.bin", "c.toml"), (".h/a.md", "y.bin"), ("concepts/registry.md", "r.yml")]
    got = {(r.source, r.kind, r.path) for r in files.moves(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {("a.md", "file_renamed", "b.md"), ("a.md", "file_deleted", "a.md"), ("x.bin", "file_created", "c.toml"), ("concepts/registry.md", "file_renamed", "r.yml")}
    assert values(spark, lambda c: files.scope_of(c, F.lit(False)), ["/x/hubs.yml", "/y/rules.py", "/z/a.md"]) == ["config", "rules", "unknown"]
    events = spark.createDataFrame([(1, "p", "file_created", 10), (2, "p", "file_modified", 30), (3, "p", "file_deleted", 0), (4, "q", "file_deleted", 5)], "seq int, path string, kind string, size long")
    assert {r.seq: r.bytes_erased for r in files.with_erasure(events).collect()} == {1: 0, 2: 0, 3: 30, 4: 0}
    state = spark.createDataFrame([("p", 10), ("z", 1)], "path string, size long")
    assert {tuple(r) for r in files.incremental(state, events).collect()} == {("z", 1)}


def test_guard():
    ok = "SELECT name FROM notes WHERE t = 'set; drop' -- create\nLIMIT 10"
    assert guard.checked(ok, "Orient") == ok
    for sql, intent in ((ok, "other"), ("SELECT 1", "trace"), ("CREATE TABLE x AS SELECT 1 LIMIT 1", "trace"), ("SELECT 1 LIMIT 10; SELECT 2 LIMIT 1", "trace"), ("SELECT 1 LIMIT 501", "trace"), ("WITH x AS (SELECT 1) INSERT INTO y SELECT 1 LIMIT 1", "trace")):
        with pytest.raises(ValueError):
            guard.checked(sql, intent)
    for hops in (0, 7):
        with pytest.raises(ValueError):
            guard.checked(ok, "trace", hops)


def test_show(spark):
    ms = spark.createDataFrame([(None,), (12.0,), (1500.0,), (125000.0,)], "v double").select(show.duration(F.col("v"))).collect()
    assert [r[0] for r in ms] == ["-", "12ms", "1.5s", "2m 05s"]
    assert values(spark, lambda c: show.truncated_to(c, 8), ["short", "much too long"]) == ["short", "much ..."]
    assert values(spark, show.note_name, ["[[a/x.md|Name]]", "[[a/x.md]]", " plain ", None]) == ["Name", "x", "plain", None]
    now = F.lit("2020-01-01").cast("timestamp")
    assert values(spark, lambda c: show.coerced_date(c, now).cast("date"), ["2024-05-06", "1970-01-01", "bad", None]) == [dt.date(2024, 5, 6), dt.date(2020, 1, 1), dt.date(2020, 1, 1), dt.date(2020, 1, 1)]


def test_highlight(spark):
    texts = spark.createDataFrame([(1, "keep a b keep " + "x " * 40 + "keeper seam"), (2, "none"), (3, None), (4, ""), (5, "seam")], "k int, t string")
    assert {tuple(r) for r in best_window(texts, "k", "t", ["keep", "seam"]).collect()} == {(1, 45, 2), (5, 1, 1)}
    assert values(spark, lambda c: marked(c, ["sea", "seam+"]), ["Seamless sea, undersea seam+x"]) == ["<mark>Seamless</mark> <mark>sea</mark>, undersea <mark>seam+x</mark>"]
    assert search_terms("one two three") == ["one two three", "one two", "three", "one", "two"]
