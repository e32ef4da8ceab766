import re
from collections import Counter

from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import signals as sg
from vaultweave.functions import slugs


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_markdown(spark):
    t = "---\nrole: concept\nlayer: primitive\n---\n# Title\r\n\n## Structural dependencies\n- [[B-Note#x|b]]\n- [[a]] [[A]]\n\n## Definition\nText (one). Two.\n## Definition\nagain\n#tag/x #12 a#b\n"
    r = one(
        spark, t, md.links(F.col("t")), md.headings(F.col("t")), md.title(F.col("t"), F.lit("n")), md.section_strict(F.col("t"), "Definition"), md.section_strict(F.col("t"), "None"),
        md.section_loose(F.col("t"), "## definition"), md.structural_dependencies(F.col("t")), md.front_matter_field(md.front_matter(F.col("t")), "layer"), md.inline_tags(F.col("t")),
    )
    assert list(r) == [["b-note", "a"], ["Structural dependencies", "Definition"], "Title", "Text (one). Two.", None, "Text (one). Two.", ["b-note", "a"], "primitive", ["tag/x"]]
    assert one(spark, "## Structural dependencies\nNone (primitive) [[x]]", md.structural_dependencies(F.col("t")))[0] == []
    assert one(spark, None, md.links(F.col("t")), md.section_loose(F.col("t"), "x"), md.reading_minutes(F.col("t")))[:] == ([], None, None)
    assert one(spark, "One. Two and more. " + "x" * 400 + ". End", md.description(F.col("t")))[0] == "One. Two and more."
    assert one(spark, "y" * 400, md.description(F.col("t")))[0] == "y" * 300 + "..."


def test_signals(spark):
    t = "It does not remain. We must act. This requires cost; it cannot burden für not_x."
    r = one(spark, t, sg.negations(F.col("t")), sg.count_words(F.col("t"), sg.MODAL_VERBS), sg.count_phrases(F.col("t"), sg.COST), sg.prescriptive_sentences(F.col("t")), sg.words(F.col("t")))
    assert r[0] == 3 and r[1] == 3 and r[2] == 3 and r[3] == ["We must act"] and "f" not in r[4] and "not_x" not in r[4]
    assert list(one(spark, "no sections", *sg.scope_metrics(F.col("t")))) == [0, 0, 0.5]


def test_search_tokens(spark):
    cases = {"Hello WORLD Test": ["hello", "world", "test"], "hello\tworld\ntest": ["hello", "world", "test"], "日本語": ["日", "本", "語"], "これはtest文章です": list("これは") + ["test"] + list("文章です"), "hello 안녕 world": ["hello", "안", "녕", "world"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", sg.search_tokens(F.col("t")).alias("v")).collect()} == cases


def test_slugs(spark):
    cases = {
        "content/index.md": "content/index", "content/_index.md": "content/index", "/content/index.md": "content/index", "content/cool.png": "content/cool.png", "note with spaces.md": "note-with-spaces",
        "notes.with.dots.md": "notes.with.dots", "test/special chars?.md": "test/special-chars", "test/special chars #3.md": "test/special-chars-3", "cool/what about r&d?.md": "cool/what-about-r-and-d",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.s for r in df.select("p", slugs.slugify_path(F.col("p")).alias("s")).collect()} == cases
    simple = {"index": "/", "abc": "abc", "abc/index": "abc/", "abc/def": "abc/def"}
    df = spark.createDataFrame([(k,) for k in simple], "p string")
    assert {r.p: r.s for r in df.select("p", slugs.simplify_slug(F.col("p")).alias("s")).collect()} == simple
    assert one(spark, "a/b/c", slugs.segment_prefixes(F.col("t")), slugs.folder(F.col("t")), slugs.relative(F.lit("a/b/c"), F.lit("x")))[:] == (["a", "a/b", "a/b/c"], "a/b", "../../x")
    assert one(spark, "n10b2", slugs.natural_key(F.col("t")))[0] > one(spark, "n9b2", slugs.natural_key(F.col("t")))[0]


def test_search_index_has_every_token(spark, small):
    from vaultweave.plans.text import search_index
    from vaultweave.session import table

    want = Counter()
    for r in table(spark, small, "documents").collect():
        want.update(("content", t, r.doc_id) for t in re.findall(r"[぀-ゟ゠-ヿ一-鿿가-힯]|[^ \t\r\n぀-ゟ゠-ヿ一-鿿가-힯]+", (r.text or "").lower()))
    got = {(r.field, r.token, r.doc_id): r.n for r in search_index(spark, small).collect()}
    assert {k: n for k, n in got.items() if k[0] == "content"} == dict(want)
    assert {k[0] for k in got} == {"title", "content", "tags"}
    assert {k[2] for k in got if k[0] == "title"} == {r.doc_id for r in table(spark, small, "documents").collect()}
