"""Tables out of texts (doc_id, text): markdown tables, contents, word counts, term scores, postings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import signals as sg
from vaultweave.session import written


def numbered_lines(docs: DataFrame, like: str | None = None) -> DataFrame:
    """(doc_id, line, text) with lines from 1, only those that match ``like`` if given; texts without any are not cut."""
    near = docs if like is None else docs.where(F.col("text").rlike(f"(?m){like}"))
    lines = near.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).alias("line"), F.rtrim(F.col("t"), F.lit("\r")).alias("text"))
    return lines if like is None else lines.where(F.col("text").rlike(like))


def table_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line, cells, row): rows of markdown tables of three lines at least that have as many cells as their header; ``row`` maps its cells to theirs.

    Of header cells that say the same the last counts.
    """
    lines = numbered_lines(docs.where(F.col("text").contains("|")), r"^\s*\|.*\|\s*$")
    order = Window.partitionBy("doc_id").orderBy("line")
    cells = F.transform(F.split(F.btrim(F.trim("text"), F.lit("|")), r"\|"), lambda c: F.trim(c))
    runs = lines.withColumn("run", F.col("line") - F.row_number().over(order)).withColumn("cells", cells)
    within = Window.partitionBy("doc_id", "run").orderBy("line")
    marked = runs.select("doc_id", "line", "cells", F.row_number().over(within).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("doc_id", "run")).alias("n"), F.first("cells").over(within).alias("head"))
    kept = marked.where((F.col("n") >= 3) & (F.col("k") > 2) & (F.size("cells") == F.size("head")))
    last = F.transform(F.array_distinct("head"), lambda h: F.element_at(F.filter(F.arrays_zip("head", "cells"), lambda x: x["head"] == h), -1)["cells"])
    return kept.select("doc_id", "line", "cells", F.map_from_arrays(F.array_distinct("head"), last).alias("row"))


def contents(docs: DataFrame, depth: int = 3, more_than: int = 1) -> DataFrame:
    """(doc_id, line, depth, text, slug): headings to ``depth`` of texts with more than ``more_than``, from the highest there is, anchors made unique."""
    lines = numbered_lines(docs, rf"^#{{1,{depth}}} +[^ \r\n]")
    heads = lines.select("doc_id", "line", F.length(F.regexp_extract("text", rf"^(#{{1,{depth}}}) ", 1)).alias("d"), F.trim(F.regexp_extract("text", rf"^#{{1,{depth}}} +([^\r\n]*)", 1)).alias("text"))
    doc = Window.partitionBy("doc_id")
    marked = heads.select("doc_id", "line", "text", F.count(F.lit(1)).over(doc).alias("n"), (F.col("d") - F.min("d").over(doc)).alias("depth"), md.heading_slug(F.col("text")).alias("base")).where(F.col("n") > more_than)
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("line")) - 1
    return marked.withColumn("again", again).select("doc_id", "line", "depth", "text", F.concat("base", F.when(F.col("again") > 0, F.concat(F.lit("-"), F.col("again"))).otherwise(F.lit(""))).alias("slug"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, df, tf): in how many texts each word stands and how often."""
    per = docs.select("doc_id", F.explode(sg.words(F.col("text"))).alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


def terms(text: Column) -> Column:
    """The terms of a text: runs of letters and hyphens of three at least in lower case, code fences left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?s)```.*?```", " ")), F.lit("[a-z][a-z-]{2,}"), F.lit(0))


def term_scores(docs: DataFrame, stop: Sequence[str], top: int = 5, least: int = 2, most_share: float = 0.5) -> DataFrame:
    """(doc_id, rank, token, tf, df, score): the ``top`` terms that mark each text most, by tf (1 + sqrt(N / (df + 1))).

    Terms in fewer than ``least`` texts or more than ``most_share`` of them are left out; N counts texts with any term.
    """
    tokens = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("token"))
    tf = written(tokens.where(~F.col("token").isin(list(stop))).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf")), "terms")
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct("doc_id").alias("n"))
    scored = tf.join(df, "token").join(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= F.col("n") * most_share))
    scored = scored.withColumn("score", F.col("tf") * (1 + F.sqrt(F.col("n") / (F.col("df") + 1))))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("doc_id", "rank", "token", "tf", "df", F.round("score", 6).alias("score"))


def postings(docs: DataFrame, fields: Mapping[str, Column], key: str = "doc_id") -> DataFrame:
    """(field, token, key, n): the search index: every token of each field of each text, and how often it stands there."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), of.alias("of")) for name, of in fields.items()])).alias("x")
    tokens = docs.select(key, each).select(F.col("x.field").alias("field"), key, F.explode(sg.search_tokens(F.col("x.of"))).alias("token"))
    return tokens.groupBy("field", "token", key).agg(F.count(F.lit(1)).alias("n"))


def ghost_terms(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(term, documents): terms between back-ticks that no known name (term) stands for."""
    spans = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([^`\r\n]{2,60})`"), F.lit(1))).alias("raw")).select("doc_id", F.lower(F.trim("raw")).alias("term")).where("term <> ''")
    return spans.join(known.select("term").distinct(), "term", "left_anti").groupBy("term").agg(F.count_distinct("doc_id").alias("documents"))
