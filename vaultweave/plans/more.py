"""Further queries: tag search, highlights, packs, traces, content index, event summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.operators import graph as g
from vaultweave.operators.highlight import best_window
from vaultweave.operators.search import tag_search, tag_text_search
from vaultweave.plans.graph import _ORG, organisation
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TAG = r"unnest(regexp_extract_all(text, '(?:^|\s)#([\pL\pN_/-]+)', 1))"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(md.inline_tags(F.col("text"))).alias("tag"))


@query(
    f"""WITH t AS (SELECT DISTINCT doc_id, {_TAG} AS tag FROM documents), h AS (SELECT DISTINCT doc_id FROM t WHERE starts_with(lower(tag), 'd') AND NOT regexp_matches(tag, '^[0-9/]+$') ORDER BY doc_id LIMIT 8)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM h"""
)
def search_tag(spark, sf):
    """Documents with a tag that begins so."""
    return tag_search(_tags(spark, sf), "d", "doc_id")


@query(
    f"""WITH t AS (SELECT DISTINCT doc_id, {_TAG} AS tag FROM documents), g AS (SELECT DISTINCT doc_id FROM t WHERE lower(tag) = 'draft'),
      h AS (SELECT doc_id FROM documents JOIN g USING (doc_id) WHERE len(list_filter(regexp_extract_all(lower(text), '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]|[^ \\t\\r\\n\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7af}}]+'), lambda x: starts_with(x, 'keep'))) > 0 ORDER BY doc_id LIMIT 8)
    SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM h"""
)
def search_tag_text(spark, sf):
    """Documents with a tag among those that match a text."""
    return tag_text_search(table(spark, sf, "documents").select("doc_id", "text"), _tags(spark, sf), "draft", "keep", ["text"], "doc_id")


@query(
    r"""WITH w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)),
      s AS (SELECT doc_id, p, sum(CASE WHEN starts_with(ws[p], 'keep') OR starts_with(ws[p], 'seam') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hits FROM w),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p DESC) AS k FROM s WHERE hits > 0)
    SELECT doc_id, CAST(p AS INTEGER) AS at, CAST(hits AS BIGINT) AS hits FROM r WHERE k = 1"""
)
def highlight_windows(spark, sf):
    """The thirty words of each document that show most of a search."""
    return best_window(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ["keep", "seam"])


@query(
    f"""WITH RECURSIVE {_ORG}, c AS (SELECT 'part-9' AS node, 0 AS hops UNION SELECT o.dst, c.hops + 1 FROM c JOIN org o ON o.src = c.node), m AS (SELECT node, min(hops) AS hops FROM c GROUP BY 1),
      v AS (SELECT node, 0 AS level FROM m WHERE starts_with(node, 'region') UNION SELECT o.src, v.level + 1 FROM v JOIN org o ON o.dst = v.node WHERE o.src IN (SELECT node FROM m)), x AS (SELECT node, max(level) AS level FROM v GROUP BY 1)
    SELECT node, CAST(level AS INTEGER) AS level, CASE WHEN hops = 0 THEN 'itself' WHEN hops = 1 THEN 'direct' ELSE 'transitive' END AS reason, CAST(row_number() OVER (ORDER BY level, node) AS INTEGER) AS place FROM x JOIN m USING (node)"""
)
def pack_of_part(spark, sf):
    """Part 9 with all it depends on, dependencies first, and why each is there."""
    found = g.pack(organisation(spark, sf), spark.createDataFrame([("part-9",)], "node string"))
    return found.withColumn("place", F.col("place").cast("int"))


@query(
    r"""SELECT doc_id, length(j) AS n_chars, md5(j) AS digest FROM (SELECT doc_id, '{"slug":"documents/' || doc_id || '","title":' || to_json(coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)), ''), 'note-' || doc_id)) || ',"size":' || n_chars || '}' AS j FROM documents)"""
)
def content_index(spark, sf):
    """The entry of each document in the content index."""
    d = table(spark, sf, "documents")
    title = md.title(F.col("text"), F.concat(F.lit("note-"), F.col("doc_id")))
    entry = F.to_json(F.struct(F.concat(F.lit("documents/"), F.col("doc_id")).alias("slug"), title.alias("title"), F.col("n_chars").alias("size")))
    return d.select("doc_id", F.length(entry).cast("long").alias("n_chars"), F.md5(entry).alias("digest"))


@query(
    """SELECT kind, split_part(path, '/', 1) AS scope, count(*) AS n, count(removed) AS removed, min(created) AS first_at, max(coalesce(removed, modified, created)) AS last_at FROM notes GROUP BY 1, 2"""
)
def file_events(spark, sf):
    """Notes by kind and scope, with how many were removed and when they were touched first and last."""
    return table(spark, sf, "notes").groupBy("kind", F.substring_index("path", "/", 1).alias("scope")).agg(
        F.count(F.lit(1)).alias("n"), F.count("removed").alias("removed"), F.min("created").alias("first_at"), F.max(F.coalesce("removed", "modified", "created")).alias("last_at")
    )


@query(
    """WITH m AS (SELECT vault, date_trunc('month', exported_at) AS month, count(*) AS n FROM papers GROUP BY 1, 2)
    SELECT vault, strftime(month, '%Y-%m') AS month, n, n - lag(n) OVER (PARTITION BY vault ORDER BY month) AS growth FROM m WHERE vault IS NOT NULL"""
)
def exports_by_month(spark, sf):
    """Exports of each vault by month and the change against the month before."""
    per = table(spark, sf, "papers").where("vault is not null").groupBy("vault", F.date_format("exported_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("growth", F.col("n") - F.lag("n").over(Window.partitionBy("vault").orderBy("month")))
