"""Queries over the documents: markdown structure, signals, terms, search, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import signals as sg
from vaultweave.operators import texts
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
_W = r"[^\pL\pN_]"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *columns)


@query(
    f"""SELECT doc_id, link, count(*) AS n FROM (
      SELECT doc_id, trim(lower(unnest(regexp_extract_all(text, '{_LINK}', 1)))) AS link FROM documents) GROUP BY 1, 2"""
)
def md_link_counts(spark, sf):
    """Occurrences of each wikilink target per document."""
    found = docs(spark, sf, "text").select("doc_id", F.explode(md.link_occurrences(F.col("text"))).alias("raw"))
    return found.groupBy("doc_id", F.trim(F.lower("raw")).alias("link")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH o AS (SELECT doc_id, regexp_extract_all(text, '{_LINK}', 1) AS ls FROM documents WHERE text IS NOT NULL),
      e AS (SELECT doc_id, trim(lower(ls[i])) AS link, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM o)),
      f AS (SELECT doc_id, link, min(i) AS i FROM e GROUP BY 1, 2)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS pos, link FROM f"""
)
def md_links(spark, sf):
    """Wikilink targets, each once per document, in order of first mention."""
    return docs(spark, sf, "text").select("doc_id", F.posexplode(md.links(F.col("text"))).alias("p", "link")).select("doc_id", (F.col("p") + 1).alias("pos"), "link")


@query(
    r"""SELECT heading, count(*) AS n_documents FROM (
      SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?m)^## ([^\r\n]+)', 1)) AS heading FROM documents) GROUP BY 1"""
)
def md_headings(spark, sf):
    """In how many documents each second-level heading stands."""
    return docs(spark, sf, "text").select(F.explode(md.headings(F.col("text"))).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    r"""SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)), ''), 'note-' || doc_id) AS title FROM documents"""
)
def md_titles(spark, sf):
    """Title of each document: its first heading, else its name."""
    return docs(spark, sf, "text").select("doc_id", md.title(F.col("text"), F.concat(F.lit("note-"), F.col("doc_id"))).alias("title"))


_SECTION = r"""trim(split_part(chr(10) || regexp_extract(text, '(?ms)^## {h}[ \t\r]*\n(.*)', 1), chr(10) || '## ', 1), ' ' || chr(9) || chr(10) || chr(13))"""


@query(
    rf"""SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, {_SECTION.format(h='Definition')} AS s FROM documents
      WHERE regexp_matches(text, '(?ms)^## Definition[ \t\r]*\n'))"""
)
def md_section_strict(spark, sf):
    """The definition section of each document that has one."""
    found = docs(spark, sf, "text").select("doc_id", md.section_strict(F.col("text"), "Definition").alias("s")).where("s is not null")
    return found.select("doc_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query(
    r"""SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, CASE WHEN contains(lower(text), '## open points')
      THEN trim(split_part(substr(text, instr(lower(text), '## open points') + 14), chr(10) || '## ', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END AS s
      FROM documents WHERE text IS NOT NULL)"""
)
def md_section_loose(spark, sf):
    """The section on open points, found wherever its heading stands."""
    found = docs(spark, sf, "text").select("doc_id", md.section_loose(F.col("text"), "## Open points").alias("s")).where("s is not null")
    return found.select("doc_id", F.length("s").cast("long").alias("n_chars"), F.md5("s").alias("digest"))


@query(
    rf"""WITH s AS (SELECT doc_id, {_SECTION.format(h='Structural dependencies')} AS s FROM documents WHERE regexp_matches(text, '(?ms)^## Structural dependencies[ \t\r]*\n'))
    SELECT DISTINCT doc_id, trim(lower(unnest(regexp_extract_all(s, '{_LINK}', 1)))) AS dep FROM s
    WHERE NOT (contains(lower(s), 'none') AND (contains(lower(s), 'primitive') OR contains(lower(s), 'axiomatic')))"""
)
def md_structural_deps(spark, sf):
    """Structural dependencies a document declares."""
    return docs(spark, sf, "text").select("doc_id", F.explode(md.structural_dependencies(F.col("text"))).alias("dep"))


@query(
    r"""WITH b AS (SELECT doc_id, nullif(regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---', 1), '') AS b FROM documents)
    SELECT doc_id, nullif(trim(regexp_extract(b, '(?m)^role:[ \t]*([^\r\n]*)', 1)), '') AS role, nullif(trim(regexp_extract(b, '(?m)^layer:[ \t]*([^\r\n]*)', 1)), '') AS layer,
      CAST(len(regexp_extract_all(coalesce(regexp_extract(b, '(?m)^depends_on:[ \t]*([^\r\n]*)', 1), ''), '\[\[([^\]|#]+)', 1)) AS BIGINT) AS n_depends
    FROM b WHERE b IS NOT NULL"""
)
def md_front_matter(spark, sf):
    """Role, layer and number of dependencies in the front matter."""
    block = docs(spark, sf, "text").select("doc_id", md.front_matter(F.col("text")).alias("b")).where("b is not null")
    deps = F.size(F.regexp_extract_all(F.coalesce(md.front_matter_field(F.col("b"), "depends_on"), F.lit("")), F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))
    return block.select("doc_id", md.front_matter_field(F.col("b"), "role").alias("role"), md.front_matter_field(F.col("b"), "layer").alias("layer"), deps.cast("long").alias("n_depends"))


@query(
    r"""SELECT tag, count(*) AS n_documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|\s)#([\pL\pN_/-]+)', 1)) AS tag FROM documents)
    WHERE NOT regexp_matches(tag, '^[0-9/]+$') GROUP BY 1"""
)
def md_tags(spark, sf):
    """Inline tags and in how many documents each stands."""
    return docs(spark, sf, "text").select(F.explode(md.inline_tags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    r"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
      t AS (SELECT doc_id, line, rtrim(ls[line], chr(13)) AS text, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l
            WHERE regexp_matches(rtrim(ls[line], chr(13)), '^\s*\|.*\|\s*$')),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY line) AS k, count(*) OVER (PARTITION BY doc_id, run) AS n,
            len(string_split(trim(trim(text), '|'), '|')) AS arity FROM t),
      h AS (SELECT *, first_value(arity) OVER (PARTITION BY doc_id, run ORDER BY line) AS head FROM r)
    SELECT doc_id, CAST(line AS INTEGER) AS line, trim(string_split(trim(trim(text), '|'), '|')[1]) AS first_cell, CAST(arity AS INTEGER) AS arity FROM h WHERE n >= 3 AND k > 2 AND arity = head"""
)
def md_tables(spark, sf):
    """Rows of markdown tables (three lines at least) that have as many cells as their header."""
    return texts.table_rows(docs(spark, sf, "text")).select("doc_id", "line", F.element_at("cells", 1).alias("first_cell"), F.size("cells").alias("arity"))


@query(
    r"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
      m AS (SELECT doc_id, line, ls[line] AS t, sum(CASE WHEN ls[line] LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM l),
      n AS (SELECT doc_id, line, t, first_value(t) OVER (PARTITION BY doc_id, s ORDER BY line) AS head FROM m WHERE s > 0),
      e AS (SELECT doc_id, line, trim(lower(unnest(regexp_extract_all(t, '\[\[([^\]|#]+)', 1)))) AS link FROM n WHERE regexp_matches(head, '^## Structural dependencies\s*$'))
    SELECT doc_id, link, CAST(max(line) AS INTEGER) AS line FROM e GROUP BY 1, 2"""
)
def md_dependency_lines(spark, sf):
    """The last line of the dependency section on which each target stands."""
    return docs(spark, sf, "text").select("doc_id", F.explode(md.dependency_lines(F.col("text"))).alias("link", "line"))


@query(
    r"""WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\s+', ' ', 'g'), '\.\s') AS ss FROM documents WHERE text IS NOT NULL),
      e AS (SELECT doc_id, i, ss[i] AS raw, CASE WHEN ends_with(ss[i], '.') THEN ss[i] ELSE ss[i] || '.' END AS dot FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
      c AS (SELECT *, sum(length(dot)) OVER w + i - 1 AS upto, min(CASE WHEN raw = '' THEN i ELSE 999999999 END) OVER (PARTITION BY doc_id) AS blank FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      k AS (SELECT doc_id, string_agg(dot, ' ' ORDER BY i) AS d FROM c WHERE i < blank AND (i = 1 OR upto <= 150) GROUP BY 1)
    SELECT s.doc_id, CASE WHEN length(d) > 300 THEN substr(d, 1, 300) || '...' ELSE coalesce(d, '') END AS description FROM s LEFT JOIN k USING (doc_id)"""
)
def md_descriptions(spark, sf):
    """Summary of each document from its first sentences."""
    return docs(spark, sf, "text").where("text is not null").select("doc_id", md.description(F.col("text")).alias("description"))


@query(
    r"""SELECT doc_id, CAST(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 200.0) AS BIGINT) AS minutes FROM documents WHERE text IS NOT NULL"""
)
def md_reading_time(spark, sf):
    """Minutes to read each document."""
    return docs(spark, sf, "text").where("text is not null").select("doc_id", md.reading_minutes(F.col("text")).alias("minutes"))


@query(
    r"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
      h AS (SELECT doc_id, line, length(regexp_extract(ls[line], '^(#{1,3}) ', 1)) AS depth, trim(regexp_extract(ls[line], '^#{1,3} +([^\r\n]*)', 1)) AS text FROM l WHERE regexp_matches(ls[line], '^#{1,3} +[^ \r\n]')),
      g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, depth - min(depth) OVER (PARTITION BY doc_id) AS rel,
            replace(regexp_replace(lower(text), '[^\pL\pN_ -]', '', 'g'), ' ', '-') AS base FROM h)
    SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(rel AS INTEGER) AS depth, text,
      base || CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY line) > 1 THEN '-' || (row_number() OVER (PARTITION BY doc_id, base ORDER BY line) - 1) ELSE '' END AS slug
    FROM g WHERE n > 1"""
)
def md_toc(spark, sf):
    """Table of contents: headings to depth 3 of documents with more than one, anchors made unique."""
    return texts.contents(docs(spark, sf, "text"))


_RUNS = r"list_filter(regexp_extract_all(lower(text), '[\pL\pN_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"


@query(f"""SELECT word, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_RUNS}) AS word FROM documents) GROUP BY 1""")
def text_word_counts(spark, sf):
    """Document and term frequency of every word."""
    return texts.word_counts(docs(spark, sf, "text"))


def _in(lexicon) -> str:
    return "[" + ", ".join(f"'{w}'" for w in lexicon) + "]"


# The lists as the check has them, written out so that an error in the code's lists shows.
_VERBS = {
    "state": "remains persists exists is are was were stays continues remain persist exist stay continue",
    "action": "removes constrains eliminates narrows forecloses reduces blocks prevents restricts remove constrain eliminate narrow foreclose reduce block prevent restrict",
    "modal": "can cannot must may might should could would requires require",
    "causal": "causes produces transforms converts creates generates leads results cause produce transform convert create generate lead result",
}


@query(
    "SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(w, lambda x: list_contains({_in(v.split())}, x))) AS INTEGER) AS {k}_verbs" for k, v in _VERBS.items()) + f" FROM (SELECT doc_id, {_RUNS} AS w FROM documents WHERE text IS NOT NULL)"
)
def text_verb_profile(spark, sf):
    """How many verbs of each class a document has."""
    return docs(spark, sf, "text").where("text is not null").select("doc_id", *[sg.count_words(F.col("text"), v).alias(f"{k}_verbs") for k, v in sg.VERBS.items()])


def _phrase(p: str) -> str:
    return f"len(regexp_extract_all(t, '(?:^|{_W}){p}(?:{_W}|$)'))"


_SPACED = r"regexp_replace(lower(text), '([^\pL\pN_])', '\1\1', 'g')"


def _sum(phrases, bounded=True) -> str:
    # Every separator is doubled, so that neighbouring matches never share one.
    return "CAST(" + " + ".join(_phrase(p.replace(" ", "  ").replace("-", "--")) if bounded else f"len(regexp_extract_all(lower(text), '{p}'))" for p in phrases) + " AS INTEGER)"


@query(
    f"""SELECT doc_id, {_sum(['not', 'does not', 'is not', 'are not', 'do not', 'cannot', 'without', 'never'])} AS negations, {_sum(['requires?', 'expends?', 'pays?', 'burden', 'cost', 'effort'])} AS cost, {_sum(['local', 'boundary', 'inside', 'beyond', 'within'])} + CAST(len(regexp_extract_all(lower(text), 'non-local')) AS INTEGER) AS spatial, {_sum(['detected by', 'revealed when', 'test for', 'operationally', 'operational test'], False)} AS operational
    FROM (SELECT doc_id, text, {_SPACED} AS t FROM documents WHERE text IS NOT NULL)"""
)
def text_phrase_counts(spark, sf):
    """Negations and operational, cost and spatial phrases of each document."""
    t = F.col("text")
    return docs(spark, sf, "text").where("text is not null").select(
        "doc_id", sg.negations(t).alias("negations"), sg.count_phrases(t, sg.COST).alias("cost"), sg.spatial(t).alias("spatial"),
        sg.count_phrases(t, sg.OPERATIONAL, bounded=False).alias("operational"),
    )


@query(
    r"""WITH s AS (SELECT doc_id, trim(unnest(string_split_regex(text, '[.!?]+')), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM documents WHERE text IS NOT NULL),
      f AS (SELECT doc_id, s, ' ' || s || ' ' AS x FROM s)
    SELECT doc_id, count(*) AS n_sentences FROM f WHERE regexp_matches(x, '(?i)[^\pL\pN_](we|one|users?|systems?|agents?|operators?)\s+(should|must|require)')
      OR (NOT regexp_matches(x, '(?i)[^\pL\pN_](it|this|the\s+\w+)\s+(requires?|must)') AND regexp_matches(x, '(?i)[^\pL\pN_](should|must)[^\pL\pN_]') AND regexp_matches(x, '(?i)[^\pL\pN_](you|we|one)[^\pL\pN_]'))
    GROUP BY 1"""
)
def text_prescriptive(spark, sf):
    """How many prescriptive sentences a document has, where it has any."""
    found = docs(spark, sf, "text").select("doc_id", F.size(sg.prescriptive_sentences(F.col("text"))).cast("long").alias("n_sentences"))
    return found.where("n_sentences > 0")


@query(
    r"""WITH s AS (SELECT doc_id,
      CASE WHEN contains(lower(text), '## definition') THEN split_part(substr(text, instr(lower(text), '## definition') + 13), chr(10) || '## ', 1) ELSE '' END AS d,
      CASE WHEN contains(lower(text), '## what this is not') THEN trim(split_part(substr(text, instr(lower(text), '## what this is not') + 19), chr(10) || '## ', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END AS x FROM documents WHERE text IS NOT NULL),
      c AS (SELECT doc_id, len(regexp_extract_all(d, '[.!?]+')) AS a, len(regexp_extract_all(x, '(?mi)^-\s+Not\b')) AS b FROM s)
    SELECT doc_id, CAST(a AS INTEGER) AS sentences, CAST(b AS INTEGER) AS nots, CASE WHEN a + b > 0 THEN CAST(round_even(a / (a + b), 2) AS DOUBLE) ELSE 0.5 END AS ratio FROM c"""
)
def text_scope(spark, sf):
    """Scope of the definition of each document."""
    sentences, nots, ratio = sg.scope_metrics(F.col("text"))
    return docs(spark, sf, "text").where("text is not null").select("doc_id", sentences.alias("sentences"), nots.alias("nots"), ratio.cast("double").alias("ratio"))


# Words that are no terms.
STOP_WORDS = "the and for that this with from are was were not but has have had its it's you can into than then they their there which when while where what who will would".split()
_TOKENS = r"regexp_extract_all(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[a-zA-Z][a-zA-Z-]{2,}')"


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_transform({_TOKENS}, lambda x: lower(x))) AS token FROM documents),
      f AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE NOT list_contains({_in(w.replace("'", "''") for w in STOP_WORDS)}, token) GROUP BY 1, 2),
      d AS (SELECT token, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM f),
      s AS (SELECT doc_id, token, tf, df, tf * (1 + sqrt(n / (df + 1))) AS score FROM f JOIN d USING (token), n WHERE df BETWEEN 2 AND n * 0.5),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, token) AS rank FROM s)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, token, tf, df, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def text_term_scores(spark, sf):
    """The five terms that mark each document most: tf (1 + sqrt(N / (df + 1))), rare and common terms left out."""
    return texts.term_scores(docs(spark, sf, "text"), STOP_WORDS)


_CJK = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{20000}-\x{2a6df}"


@query(
    rf"""WITH f AS (SELECT doc_id, 'content' AS field, text AS t FROM documents
      UNION ALL SELECT doc_id, 'title', coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)), ''), 'note-' || doc_id) FROM documents
      UNION ALL SELECT doc_id, 'tags', array_to_string(list_filter(list_distinct(regexp_extract_all(text, '(?:^|\s)#([\pL\pN_/-]+)', 1)), lambda x: NOT regexp_matches(x, '^[0-9/]+$')), ' ') FROM documents)
    SELECT field, token, doc_id, count(*) AS n FROM (SELECT field, doc_id, unnest(regexp_extract_all(lower(t), '[{_CJK}]|[^ \t\r\n{_CJK}]+')) AS token FROM f) GROUP BY 1, 2, 3"""
)
def search_index(spark, sf):
    """Postings of the search index: every token of each document's title, content and tags, and how often it stands there."""
    text = F.col("text")
    fields = {"title": md.title(text, F.concat(F.lit("note-"), F.col("doc_id"))), "content": text, "tags": F.array_join(md.inline_tags(text), " ")}
    return texts.postings(docs(spark, sf, "text"), fields)


@query(r"""SELECT doc_id, sha256(text) AS content_id FROM documents WHERE text IS NOT NULL""")
def content_hashes(spark, sf):
    """Content address of each text."""
    return docs(spark, sf, "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_id"))


@query(
    r"""SELECT sha256(text) AS content_id, min(doc_id) AS first_doc, count(*) AS copies, substr(sha256(text), 1, 2) AS shard FROM documents WHERE text IS NOT NULL GROUP BY 1, 4"""
)
def content_store(spark, sf):
    """The content store: one blob per content address, with its shard and its first document."""
    hashed = docs(spark, sf, "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_id"))
    return hashed.groupBy("content_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).withColumn("shard", F.substr("content_id", F.lit(1), F.lit(2)))


@query(
    r"""SELECT coalesce(source, '') AS source, lower(coalesce(lang, '')) AS lang, count(*) AS n, count(text) AS filled, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1, 2"""
)
def docs_by_source(spark, sf):
    """Documents by source and language with the usual footers: filled, sum, average."""
    keys = [F.coalesce("source", F.lit("")).alias("source"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang")]
    return table(spark, sf, "documents").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("filled"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


def _search(spark, sf, prefix: str, fields: tuple[str, ...]) -> DataFrame:
    from vaultweave.operators.search import prefix_search

    named = docs(spark, sf, "text", "lang", "source").select("doc_id", md.title(F.col("text"), F.concat(F.lit("note-"), F.col("doc_id"))).alias("title"), F.col("text").alias("content"))
    return prefix_search(named, prefix, fields, "doc_id", limit=8)


_HIT = r"len(list_filter(regexp_extract_all(lower({f}), '[{c}]|[^ \t\r\n{c}]+'), lambda x: starts_with(x, '{q}'))) > 0"


@query(
    rf"""WITH d AS (SELECT doc_id, coalesce(nullif(trim(regexp_extract(text, '(?m)^# ([^\r\n]*)', 1)), ''), 'note-' || doc_id) AS title, text FROM documents),
      t AS (SELECT doc_id, 0 AS field, row_number() OVER (ORDER BY doc_id) AS k FROM d WHERE {_HIT.format(f='title', c=_CJK, q='harb')}),
      c AS (SELECT doc_id, 1 AS field, row_number() OVER (ORDER BY doc_id) AS k FROM d WHERE {_HIT.format(f='text', c=_CJK, q='harb')}),
      u AS (SELECT doc_id, min(field) AS field FROM (SELECT * FROM t WHERE k <= 8 UNION ALL SELECT * FROM c WHERE k <= 8) GROUP BY 1)
    SELECT doc_id, CAST(field AS INTEGER) AS field, CAST(row_number() OVER (ORDER BY field, doc_id) AS INTEGER) AS rank FROM u"""
)
def search_prefix(spark, sf):
    """Full-text prefix search: titles first, then content, eight of each."""
    return _search(spark, sf, "harb", ("title", "content"))
