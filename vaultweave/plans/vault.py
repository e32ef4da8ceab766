"""Rule, view and site queries over documents, notes, concepts and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions import slugs
from vaultweave.operators import resolve, rules, texts, views
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
_FM = r"regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---', 1)"
_BASE = rf"""d AS (SELECT doc_id, lower(note_kind) AS kind, nullif(trim(regexp_extract({_FM}, '(?m)^role:[ \t]*([^\r\n]*)', 1)), '') AS role,
    nullif(trim(regexp_extract({_FM}, '(?m)^layer:[ \t]*([^\r\n]*)', 1)), '') AS layer, text,
    regexp_extract_all(coalesce(regexp_extract({_FM}, '(?m)^depends_on:[ \t]*([^\r\n]*)', 1), ''), '{_LINK}', 1) AS deps FROM documents),
  l AS (SELECT DISTINCT doc_id, kind, trim(lower(unnest(regexp_extract_all(text, '{_LINK}', 1)))) AS link FROM d),
  n AS (SELECT lower(name) AS name, kind, layer FROM notes UNION SELECT name, 'concept', layer FROM concepts),
  al AS (SELECT lower(unnest(aliases)) AS alias, name AS canonical FROM concepts)"""


_RANKS = "WHEN 'primitive' THEN 0 WHEN 'foundational' THEN 0 WHEN 'first-order' THEN 1 WHEN 'mechanism' THEN 2 WHEN 'accounting' THEN 3 WHEN 'selector' THEN 4 WHEN 'failure-state' THEN 4 WHEN 'meta-analytical' THEN 4 ELSE 99 END"


def query(oracle: str | None = None, base: str = _BASE):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (f"WITH {base}{' ' if oracle.lstrip().startswith('SELECT') else ', '}" if base else "") + oracle
        return f

    return add


def vault(spark: SparkSession, sf: str) -> rules.Vault:
    """Documents as notes, resolved against the concepts and notes."""
    block = md.front_matter(F.col("text"))
    docs = table(spark, sf, "documents").withColumn("_b", block)
    notes = docs.select(
        F.col("doc_id").alias("note_id"), F.concat(F.lit("note-"), F.col("doc_id")).alias("name"), F.lower("note_kind").alias("kind"), md.front_matter_field(F.col("_b"), "role").alias("role"),
        md.front_matter_field(F.col("_b"), "layer").alias("layer"), F.lit(True).alias("canonical"), F.col("text").alias("content"), md.links(F.col("text")).alias("links"),
        md.links(F.coalesce(md.front_matter_field(F.col("_b"), "depends_on"), F.lit(""))).alias("deps"), F.array().cast("array<string>").alias("aliases"),
    )
    concepts = table(spark, sf, "concepts")
    own = table(spark, sf, "notes").select(F.lower("name").alias("name"), "kind", F.col("kind").alias("role"), "layer")
    names = own.unionByName(concepts.select("name", F.lit("concept").alias("kind"), "role", "layer")).groupBy("name").agg(F.min("kind").alias("kind"), F.min("role").alias("role"), F.min("layer").alias("layer"))
    aliases = concepts.select(F.explode("aliases").alias("alias"), F.col("name").alias("canonical")).select(F.lower("alias").alias("alias"), "canonical")
    return rules.Vault(notes, names, aliases)


def _rule(name: str) -> rules.Rule:
    return next(r for r in rules.BUILT_IN if r.id == name)


@query("SELECT CAST(doc_id AS VARCHAR) AS file, link FROM l WHERE link NOT IN (SELECT name FROM n) AND link NOT IN (SELECT alias FROM al)")
def rule_broken_link(spark, sf):
    """Links that name no note and no alias."""
    found = rules.run(vault(spark, sf), [_rule("broken-link")])
    return found.select("file", F.replace("message", F.lit("broken link to "), F.lit("")).alias("link"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, 'uses alias ' || link || ' for ' || canonical AS message FROM l JOIN al ON link = alias WHERE link <> canonical")
def rule_alias_drift(spark, sf):
    """Links that use an alias."""
    return rules.run(vault(spark, sf), [_rule("alias-drift")]).select("file", "message")


@query(
    """SELECT rule, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warning') AS warning, count(*) FILTER (WHERE level = 'info') AS info FROM (
      SELECT 'missing-dependencies' AS rule, 'error' AS level FROM d WHERE kind = 'concept' AND NOT contains(coalesce(text, ''), '## Structural dependencies')
      UNION ALL SELECT 'mechanism-missing-residuals', 'error' FROM d WHERE kind = 'concept' AND layer = 'mechanism' AND NOT contains(coalesce(text, ''), '## Residuals')
      UNION ALL SELECT 'missing-role', 'warning' FROM d WHERE role IS NULL
      UNION ALL SELECT 'broken-link', 'warning' FROM l WHERE link NOT IN (SELECT name FROM n) AND link NOT IN (SELECT alias FROM al)
      UNION ALL SELECT 'alias-drift', 'info' FROM l JOIN al ON link = alias WHERE link <> canonical
      UNION ALL SELECT 'responsibility-scope', 'info' FROM d WHERE kind IN ('diagnostic', 'projection') AND regexp_matches(lower(text), 'responsible for|responsibility for|who is responsible|is responsible') AND NOT contains(lower(text), 'scope:')) GROUP BY 1"""
)
def lint_counts(spark, sf):
    """Results of the note and link rules by level."""
    names = ["missing-dependencies", "mechanism-missing-residuals", "missing-role", "broken-link", "alias-drift", "responsibility-scope"]
    return rules.counts(rules.run(vault(spark, sf), [_rule(n) for n in names]))


@query(
    """r AS (SELECT 'governance' AS invariant, doc_id FROM d WHERE role IS NULL
      UNION ALL SELECT 'irreversibility', doc_id FROM d WHERE kind = 'concept' AND NOT contains(coalesce(text, ''), '## Structural dependencies')
      UNION ALL SELECT 'structural', doc_id FROM l JOIN al ON link = alias WHERE link <> canonical)
    SELECT i.invariant, i.rules, count(doc_id) AS violations, count(DISTINCT doc_id) AS files, CASE WHEN count(doc_id) = 0 THEN 'pass' ELSE 'fail' END AS status
    FROM (VALUES ('governance', 1::BIGINT), ('irreversibility', 1::BIGINT), ('structural', 1::BIGINT)) i(invariant, rules) LEFT JOIN r ON r.invariant = i.invariant GROUP BY 1, 2"""
)
def lint_by_invariant(spark, sf):
    """Results by invariant, those without violation included."""
    picked = [_rule(n) for n in ("missing-role", "missing-dependencies", "alias-drift")]
    return rules.by_invariant(rules.run(vault(spark, sf), picked), picked)


@query(
    rf"""e AS (SELECT doc_id, layer, trim(lower(unnest(deps))) AS dep FROM d WHERE kind = 'concept'), f AS (SELECT DISTINCT * FROM e),
      k AS (SELECT name, min(layer) AS dep_layer FROM n GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS file, 'depends on higher layer ' || dep AS message FROM f JOIN k ON k.name = f.dep
    WHERE CASE lower(dep_layer) {_RANKS} > CASE lower(f.layer) {_RANKS}"""
)
def rule_layers_of_notes(spark, sf):
    """Declared dependencies on a higher layer."""
    return rules.run(vault(spark, sf), [_rule("layer-violation")]).select("file", "message")


@query(
    r"""SELECT CAST(doc_id AS VARCHAR) AS file, h.heading FROM d, (VALUES ('Definition'), ('Residue')) h(heading) WHERE kind = 'concept'
      AND NOT list_contains(list_transform(regexp_extract_all(coalesce(text, ''), '(?m)^## ([^\r\n]+)', 1), lambda x: trim(x)), h.heading)"""
)
def rule_required_headings(spark, sf):
    """Headings a hub policy asks for and concepts lack."""
    rule = rules.Rule("hub-required-headings", "has_headings", {"headings": ["Definition", "Residue"]}, message="missing")
    found = rules.run(vault(spark, sf), [rule])
    return found.select("file", F.explode(F.split(F.replace("message", F.lit("missing: "), F.lit("")), ", ")).alias("heading"))


@query("SELECT CAST(l.doc_id AS VARCHAR) AS file, 'links to ' || l.link AS message FROM l WHERE l.kind = 'paper' AND l.link IN (SELECT name FROM n GROUP BY 1 HAVING min(kind) = 'concept')")
def rule_forbidden_edge(spark, sf):
    """Links of papers to concepts, taken as forbidden."""
    rule = rules.Rule("forbidden-edge", "forbidden_edge", {"source": "paper", "target": "concept"}, "warning")
    return rules.run(vault(spark, sf), [rule]).select("file", "message")


@query(
    """r AS (SELECT name, min(role) AS role FROM (SELECT lower(name) AS name, kind AS role FROM notes UNION ALL SELECT name, role FROM concepts) GROUP BY 1)
    SELECT CAST(l.doc_id AS VARCHAR) AS file, 'links to roles kept apart (' || string_agg(DISTINCT l.link, ', ' ORDER BY l.link) || ')' AS message FROM l JOIN r ON r.name = l.link WHERE l.kind = 'concept' AND r.role IN ('concept', 'projection') GROUP BY 1"""
)
def rule_outlinks_to_roles(spark, sf):
    """Concepts that link to concepts or projections, taken as roles kept apart."""
    rule = rules.Rule("apart", "outlinks_to_roles", {"roles": ["Concept", "projection "]})
    return rules.run(vault(spark, sf), [rule]).select("file", "message")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file, 'prescriptive tokens: ' || array_to_string(list_sort(list_filter(['must', 'nobody', 'should'], lambda t: contains(lower(text), t))), ', ') AS message FROM d
    WHERE kind = 'concept' AND len(list_filter(['must', 'nobody', 'should'], lambda t: contains(lower(text), t))) > 0"""
)
def rule_prescriptive_tokens(spark, sf):
    """Concepts whose text holds tokens kept out of them."""
    rule = rules.Rule("tokens", "prescriptive_tokens", {"tokens": ["should", "must", "nobody"]})
    return rules.run(vault(spark, sf), [rule]).select("file", "message")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS file, 'missing keys: ' || concat_ws(', ', CASE WHEN role IS NULL THEN 'role' END, CASE WHEN layer IS NULL THEN 'layer' END) AS message FROM d WHERE kind = 'concept' AND (role IS NULL OR layer IS NULL)"""
)
def rule_has_keys(spark, sf):
    """Concepts whose front matter lacks a role or a layer."""
    return rules.run(vault(spark, sf), [rules.Rule("keys", "has_keys", {"keys": ["role", "layer"]})]).select("file", "message")


# -- views -------------------------------------------------------------------------

CONCEPT_TOPOLOGY = views.View(["name", "layer", "vault"], filters=["kind = 'concept'"], group_by="layer", sort=["name"], footers={"name": "Filled"})
PRIMITIVES = views.View(["row_id", "concept", "layer", "links"], {"layer": "lower(layer)"}, any_of=["lower(layer) = 'primitive'", "lower(layer) = 'foundational'"], sort=["layer", "-links"], footers={"links": "Sum"})


@query("SELECT layer, count(*) AS n, count(name) AS name_filled FROM notes WHERE kind = 'concept' GROUP BY 1", base="")
def view_concept_topology(spark, sf):
    """Concepts by layer."""
    return views.footers(table(spark, sf, "notes"), CONCEPT_TOPOLOGY)


@query("SELECT row_id, concept, lower(layer) AS layer, links FROM primitives_and_foundational WHERE lower(layer) IN ('primitive', 'foundational')", base="")
def view_primitives(spark, sf):
    """Primitive and foundational concepts."""
    return views.rows(table(spark, sf, "primitives_and_foundational"), PRIMITIVES)


@query("SELECT count(*) AS n, CAST(sum(links_count) AS BIGINT) AS links_count_sum, round(avg(links_count), 6) AS links_count_average, count(DISTINCT vault) AS vault_unique FROM papers", base="")
def view_paper_footers(spark, sf):
    """Footers of the papers view."""
    papers = table(spark, sf, "papers").withColumn("links", F.col("links_count"))
    found = views.footers(papers, views.View(["paper"], footers={"links_count": "Sum", "links": "Average", "vault": "Unique"}))
    return found.select("n", "links_count_sum", F.round("links_average", 6).alias("links_count_average"), "vault_unique")


def _linked(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.lower("note_kind").alias("kind"), "source", md.links(F.col("text")).alias("links"), F.size(md.link_occurrences(F.col("text"))).alias("n_links"))


@query(rf"SELECT doc_id, kind FROM d WHERE len(coalesce(regexp_extract_all(text, '{_LINK}', 1), [])) = 0")
def view_orphans(spark, sf):
    """Documents that link to nothing."""
    return views.rows(_linked(spark, sf), views.View(["doc_id", "kind"], filters=["n_links = 0"]))


@query(rf"SELECT doc_id, CAST(k AS INTEGER) AS n_links FROM (SELECT doc_id, len(regexp_extract_all(text, '{_LINK}', 1)) AS k FROM d) WHERE k >= 20")
def view_high_link(spark, sf):
    """Documents with twenty links or more."""
    return views.rows(_linked(spark, sf), views.View(["doc_id", "n_links"], filters=["n_links >= 20"], sort=["-n_links"]))


_FLAGS = ["plateau", "yoke", "gated-seam", "nested-handover", "hidden-notch"]


@query("SELECT d.doc_id, " + ", ".join(f"CASE WHEN coalesce(bool_or(link = '{f}'), false) THEN 'yes' ELSE 'no' END AS {f.replace('-', '_')}" for f in _FLAGS) + " FROM d LEFT JOIN l ON l.doc_id = d.doc_id WHERE d.kind = 'domain' GROUP BY 1")
def view_coverage(spark, sf):
    """Which concepts each domain note links to."""
    flags = {f.replace("-", "_"): views.has_link("links", f) for f in _FLAGS}
    return views.rows(_linked(spark, sf), views.View(["doc_id", *flags], flags, filters=["kind = 'domain'"]))


@query(rf"SELECT kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_links_sum FROM (SELECT kind, len(coalesce(regexp_extract_all(text, '{_LINK}', 1), [])) AS k FROM d) GROUP BY 1")
def view_by_kind(spark, sf):
    """Documents and links by kind."""
    return views.footers(_linked(spark, sf), views.View(["kind"], group_by="kind", footers={"n_links": "Sum"}))


@query(
    """c AS (SELECT d.doc_id, count(*) FILTER (WHERE link IN ('plateau', 'yoke', 'gated-seam', 'nested-handover', 'hidden-notch')) AS hits FROM d LEFT JOIN l ON l.doc_id = d.doc_id WHERE d.kind = 'domain' GROUP BY 1)
    SELECT CAST(5 - hits AS INTEGER) AS missing, count(*) AS n FROM c GROUP BY 1"""
)
def audit_domain_gaps(spark, sf):
    """How many of five concepts the domain notes lack."""
    wide = view_coverage(spark, sf)
    missing = sum((F.when(F.col(f.replace("-", "_")) == "no", 1).otherwise(0) for f in _FLAGS), F.lit(0))
    return wide.groupBy(missing.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


# -- site ----------------------------------------------------------------------------


@query(r"""SELECT note_id, regexp_replace(regexp_replace(regexp_replace(trim(path, '/'), '\.md$', ''), '\s', '-', 'g'), '[?#]', '', 'g') AS slug FROM notes""", base="")
def note_slugs(spark, sf):
    """Slug of each note's path."""
    return table(spark, sf, "notes").select("note_id", slugs.slugify_path(F.col("path")).alias("slug"))


@query(r"""SELECT part_id AS p_partkey, replace(replace(replace(s, '&', '-and-'), '%', '-percent'), ' ', '-') AS slug FROM (SELECT p_partkey AS part_id, regexp_replace(p_name, '[?#]', '', 'g') AS s FROM part)""", base="")
def part_slugs(spark, sf):
    """Slug of each part's name."""
    return table(spark, sf, "part").select("p_partkey", slugs.slugify_path(F.col("p_name")).alias("slug"))


_TAGGED = "t AS (SELECT doc_id, lower(coalesce(lang, 'none')) || '/' || coalesce(source, 'none') || '/' || coalesce(vault, 'none') AS tag FROM documents), p AS (SELECT DISTINCT doc_id, array_to_string(list_slice(string_split(tag, '/'), 1, i), '/') AS prefix FROM t, range(1, 4) r(i))"


def _tags(spark, sf) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.concat_ws("/", F.lower(part("lang")), part("source"), part("vault")).alias("tag"))


@query(f"{_TAGGED} SELECT prefix, count(*) AS pages FROM p GROUP BY 1", base="x AS (SELECT 1)")
def tag_counts(spark, sf):
    """Pages by tag and every prefix of it."""
    return resolve.by_prefix(_tags(spark, sf), "tag")[0]


@query(f"{_TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY doc_id) AS k FROM p) SELECT prefix, doc_id AS page, CAST(k AS INTEGER) AS k FROM r WHERE k <= 10", base="x AS (SELECT 1)")
def tag_listings(spark, sf):
    """The first ten pages of each tag."""
    return resolve.by_prefix(_tags(spark, sf), "tag")[1].select("prefix", "page", "k")


@query("SELECT split_part(path, '/', 1) AS folder, count(*) AS pages, max(created) AS created, max(modified) AS modified FROM notes GROUP BY 1", base="")
def folder_latest(spark, sf):
    """Latest dates by folder."""
    return resolve.folder_dates(table(spark, sf, "notes"), "path", ["created", "modified"])


@query("SELECT DISTINCT path, CAST(i - 1 AS INTEGER) AS depth, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS crumb FROM notes, range(1, 3) r(i)", base="")
def breadcrumbs(spark, sf):
    """Chain of folders of each page."""
    return resolve.ancestry(table(spark, sf, "notes").select("path").distinct(), "path")


@query("SELECT link AS target, count(DISTINCT doc_id) AS sources, count(*) AS n FROM l GROUP BY 1")
def backlinks(spark, sf):
    """How many documents link to each target."""
    return resolve.backlinks(_linked(spark, sf).select(F.col("doc_id").alias("source"), F.explode("links").alias("target")))


@query("SELECT l.doc_id, l.link, coalesce(n.name, a.canonical) AS target FROM l LEFT JOIN (SELECT DISTINCT name FROM n) n ON n.name = l.link LEFT JOIN (SELECT alias, min(canonical) AS canonical FROM al GROUP BY 1) a ON a.alias = l.link")
def link_resolution(spark, sf):
    """What each link names: a note, an alias or nothing."""
    v = vault(spark, sf)
    return resolve.resolve_links(v.links.select(F.col("note_id").alias("doc_id"), "link"), v.names, v.aliases).select("doc_id", "link", "target")


@query(
    """s AS (SELECT regexp_replace(path, '\\.md$', '') AS slug FROM notes), u AS (SELECT split_part(slug, '/', -1) AS link, min(slug) AS slug, count(*) AS c FROM s GROUP BY 1)
    SELECT DISTINCT l.link, coalesce(u.slug, l.link) AS slug FROM l LEFT JOIN u ON u.link = l.link AND u.c = 1"""
)
def shortest_links(spark, sf):
    """Where each link leads by the only page of that file name."""
    pages = table(spark, sf, "notes").select(slugs.slugify_path(F.col("path")).alias("slug"))
    links = _linked(spark, sf).select(F.explode("links").alias("link")).distinct()
    return resolve.shortest_links(links, pages).select("link", "slug")


@query("SELECT * FROM (SELECT note_id, CAST(row_number() OVER (PARTITION BY kind ORDER BY modified DESC NULLS LAST, lower(coalesce(title, '')), note_id) AS INTEGER) AS place FROM notes) WHERE place <= 50", base="")
def recent_pages(spark, sf):
    """The fifty latest pages of each kind: by date, undated last, then title."""
    order = [F.col("modified").desc_nulls_last(), F.lower(F.coalesce("title", F.lit(""))), "note_id"]
    return table(spark, sf, "notes").select("note_id", F.row_number().over(Window.partitionBy("kind").orderBy(*order)).alias("place")).where("place <= 50")


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CAST(regexp_extract(key, '(\\d+)', 1) AS BIGINT)) AS INTEGER) AS place FROM (SELECT *, 'part-' || p_partkey AS key FROM part)", base="")
def explorer_order(spark, sf):
    """Names within a folder in natural order of their numbers."""
    key = slugs.natural_key(F.concat(F.lit("part-"), F.col("p_partkey")))
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(key)).alias("place"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY updated_at DESC, doc_id) AS INTEGER) AS place FROM documents WHERE text IS NOT NULL ORDER BY updated_at DESC, doc_id LIMIT 10", base="")
def feed_latest(spark, sf):
    """The ten newest documents, as a feed lists them."""
    top = table(spark, sf, "documents").where("text is not null").select("doc_id", "updated_at").orderBy(F.desc("updated_at"), "doc_id").limit(10)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("updated_at"), "doc_id")).alias("place"))


@query("SELECT coalesce(layer, 'unknown') AS section, count(*) AS n, md5(string_agg('[[' || name || ']]', ', ' ORDER BY name)) AS listed FROM concepts GROUP BY 1", base="")
def registry_sections(spark, sf):
    """Registry tables: the concepts of each layer in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("[["), n, F.lit("]]"))), ", ")
    return table(spark, sf, "concepts").groupBy(F.coalesce("layer", F.lit("unknown")).alias("section")).agg(F.count(F.lit(1)).alias("n"), F.md5(listed).alias("listed"))


@query(
    rf"""g AS (SELECT doc_id, unnest(regexp_extract_all(text, '`([^`\r\n]{{2,60}})`', 1)) AS term FROM d)
    SELECT term, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, lower(trim(term)) AS term FROM g) WHERE term NOT IN (SELECT name FROM n) AND term NOT IN (SELECT alias FROM al) AND term <> '' GROUP BY 1"""
)
def ghost_terms(spark, sf):
    """Marked-up terms that no note defines."""
    v = vault(spark, sf)
    known = v.names.select(F.col("name").alias("term")).unionByName(v.aliases.select(F.col("alias").alias("term")))
    return texts.ghost_terms(v.notes.select(F.col("note_id").alias("doc_id"), F.col("content").alias("text")), known)
