"""Audit queries: note types, registry tables, mentions, definitions, coverage and further table views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.functions import markdown as md
from vaultweave.functions.signals import layer_rank
from vaultweave.operators import audits, ledger, registry, typing, views
from vaultweave.plans.vault import _FLAGS, view_coverage
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A registry of note types for the notes of the test tables.
TYPES = typing.load_types("""
registry_version = 1
[[types]]
type_id = "vault:concept"
description = "A concept"
[types.locations]
allowed_patterns = ["concepts/*.md"]
forbidden_patterns = ["concepts/_*", "concepts/z*"]
allowed_extensions = [".md"]
[types.metadata]
required = ["role", "layer", "canonical"]
optional = ["vault"]
[types.metadata.constraints]
role = { type = "literal", value = "concept" }
layer = { type = "enum", values = ["primitive", "first-order", "mechanism", "accounting"] }
canonical = { type = "boolean" }
[[types]]
type_id = "vault:diagnostic"
description = "A diagnostic"
[types.locations]
allowed_patterns = ["diagnostics/**"]
allowed_extensions = [".md"]
[types.metadata]
required = ["role", "vault"]
[types.metadata.constraints]
vault = { type = "integer" }
role = { type = "string" }
""")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _typed_notes(spark, sf) -> DataFrame:
    front = F.to_json(F.struct(F.col("kind").alias("role"), "layer", "canonical", "vault"))
    return table(spark, sf, "notes").select("note_id", "path", front.alias("front"))


_TYPE = "CASE WHEN starts_with(path, 'concepts/') AND ends_with(path, '.md') AND NOT starts_with(path, 'concepts/_') AND NOT starts_with(path, 'concepts/z') THEN 'vault:concept' WHEN starts_with(path, 'diagnostics/') THEN 'vault:diagnostic' END"


@query(f"SELECT {_TYPE} AS type_id, count(*) AS n FROM notes GROUP BY 1")
def note_types(spark, sf):
    """Notes by the type their path has."""
    return table(spark, sf, "notes").groupBy(typing.type_of(F.col("path"), TYPES).alias("type_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH t AS (SELECT *, {_TYPE} AS type_id FROM notes), c AS (SELECT * FROM t WHERE type_id = 'vault:concept'), d AS (SELECT * FROM t WHERE type_id = 'vault:diagnostic')
    SELECT CAST(note_id AS VARCHAR) AS note_id, type_id, 'layer' AS field, 'required field ''layer'' is missing' AS message FROM c WHERE layer IS NULL
    UNION ALL SELECT CAST(note_id AS VARCHAR), type_id, 'canonical', 'required field ''canonical'' is missing' FROM c WHERE canonical IS NULL
    UNION ALL SELECT CAST(note_id AS VARCHAR), type_id, 'layer', 'field ''layer'' must be one of primitive, first-order, mechanism, accounting, got ''' || layer || '''' FROM c WHERE layer NOT IN ('primitive', 'first-order', 'mechanism', 'accounting')
    UNION ALL SELECT CAST(note_id AS VARCHAR), type_id, 'role', 'field ''role'' must be ''concept'', got ''' || kind || '''' FROM c WHERE kind <> 'concept'
    UNION ALL SELECT CAST(note_id AS VARCHAR), type_id, 'vault', 'required field ''vault'' is missing' FROM d WHERE vault IS NULL
    UNION ALL SELECT CAST(note_id AS VARCHAR), type_id, 'vault', 'field ''vault'' must be integer, got str' FROM d WHERE vault IS NOT NULL"""
)
def note_type_faults(spark, sf):
    """Notes that break their type's rules."""
    return typing.validate(_typed_notes(spark, sf), TYPES).select("note_id", "type_id", "field", "message")


def _registered(spark, sf) -> DataFrame:
    concepts = table(spark, sf, "concepts").select("name", "layer", "role", F.coalesce("aliases", F.array().cast("array<string>")).alias("deps"))
    overrides = concepts.where("name in ('plateau', 'yoke')").select("name", F.lit("A word of its own").alias("role"), F.when(F.col("name") == "yoke", "Cross-layer hub").alias("hub_class"))
    return registry.rows(concepts, overrides, {"Mechanisms": ["nested-handover", "hidden-notch"]})


_SECTION = "CASE WHEN l IN ('primitive', 'foundational') THEN 'Primitives' WHEN l = 'first-order' THEN 'First-order composites' WHEN l = 'mechanism' THEN 'Mechanisms' WHEN l = 'accounting' THEN 'Accounting' WHEN l = 'failure-state' THEN 'Failure states' WHEN l IN ('selector', 'meta-analytical') THEN 'Selectors' ELSE 'Unclassified (' || l || ')' END"


@query(
    f"""WITH c AS (SELECT name, lower(trim(coalesce(layer, 'unknown'))) AS l, layer, CASE name WHEN 'plateau' THEN 'A word of its own' WHEN 'yoke' THEN 'A word of its own (hub: Cross-layer hub)' ELSE coalesce(role, '') END AS role, list_sort(coalesce(aliases, [])) AS deps FROM concepts),
      s AS (SELECT *, {_SECTION} AS section, CASE WHEN len(deps) > 0 THEN array_to_string(list_transform(deps, lambda d: '[[' || d || ']]'), ', ') WHEN layer = 'primitive' THEN 'None (primitive)' WHEN layer = 'foundational' THEN 'None (axiomatic)' ELSE 'None' END AS d FROM c)
    SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'Mechanisms' THEN CASE name WHEN 'nested-handover' THEN 1 WHEN 'hidden-notch' THEN 2 END END NULLS LAST, name) AS INTEGER) AS place, name, '| [[' || name || ']] | ' || role || ' | ' || d || ' |' AS line FROM s"""
)
def registry_rows(spark, sf):
    """The registry's table rows by section, with overrides and an order of one's own."""
    return _registered(spark, sf).select("section", "place", "name", "line")


@query("SELECT lower(trim(coalesce(layer, 'unknown'))) AS layer, count(*) AS n FROM concepts WHERE lower(trim(coalesce(layer, 'unknown'))) NOT IN ('primitive', 'foundational', 'first-order', 'mechanism', 'accounting', 'failure-state', 'selector', 'meta-analytical') GROUP BY 1")
def registry_unknown_layers(spark, sf):
    """Layers no section holds."""
    return registry.unknown_layers(table(spark, sf, "concepts"))


@query("SELECT 'drift' AS status, 'stale' AS kind, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'drift', 'missing', (SELECT count(*) - 1 FROM concepts)")
def registry_drift(spark, sf):
    """How far a stored registry with one right and one stale line lags behind."""
    found = _registered(spark, sf)
    right = found.orderBy("name").first().line
    note = spark.createDataFrame([("registry-notes", "registry", f"# R\n\n### Concepts :: Primitives\n\n{right}\n| [[gone]] | x | None |\n\n## Other\n| [[no]] |")], "name string, role string, content string")
    return registry.drift(found, note).groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"))


def _concept_names(spark, sf) -> DataFrame:
    return table(spark, sf, "concepts").select(F.col("name").alias("node"), "title", "aliases")


def _definitions(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").where("note_kind = 'concept'").select(F.col("doc_id").cast("string").alias("src"), md.section_strict(F.col("text"), "Definition").alias("text"))


_DEF = r"""trim(split_part(chr(10) || regexp_extract(text, '(?ms)^## Definition[ \t\r]*\n(.*)', 1), chr(10) || '## ', 1), ' ' || chr(9) || chr(10) || chr(13))"""
_MENTIONS = rf"""d AS (SELECT CAST(doc_id AS VARCHAR) AS src, regexp_replace(regexp_replace(lower({_DEF}), '([^\pL\pN_])', '\1\1', 'g'), '^(.*)$', '  \1  ', 's') AS t, text FROM documents WHERE note_kind = 'concept' AND regexp_matches(text, '(?ms)^## Definition[ \t\r]*\n')),
  f AS (SELECT name AS node, unnest(list_distinct([name, title] || coalesce(aliases, []))) AS form FROM concepts), v AS (SELECT DISTINCT node, array_to_string(list_filter(string_split_regex(lower(trim(form)), '[-\s]+'), lambda x: x <> ''), ' ') AS variant FROM f WHERE form IS NOT NULL),
  m AS (SELECT src, node AS dst, len(regexp_extract_all(t, '[^\pL\pN_]' || replace(variant, ' ', '[-\s]+') || '[^\pL\pN_]')) AS n FROM d JOIN v ON contains(t, split_part(variant, ' ', 1)) WHERE length(variant) >= 3),
  mentions AS (SELECT src, dst, max(n) AS n FROM m WHERE n > 0 GROUP BY 1, 2)"""
_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


@query(f"WITH {_MENTIONS} SELECT src, dst, CAST(n AS BIGINT) AS n FROM mentions")
def definition_mentions(spark, sf):
    """How often each definition mentions each concept."""
    return audits.mentions(_definitions(spark, sf), _concept_names(spark, sf))


def _edges(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").where("note_kind = 'concept'")
    src = F.col("doc_id").cast("string").alias("src")
    links = docs.select(src, F.explode(md.links(F.col("text"))).alias("dst"))
    block = F.coalesce(md.front_matter_field(md.front_matter(F.col("text")), "depends_on"), F.lit(""))
    return links, docs.select(src, F.explode(md.links(block)).alias("dst"))


_EDGES = rf"""links AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, trim(lower(unnest(regexp_extract_all(text, '{_LINK}', 1)))) AS dst FROM documents WHERE note_kind = 'concept'),
  depends AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, trim(lower(unnest(regexp_extract_all(coalesce(regexp_extract(regexp_extract(text, '(?s)^---\r?\n(.*?)\r?\n---', 1), '(?m)^depends_on:[ \t]*([^\r\n]*)', 1), ''), '{_LINK}', 1)))) AS dst FROM documents WHERE note_kind = 'concept')"""


@query(f"WITH {_MENTIONS}, {_EDGES} SELECT m.src, m.dst, CAST(m.n AS BIGINT) AS n, d.src IS NOT NULL AS has_depends FROM mentions m LEFT JOIN depends d ON d.src = m.src AND d.dst = m.dst WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = m.src AND l.dst = m.dst)")
def unlinked_mentions(spark, sf):
    """Concepts a definition mentions without linking to them."""
    return audits.unlinked_mentions(audits.mentions(_definitions(spark, sf), _concept_names(spark, sf)), *_edges(spark, sf))


@query(f"WITH {_EDGES} SELECT src, dst, 'link' AS kind FROM (SELECT * FROM links EXCEPT SELECT * FROM depends) UNION ALL SELECT src, dst, 'depends' FROM (SELECT * FROM depends EXCEPT SELECT * FROM links)")
def link_disagreements(spark, sf):
    """Links without a dependency and dependencies without a link."""
    return audits.disagreements(*_edges(spark, sf))


_LOOSE = r"""lower(CASE WHEN contains(lower(text), '## definition') THEN trim(split_part(substr(text, instr(lower(text), '## definition') + 13), chr(10) || '## ', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END)"""


@query(
    rf"""WITH {_EDGES}, d AS (SELECT CAST(doc_id AS VARCHAR) AS node, {_LOOSE} AS t FROM documents WHERE note_kind = 'concept' AND text IS NOT NULL), l AS (SELECT node, unnest(regexp_extract_all(t, '\[\[([^\]|]+)', 1)) AS dst FROM d)
    SELECT d.node, c.name AS implied FROM d JOIN concepts c ON (contains(d.t, c.name) AND length(c.name) > 3) OR (contains(d.t, replace(c.name, '-', ' ')) AND length(c.name) > 3)
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.node = d.node AND l.dst = c.name) AND NOT EXISTS (SELECT 1 FROM depends e WHERE e.src = d.node AND replace(e.dst, ' ', '-') = c.name)"""
)
def implicit_dependencies(spark, sf):
    """Concepts named in a definition that it neither links nor declares."""
    docs = table(spark, sf, "documents").where("note_kind = 'concept' and text is not null")
    block = F.coalesce(md.front_matter_field(md.front_matter(F.col("text")), "depends_on"), F.lit(""))
    notes = docs.select(F.col("doc_id").cast("string").alias("node"), F.col("text").alias("content"), md.links(block).alias("deps"))
    return audits.implicit_dependencies(notes, table(spark, sf, "concepts").select(F.col("name").alias("node")))


@query()
def definition_summary(spark, sf):
    """What the definitions of all concept notes are like, in sum."""
    docs = table(spark, sf, "documents").where("note_kind = 'concept' and text is not null").select(F.col("doc_id").cast("string").alias("node"), F.col("text").alias("content"))
    return audits.definition_summary(audits.definitions(docs), implicit_dependencies(spark, sf))


_HAS = r"regexp_matches(text, '(?ms)^## {h}[ \t\r]*\n')"


@query(
    rf"""WITH {_EDGES}, o AS (SELECT src AS node, count(*) AS out_degree FROM depends GROUP BY 1), i AS (SELECT dst AS node, count(*) AS in_degree FROM depends GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS node, coalesce({_HAS.format(h='Definition')}, false) AS has_definition, coalesce({_HAS.format(h='Structural dependencies')}, false) AS has_dependencies, coalesce({_HAS.format(h='What this is NOT')}, false) AS has_boundary,
      coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM documents LEFT JOIN o ON o.node = CAST(doc_id AS VARCHAR) LEFT JOIN i ON i.node = CAST(doc_id AS VARCHAR) WHERE note_kind = 'concept'"""
)
def concept_audit(spark, sf):
    """Sections and degrees of each concept note."""
    docs = table(spark, sf, "documents").where("note_kind = 'concept'").select(F.col("doc_id").cast("string").alias("node"), md.front_matter_field(md.front_matter(F.col("text")), "layer").alias("layer"), F.col("text").alias("content"))
    return audits.concept_audit(docs, _edges(spark, sf)[1]).select("node", "has_definition", "has_dependencies", "has_boundary", "out_degree", "in_degree")


@query(
    "SELECT concept, count(*) FILTER (WHERE has) AS covered, count(*) FILTER (WHERE NOT has) AS lacking, bool_and(has) AS complete FROM ("
    + " UNION ALL ".join(f"SELECT '{f.replace('-', '_')}' AS concept, coalesce(bool_or(link = '{f}'), false) AS has FROM d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY d.doc_id" for f in _FLAGS) + ") GROUP BY 1"
)
def audit_coverage(spark, sf):
    """How many domain notes link to each of five concepts."""
    return audits.coverage(view_coverage(spark, sf), [f.replace("-", "_") for f in _FLAGS])


ORACLES["audit_coverage"] = rf"WITH d AS (SELECT doc_id, text FROM documents WHERE lower(note_kind) = 'domain'), l AS (SELECT DISTINCT doc_id, trim(lower(unnest(regexp_extract_all(text, '{_LINK}', 1)))) AS link FROM d) " + ORACLES["audit_coverage"]


@query("SELECT split_part(path, '/', 1) AS location, count(*) AS n, count(title) AS title_filled, count(DISTINCT vault) AS vault_unique FROM notes GROUP BY 1")
def view_by_location(spark, sf):
    """Notes by folder with footers."""
    view = views.View(["location"], {"location": "substring_index(path, '/', 1)"}, group_by="location", footers={"title": "Filled", "vault": "Unique"})
    return views.footers(table(spark, sf, "notes"), view)


@query("SELECT canonical, count(*) AS n, min(created) AS created_min, max(modified) AS modified_max FROM notes WHERE kind = 'concept' GROUP BY 1")
def view_by_status(spark, sf):
    """Concepts by whether they are canonical."""
    return views.footers(table(spark, sf, "notes"), views.View(["name"], filters=["kind = 'concept'"], group_by="canonical", footers={"created": "Min", "modified": "Max"}))


@query("SELECT note_id, name, layer FROM notes WHERE kind = 'diagnostic' AND (layer IS NULL OR layer <> 'selector')")
def view_diagnostics(spark, sf):
    """Diagnostics with or without a layer."""
    return views.rows(table(spark, sf, "notes"), views.View(["note_id", "name", "layer"], filters=["kind = 'diagnostic'", "layer is null or layer <> 'selector'"], sort=["layer", "-name"]))


@query("SELECT layer, count(*) AS n, round(avg(links), 6) AS links_average, CAST(sum(links) AS BIGINT) AS links_sum FROM (SELECT lower(layer) AS layer, links FROM primitives_and_foundational) GROUP BY 1")
def view_dependency_average(spark, sf):
    """Links of the exported concepts by layer, on average and in sum."""
    shaped = table(spark, sf, "primitives_and_foundational").withColumn("layer", F.lower("layer"))
    avg = views.footers(shaped, views.View(["layer"], group_by="layer", footers={"links": "Average"}))
    total = views.footers(shaped, views.View(["layer"], group_by="layer", footers={"links": "Sum"})).select(F.col("layer").alias("_l"), "links_sum")
    return avg.join(total, F.col("layer").eqNullSafe(F.col("_l"))).select("layer", "n", F.round("links_average", 6).alias("links_average"), "links_sum")


@query(
    r"""WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, '> [!'))),
      h AS (SELECT doc_id, line, starts_with(ls[line], '> [!') AS hit FROM l), w AS (SELECT doc_id, line, max(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM h)
    SELECT doc_id AS doc, CAST(line AS INTEGER) AS line FROM w WHERE near = 1"""
)
def lines_near_callouts(spark, sf):
    """Lines within five of a callout."""
    docs = table(spark, sf, "documents").where(F.col("text").contains("> [!"))
    lines = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc", (F.col("p") + 1).alias("line"), "t")
    return audits.around(lines, F.col("t").startswith("> [!")).select("doc", "line")


_EV = "WITH e AS (SELECT event_id AS seq, user_id AS artifact_id, 'inv-' || user_id % 3 AS invariant, 'r-' || event_id % 7 AS rule_id, CASE WHEN value < 20 THEN 'fail' ELSE 'pass' END AS result, event_type, CAST(round(value) AS BIGINT) AS violations FROM events)"


def _engine_events(spark, sf) -> DataFrame:
    result = F.when(F.col("value") < 20, "fail").otherwise("pass")
    kind = F.when(F.col("event_type").isin("view", "click"), "constraint.evaluated").when(F.col("event_type") == "purchase", "invariant.checked").otherwise("other")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("artifact_id"), kind.alias("kind"), F.concat(F.lit("inv-"), F.col("user_id") % 3).alias("invariant"), F.concat(F.lit("r-"), F.col("event_id") % 7).alias("rule_id"),
        result.alias("result"), F.round("value").cast("long").alias("violations"),
    )


@query(
    f"""{_EV} SELECT count(DISTINCT CASE WHEN event_type IN ('view', 'click') THEN rule_id END) AS rules_checked, count(*) FILTER (WHERE event_type IN ('view', 'click') AND result = 'pass') AS passed, count(*) FILTER (WHERE event_type IN ('view', 'click') AND result = 'fail') AS failed,
      CAST(0 AS BIGINT) AS warnings, count(DISTINCT CASE WHEN event_type = 'purchase' THEN invariant END) AS invariants, count(DISTINCT CASE WHEN event_type = 'purchase' AND result = 'fail' THEN invariant END) AS violated, CAST(sum(violations) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS violations FROM e"""
)
def validation_summary(spark, sf):
    """Rules and invariants checked in sum."""
    return ledger.validation_summary(_engine_events(spark, sf))


@query(f"{_EV} SELECT artifact_id, invariant AS invariant_id, arg_max(result, seq) AS status, arg_max('item-' || seq, seq) AS items FROM e WHERE event_type = 'purchase' GROUP BY 1, 2")
def affected_items(spark, sf):
    """The last check of each invariant with what it affected."""
    checks = _engine_events(spark, sf).where("kind = 'invariant.checked'").select("artifact_id", F.col("invariant").alias("invariant_id"), F.col("result").alias("status"), "seq", F.concat(F.lit("item-"), "seq").alias("affected_items"))
    return ledger.affected_items(checks)


@query("SELECT layer, count(*) AS n, CASE lower(layer) WHEN 'primitive' THEN 0 WHEN 'foundational' THEN 0 WHEN 'first-order' THEN 1 WHEN 'mechanism' THEN 2 WHEN 'accounting' THEN 3 WHEN 'selector' THEN 4 WHEN 'failure-state' THEN 4 WHEN 'meta-analytical' THEN 4 ELSE 99 END AS rank FROM concepts GROUP BY 1")
def audit_layers(spark, sf):
    """Concepts by layer in dependency order."""
    return table(spark, sf, "concepts").groupBy("layer").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", layer_rank(F.col("layer")))
