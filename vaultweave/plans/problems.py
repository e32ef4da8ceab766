"""The core problem queries (p2, p3, p5) over their whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultweave.functions.keys import is_wikilink, note_key
from vaultweave.operators.graph import components, strong_components
from vaultweave.operators.hierarchy import ancestors, descendants, hierarchy, resolve_paths, several_parents
from vaultweave.operators.orphans import MATCHES, orphan_references, orphan_report
from vaultweave.operators.packed import rules_for, split_packed
from vaultweave.session import table

PACKED_FIELDS = (("papers", "concepts_linked"), ("papers", "links"), ("primitives_and_foundational", "depends_on"))


def packed_values(spark: SparkSession, sf_dir: str, fields=PACKED_FIELDS, keep=("row_id",)) -> DataFrame:
    """(field, *keep, pos, value) of every packed field, each table read with the columns needed only."""
    texts = []
    for name, column in fields:
        texts.append(table(spark, sf_dir, name).select(F.lit(f"{name}.{column}").alias("field"), *keep, F.col(column).alias("text")))
    stacked = texts[0]
    for more in texts[1:]:
        stacked = stacked.unionByName(more)
    return split_packed(stacked, "text", ["field", *keep], rules_for(stacked, "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_values(spark, sf_dir).select("field", "row_id", "pos", "value")


def node_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent): every row's concept, with each note its ``depends_on`` links (null where there is none)."""
    rows = table(spark, sf_dir, "primitives_and_foundational").select(note_key(F.col("concept")).alias("node"), "depends_on")
    linked = split_packed(rows.where("node is not null"), "depends_on", ["node"])
    parents = linked.where(is_wikilink(F.col("value"))).select("node", note_key(F.col("value")).alias("parent"))
    return rows.select("node", F.lit(None).cast("string").alias("parent")).unionByName(parents)


def concept_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_paths(node_links(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestors(concept_paths(spark, sf_dir)).select(F.col("node").alias("concept"), "ancestor", "steps")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(concept_paths(spark, sf_dir))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(concept_paths(spark, sf_dir)).select(F.col("node").alias("concept"), "descendant", "steps")


def p2_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return several_parents(node_links(spark, sf_dir))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("papers", "concepts_linked"), ("primitives_and_foundational", "depends_on"))
    values = packed_values(spark, sf_dir, fields, ("row_id", "exported_at"))
    of_papers = F.col("field") == "papers.concepts_linked"
    refs = values.where(of_papers | is_wikilink(F.col("value"))).select(
        F.when(of_papers, F.lit("papers")).otherwise(F.lit("primitives_and_foundational")).alias("tab"), "row_id", "pos", note_key(F.col("value")).alias("target"), "exported_at"
    )
    notes, concepts = (table(spark, sf_dir, t).select(note_key(F.col("name")).alias("target"), "created", "removed") for t in ("notes", "concepts"))
    found = orphan_references(refs, notes, ["target"], "exported_at", "created", "removed", lookup=concepts)
    return found.withColumn("period", F.date_format("exported_at", "yyyy-MM"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("tab", "row_id", "pos", "target", "kind", "period")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir), "tab", "period")


def p5_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, row_id): exported rows whose vault, concept and layer, each null in places, no note has, under each match semantics."""
    keys = ["vault", "target", "layer"]
    refs = table(spark, sf_dir, "primitives_and_foundational").select("row_id", "vault", note_key(F.col("concept")).alias("target"), F.lower("layer").alias("layer"))
    notes = table(spark, sf_dir, "notes").select("vault", note_key(F.col("name")).alias("target"), F.lower("layer").alias("layer"))
    found = [orphan_references(refs, notes, keys, match=mode).select(F.lit(mode).alias("mode"), "row_id") for mode in MATCHES]
    return reduce(DataFrame.unionByName, found)


def concept_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected groups of concepts by their links."""
    return strong_components(node_links(spark, sf_dir).toDF("src", "dst"))


def concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that hang together by their links in any direction, trees and cycles alike."""
    links = node_links(spark, sf_dir).toDF("src", "dst")
    known = links.select(F.col("src").alias("dst")).distinct()
    return components(links.where("dst is not null").join(known, "dst", "left_semi").select("src", "dst"), known.toDF("node"))


QUERIES = {
    "p2_found": p2_found,
    "p2_hierarchy": p2_hierarchy,
    "p2_descendants": p2_descendants,
    "p2_parents": p2_parents,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_composite": p5_composite,
    "concept_cycles": concept_cycles,
    "concept_groups": concept_groups,
}

# -- SQL checks: packed values cut by one pattern of RE2, keys by splitting, trees by recursion --------

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288) || chr(65279)"
_SEPARATORS = r",;|\n\r\t·•\x1e\x1f"
_WIKILINK = r"\[\[(?:[^\]]|\][^\]])*\]\]"
_PLAIN = rf"""(?:{_WIKILINK}|[^{_SEPARATORS}\s"]? +"(?:[^"]|"")*"|[^{_SEPARATORS}])*"""
_ONE = rf"""(?:^|[{_SEPARATORS}])[ \x{{a0}}]*(?:[-*+][ \t]+)?((?:"(?:[^"]|"")*"|''(?:[^'']|'''')*'')[ \x{{a0}}]*|{_PLAIN})"""


def values_sql(texts: str) -> str:
    """CTEs up to ``vals`` (field, row_id, pos, value) over a query of (field, row_id, text)."""
    quoted = "WHEN length(x) > 1 AND starts_with(x, {q}) AND ends_with(x, {q}) THEN trim(replace(substr(x, 2, length(x) - 2), {q} || {q}, {q}), " + _BLANKS + ")"
    bare = " ".join(quoted.format(q=q) for q in ("chr(34)", "chr(39)"))
    marked = r"regexp_replace(regexp_replace(text, '<br\s*/?>', chr(30), 'g'), '(\s)/(\s)', '\1' || chr(31) || '\2', 'g')"
    return f"""pre AS (SELECT *, trim(text, {_BLANKS}) AS t FROM ({texts}) WHERE text IS NOT NULL),
  js AS (SELECT *, t LIKE '[%]' AND NOT starts_with(t, '[[') AND json_valid(t) AS is_json FROM pre),
  raw AS (SELECT field, row_id, is_json, CASE WHEN is_json THEN list_transform(from_json(t, '["VARCHAR"]'), lambda x: trim(x, {_BLANKS}))
    ELSE list_transform(regexp_extract_all({marked}, '{_ONE}', 1), lambda x: trim(replace(x, chr(31), '/'), {_BLANKS})) END AS vs FROM js),
  cl AS (SELECT field, row_id, CASE WHEN is_json THEN vs ELSE list_transform(vs, lambda x: CASE {bare} ELSE x END) END AS vs FROM raw),
  fl AS (SELECT field, row_id, list_filter(vs, lambda x: x IS NOT NULL AND x <> '' AND x NOT IN ('-', '*', '+')) AS vs FROM cl),
  vals AS (SELECT field, row_id, CAST(i AS INTEGER) AS pos, vs[i] AS value FROM (SELECT field, row_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM fl))"""


def key_sql(c: str) -> str:
    inner = f"split_part(split_part({c}, '[[', -1), ']]', 1)"
    name = f"lower(split_part(split_part(rtrim(split_part({inner}, '|', 1), ' ' || chr(92)), '#', 1), '/', -1))"
    return rf"trim(regexp_replace({name}, '\.md\s*$', ''), {_BLANKS})"


def field_sql(*fields: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS field, row_id, {f.split('.')[1]} AS text FROM {f.split('.')[0]}" for f in fields)


_IS_LINK = "((starts_with(value, '[[') OR starts_with(value, '![[')) AND ends_with(value, ']]'))"
_DEPENDS = "primitives_and_foundational.depends_on"
_WALK = f"""{values_sql(field_sql(_DEPENDS))}, named AS (SELECT row_id, {key_sql('concept')} AS node FROM primitives_and_foundational WHERE concept IS NOT NULL),
  nodes AS (SELECT DISTINCT node FROM named),
  real AS (SELECT DISTINCT n.node, {key_sql('v.value')} AS parent FROM vals v JOIN named n ON n.row_id = v.row_id WHERE {_IS_LINK} AND {key_sql('v.value')} IN (SELECT node FROM nodes)),
  up AS (SELECT node, min(parent) AS parent FROM real GROUP BY 1),
  walk AS (SELECT node, node AS at, 0 AS steps, [node] AS path FROM nodes UNION ALL
    SELECT w.node, u.parent, w.steps + 1, list_append(w.path, u.parent) FROM walk w JOIN up u ON u.node = w.at WHERE NOT list_contains(w.path, u.parent)),
  top AS (SELECT w.node, w.steps, w.path, u.parent, CASE WHEN u.parent IS NOT NULL THEN list_aggregate(w.path[list_position(w.path, u.parent):], 'min') END AS cycle
    FROM walk w LEFT JOIN up u ON u.node = w.at WHERE u.parent IS NULL OR list_contains(w.path, u.parent))"""
_REFS = f"""{values_sql(field_sql('papers.concepts_linked', _DEPENDS))},
  refs AS (SELECT 'papers' AS tab, v.row_id, v.pos, {key_sql('v.value')} AS target, p.exported_at FROM vals v JOIN papers p ON p.row_id = v.row_id WHERE v.field = 'papers.concepts_linked'
    UNION ALL SELECT 'primitives_and_foundational', v.row_id, v.pos, {key_sql('v.value')}, p.exported_at FROM vals v JOIN primitives_and_foundational p ON p.row_id = v.row_id WHERE v.field = '{_DEPENDS}' AND {_IS_LINK}),
  targets AS (SELECT {key_sql('name')} AS target, created, removed FROM notes UNION ALL SELECT {key_sql('name')}, created, removed FROM concepts),
  life AS (SELECT target, CASE WHEN count(created) = count(*) THEN min(created) END AS since, CASE WHEN count(removed) = count(*) THEN max(removed) END AS until FROM targets GROUP BY 1),
  judged AS (SELECT tab, row_id, pos, refs.target, CASE WHEN life.target IS NULL THEN 'missing' WHEN since > exported_at THEN 'late' WHEN until <= exported_at THEN 'deleted' END AS kind, strftime(exported_at, '%Y-%m') AS period
    FROM refs LEFT JOIN life ON life.target = refs.target),
  orphans AS (SELECT * FROM judged WHERE kind IS NOT NULL)"""
_COMPOSITE = f"""r AS (SELECT row_id, vault, {key_sql('concept')} AS target, lower(layer) AS layer FROM primitives_and_foundational), t AS (SELECT vault, {key_sql('name')} AS target, lower(layer) AS layer FROM notes),
  whole AS (SELECT * FROM r WHERE vault IS NOT NULL AND target IS NOT NULL AND layer IS NOT NULL), part AS (SELECT * FROM r WHERE NOT (vault IS NULL AND target IS NULL AND layer IS NULL)),
  none AS (SELECT row_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.vault = whole.vault AND t.target = whole.target AND t.layer = whole.layer))"""

ORACLES: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {_WALK} SELECT w.node AS concept, w.at AS ancestor, w.steps FROM walk w JOIN top t ON t.node = w.node WHERE t.cycle IS NULL
      UNION ALL SELECT node, cycle, -1 FROM top WHERE cycle IS NOT NULL""",
    "p2_hierarchy": f"""WITH RECURSIVE {_WALK} SELECT node, CASE WHEN cycle IS NULL THEN array_to_string(list_reverse(path), '/') END AS path, CASE WHEN cycle IS NULL THEN steps END AS depth, CASE WHEN cycle IS NULL THEN path[-1] END AS root, cycle FROM top""",
    "p2_descendants": f"""WITH RECURSIVE {_WALK} SELECT w.at AS concept, w.node AS descendant, w.steps FROM walk w JOIN top t ON t.node = w.node WHERE t.cycle IS NULL AND w.steps > 0""",
    "p2_parents": f"""WITH RECURSIVE {_WALK} SELECT node, count(*) AS parents, min(parent) AS taken FROM real GROUP BY 1 HAVING count(*) > 1""",
    "p3_found": f"WITH {values_sql(field_sql('papers.concepts_linked', 'papers.links', _DEPENDS))} SELECT field, row_id, pos, value FROM vals",
    "p5_found": f"WITH {_REFS} SELECT tab, row_id, pos, target, kind, period FROM orphans",
    "p5_report": f"WITH {_REFS} SELECT tab, period, kind, count(*) AS n_references, count(DISTINCT target) AS n_targets FROM orphans GROUP BY 1, 2, 3",
    "p5_composite": f"""WITH {_COMPOSITE} SELECT 'simple' AS mode, row_id FROM none
      UNION ALL SELECT 'full', row_id FROM none UNION ALL SELECT 'full', row_id FROM part WHERE vault IS NULL OR target IS NULL OR layer IS NULL
      UNION ALL SELECT 'partial', row_id FROM part WHERE NOT EXISTS (SELECT 1 FROM t WHERE (part.vault IS NULL OR t.vault = part.vault) AND (part.target IS NULL OR t.target = part.target) AND (part.layer IS NULL OR t.layer = part.layer))""",
    "concept_cycles": f"""WITH RECURSIVE {_WALK}, ring AS (SELECT DISTINCT cycle AS component, unnest(path[list_position(path, parent):]) AS node FROM top WHERE cycle IS NOT NULL), n AS (SELECT component, count(*) AS size FROM ring GROUP BY 1)
      SELECT node, component, size FROM ring JOIN n USING (component) WHERE size > 1""",
    "concept_groups": f"""WITH RECURSIVE {_WALK}, g AS (SELECT node, coalesce(cycle, path[-1]) AS ends FROM top) SELECT node, min(node) OVER (PARTITION BY ends) AS component FROM g""",
}
