"""Graph queries: parts, suppliers and nations as notes, line items as their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultweave.functions.signals import layer_rank
from vaultweave.operators import graph as g
from vaultweave.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LAYER_OF = {"PROMO": "primitive", "ECONOMY": "first-order", "MEDIUM": "mechanism", "SMALL": "accounting", "STANDARD": "selector", "LARGE": "failure-state"}

_LAYER = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYER_OF.items()) + " END"
_BASE = f"""parts AS (SELECT p_partkey AS node, {_LAYER} AS layer, p_brand AS community FROM part),
  links AS (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2),
  deps AS (SELECT DISTINCT greatest(a.l_partkey, b.l_partkey) AS src, least(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
_ORG = """org AS (SELECT DISTINCT 'part-' || l_partkey AS src, 'supplier-' || l_suppkey AS dst FROM lineitem
  UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation)"""
_RANK = "CASE {c} WHEN 'primitive' THEN 0 WHEN 'first-order' THEN 1 WHEN 'mechanism' THEN 2 WHEN 'accounting' THEN 3 WHEN 'selector' THEN 4 WHEN 'failure-state' THEN 4 ELSE 99 END"


def query(oracle: str | None = None, base: str = _BASE):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"WITH {base}{' ' if oracle.lstrip().startswith('SELECT') else ', '}{oracle}" if not oracle.startswith("RECURSIVE ") else f"WITH RECURSIVE {base}, {oracle[10:]}"
        return f

    return add


def parts(spark: SparkSession, sf: str) -> DataFrame:
    layer = F.create_map(*[F.lit(x) for kv in LAYER_OF.items() for x in kv])[F.col("p_type")]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), layer.alias("layer"), F.col("p_brand").alias("community"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted links: suppliers mention parts."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose sources are named as suppliers, which are no parts."""
    return links(spark, sf).select(F.concat(F.lit("supplier-"), F.col("src")).alias("src"), "dst")


def directed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts on consecutive lines of an order."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = items.select("l_orderkey", F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    pairs = items.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")
    return pairs.where("src <> dst")


def depends(spark: SparkSession, sf: str) -> DataFrame:
    """Acyclic dependencies: of two parts on consecutive lines the larger key depends on the smaller."""
    return directed(spark, sf).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def organisation(spark: SparkSession, sf: str) -> DataFrame:
    """Parts on suppliers on nations on regions, as names."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c))
    a = table(spark, sf, "lineitem").select(name("part", "l_partkey").alias("src"), name("supplier", "l_suppkey").alias("dst")).distinct()
    b = table(spark, sf, "supplier").select(name("supplier", "s_suppkey").alias("src"), name("nation", "s_nationkey").alias("dst"))
    c = table(spark, sf, "nation").select(name("nation", "n_nationkey").alias("src"), name("region", "n_regionkey").alias("dst"))
    return a.unionByName(b).unionByName(c)


@query("SELECT dst AS node, CAST(sum(n) AS BIGINT) AS links FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_inlinks(spark, sf):
    """The fifty parts with most incoming links."""
    return links(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.sum("n").alias("links")).orderBy(F.desc("links"), "node").limit(50)


@query("SELECT dst AS node, count(*) AS dependents FROM deps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_dependents(spark, sf):
    """The fifty parts most others depend on."""
    return depends(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents")).orderBy(F.desc("dependents"), "node").limit(50)


@query("SELECT (SELECT count(*) FROM parts) AS notes, (SELECT count(*) FROM links) AS links, (SELECT CAST(sum(n) AS BIGINT) FROM links) AS mentions, (SELECT count(*) FROM deps) AS depends")
def graph_counts(spark, sf):
    """Notes, links, mentions and dependencies in sum."""
    ls = links(spark, sf).agg(F.count(F.lit(1)).alias("links"), F.sum("n").alias("mentions"))
    return parts(spark, sf).agg(F.count(F.lit(1)).alias("notes")).join(ls).join(depends(spark, sf).agg(F.count(F.lit(1)).alias("depends")))


@query(
    """o AS (SELECT src AS node, 1 AS o, 0 AS i FROM deps UNION ALL SELECT dst, 0, 1 FROM deps)
    SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(count(*) AS BIGINT) AS degree FROM o GROUP BY 1"""
)
def node_degrees(spark, sf):
    """Degrees of every part in the dependency graph."""
    return g.degrees(depends(spark, sf))


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM deps GROUP BY 1, 2")
def undirected_edges(spark, sf):
    """The undirected view of the dependencies."""
    return g.undirected(directed(spark, sf))


@query(
    """l AS (SELECT DISTINCT s.l_partkey AS a, t.dst AS b FROM lineitem s JOIN links t ON s.l_suppkey = t.src WHERE false)
    SELECT p.node FROM parts p WHERE p.node IN (SELECT dst FROM links) AND p.node NOT IN (SELECT dst FROM deps)"""
)
def links_without_depends(spark, sf):
    """Parts that are linked to but nothing depends on."""
    linked = parts(spark, sf).join(links(spark, sf).select(F.col("dst").alias("node")), "node", "left_semi")
    return linked.join(depends(spark, sf).select(F.col("dst").alias("node")), "node", "left_anti").select("node")


@query(
    """x AS (SELECT src, dst, true AS f, false AS s FROM deps UNION ALL
      SELECT DISTINCT greatest(a.l_partkey, b.l_partkey), least(a.l_partkey, b.l_partkey), false, true FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 2 WHERE a.l_partkey <> b.l_partkey)
    SELECT src, dst, bool_or(f) AS from_frontmatter, bool_or(s) AS from_structural FROM x GROUP BY 1, 2"""
)
def depends_provenance(spark, sf):
    """Dependencies of two origins merged, with where each comes from."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = items.select("l_orderkey", F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 2).alias("l_linenumber"))
    second = items.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst")
    second = second.select(F.greatest("l_partkey", "dst").alias("src"), F.least("l_partkey", "dst").alias("dst")).distinct()
    both = depends(spark, sf).select("src", "dst", F.lit(True).alias("f"), F.lit(False).alias("s")).unionByName(second.select("src", "dst", F.lit(False).alias("f"), F.lit(True).alias("s")))
    return both.groupBy("src", "dst").agg(F.bool_or("f").alias("from_frontmatter"), F.bool_or("s").alias("from_structural"))


def _declared(spark, sf):
    """Nations declare the parts their suppliers' line items name."""
    items = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return items.select(F.col("s_nationkey").alias("owner"), F.col("l_partkey").alias("node")).distinct()


_DECLARED = "decl AS (SELECT DISTINCT s_nationkey AS owner, l_partkey AS node FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_IMPLIED = f"""{_DECLARED}, imp AS (SELECT d.owner, e.dst AS implied, d.node AS via FROM decl d JOIN deps e ON e.src = d.node
  WHERE NOT EXISTS (SELECT 1 FROM decl x WHERE x.owner = d.owner AND x.node = e.dst))"""


@query(f"{_IMPLIED} SELECT owner, count(DISTINCT implied) AS n_implied, count(*) AS n_ways FROM imp GROUP BY 1")
def implied_two_hop(spark, sf):
    """Per nation: parts implied at two hops but not declared."""
    return g.implied(_declared(spark, sf), depends(spark, sf)).groupBy("owner").agg(F.count_distinct("implied").alias("n_implied"), F.count(F.lit(1)).alias("n_ways"))


@query(
    f"""{_IMPLIED}, v AS (SELECT implied, via, count(*) AS n FROM imp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY implied ORDER BY n DESC, via) AS k FROM v),
      o AS (SELECT implied, count(DISTINCT owner) AS owners FROM imp GROUP BY 1)
    SELECT implied, owners, via, n, CAST(k AS INTEGER) AS k FROM r JOIN o USING (implied) WHERE k <= 3"""
)
def junctions_top_via(spark, sf):
    """Junctions: implied parts with their owners and their three commonest ways."""
    imp = g.implied(_declared(spark, sf), depends(spark, sf))
    via = imp.groupBy("implied", "via").agg(F.count(F.lit(1)).alias("n"))
    ranked = via.withColumn("k", F.row_number().over(Window.partitionBy("implied").orderBy(F.desc("n"), "via"))).where("k <= 3")
    return ranked.join(imp.groupBy("implied").agg(F.count_distinct("owner").alias("owners")), "implied").select("implied", "owners", "via", "n", "k")


@query(
    f"""SELECT d.src, d.dst, a.layer AS layer, b.layer AS dep_layer FROM deps d JOIN parts a ON a.node = d.src JOIN parts b ON b.node = d.dst
    WHERE {_RANK.format(c='b.layer')} > {_RANK.format(c='a.layer')}"""
)
def rule_layer_violation(spark, sf):
    """Dependencies on a higher layer than one's own."""
    p = parts(spark, sf)
    of = lambda end, name: p.select(F.col("node").alias(end), F.col("layer").alias(name))
    return depends(spark, sf).join(of("src", "layer"), "src").join(of("dst", "dep_layer"), "dst").where(layer_rank(F.col("dep_layer")) > layer_rank(F.col("layer"))).select("src", "dst", "layer", "dep_layer")


@query("SELECT d.src, count(*) AS operators FROM deps d JOIN parts a ON a.node = d.src JOIN parts b ON b.node = d.dst WHERE a.layer IN ('primitive', 'first-order') AND b.layer = 'selector' GROUP BY 1")
def rule_kind_violation(spark, sf):
    """Objects that depend on operators, and on how many."""
    p = parts(spark, sf)
    objects = p.where(F.col("layer").isin("primitive", "first-order")).select(F.col("node").alias("src"))
    operators = p.where("layer = 'selector'").select(F.col("node").alias("dst"))
    return depends(spark, sf).join(objects, "src", "left_semi").join(operators, "dst", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("operators"))


_HUB = """c AS (SELECT d.dst AS node, count(*) FILTER (WHERE a.layer = 'mechanism') AS mechanisms, count(*) FILTER (WHERE a.layer = 'accounting') AS accounting,
    count(*) FILTER (WHERE a.layer = 'failure-state') AS failures, count(*) FILTER (WHERE a.layer = 'selector') AS selectors, count(DISTINCT a.layer) AS layers, count(*) AS dependents FROM deps d JOIN parts a ON a.node = d.src GROUP BY 1),
  o AS (SELECT dst AS node, count(*) AS others FROM links GROUP BY 1),
  h AS (SELECT p.node, p.layer, coalesce(mechanisms, 0) AS mechanisms, coalesce(accounting, 0) AS accounting, coalesce(failures, 0) AS failures, coalesce(selectors, 0) AS selectors, coalesce(layers, 0) AS layers,
    coalesce(dependents, 0) AS dependents, coalesce(others, 0) AS others FROM parts p LEFT JOIN c USING (node) LEFT JOIN o USING (node) WHERE p.layer NOT IN ('mechanism', 'failure-state')),
  s AS (SELECT *, CASE WHEN layer = 'primitive' THEN 'Primitive hub' WHEN mechanisms >= 2 AND accounting + failures + selectors >= 2 THEN 'Mechanism-output hub' WHEN mechanisms > 0 AND accounting > 0 AND failures > 0 THEN 'Cross-layer hub' ELSE 'Hub-adjacent' END AS hub_class,
    CAST(mechanisms + accounting + failures + selectors + layers AS DOUBLE) AS score FROM h)
SELECT *, CAST(row_number() OVER (ORDER BY {o}) AS INTEGER) AS rank FROM s ORDER BY {o} LIMIT 50"""


@query(_HUB.replace("{o}", "(mechanisms > 0) DESC, (accounting > 0) DESC, (failures > 0) DESC, layers DESC, mechanisms DESC, accounting DESC, failures DESC, dependents + others DESC, node DESC"))
def hub_candidates(spark, sf):
    """Hub candidates, those used across layers first."""
    return g.rank_hubs(g.hubs(parts(spark, sf), depends(spark, sf), mentioned(spark, sf)))


@query(_HUB.replace("{o}", "score DESC, layers DESC, dependents + others DESC, mechanisms DESC, accounting DESC, failures DESC, selectors DESC, node DESC"))
def hub_scores(spark, sf):
    """Hub candidates by weighted score."""
    return g.rank_hubs(g.hubs(parts(spark, sf), depends(spark, sf), mentioned(spark, sf)), by="score")


@query("SELECT count(*) AS edges, round(avg(CASE WHEN a.layer = b.layer THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM deps d JOIN parts a ON a.node = d.src JOIN parts b ON b.node = d.dst")
def within_layer_fraction(spark, sf):
    """Share of edges within a layer."""
    found = g.within_fraction(parts(spark, sf).select("node", F.col("layer").alias("value")), depends(spark, sf))
    return found.select("edges", F.round("fraction", 6).alias("fraction"))


@query(
    """m AS (SELECT count(*) AS m FROM deps), e AS (SELECT src AS node FROM deps UNION ALL SELECT dst FROM deps), d AS (SELECT node, count(*) AS d FROM e GROUP BY 1),
      w AS (SELECT community, coalesce(sum(d), 0) AS d FROM parts LEFT JOIN d USING (node) GROUP BY 1),
      l AS (SELECT a.community, count(*) AS l FROM deps x JOIN parts a ON a.node = x.src JOIN parts b ON b.node = x.dst WHERE a.community = b.community GROUP BY 1)
    SELECT count(*) AS communities, max(m) AS edges, round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM w LEFT JOIN l USING (community), m"""
)
def modularity_of_brands(spark, sf):
    """Modularity of the parts by brand."""
    found = g.modularity(parts(spark, sf).select("node", "community"), depends(spark, sf))
    return found.select("communities", "edges", F.round("modularity", 6).alias("modularity"))


@query(
    """t AS (SELECT community, layer, count(*) AS n FROM parts GROUP BY 1, 2), c AS (SELECT community, sum(n) AS nc, max(n) AS top FROM t GROUP BY 1), v AS (SELECT layer, sum(n) AS nv FROM t GROUP BY 1),
      s AS (SELECT sum(n) AS t FROM t), hc AS (SELECT -sum(nc / t * ln(nc / t)) AS h FROM c, s), hv AS (SELECT -sum(nv / t * ln(nv / t)) AS h FROM v, s),
      i AS (SELECT sum(n / t * ln(n * t / (nc * nv))) AS mi FROM t JOIN c USING (community) JOIN v USING (layer), s)
    SELECT CAST(s.t AS BIGINT) AS nodes, round((SELECT sum(top) FROM c) / s.t, 6) AS purity, round(mi / sqrt(hc.h * hv.h), 6) AS nmi FROM s, hc, hv, i"""
)
def alignment_of_brands(spark, sf):
    """Purity and NMI of brands against layers."""
    p = parts(spark, sf)
    fit = g.alignment(g.contingency(p.select("node", "community"), p.select("node", F.col("layer").alias("value"))))
    return fit.select("nodes", F.round("purity", 6).alias("purity"), F.round("nmi", 6).alias("nmi"))


@query(
    """t AS (SELECT community, layer, count(*) AS n FROM parts GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY community) AS size, row_number() OVER (PARTITION BY community ORDER BY n DESC, layer DESC) AS k FROM t)
    SELECT community, CAST(size AS BIGINT) AS size, layer AS value, round(n / size, 6) AS share FROM r WHERE k = 1"""
)
def majority_layers(spark, sf):
    """The commonest layer of each brand."""
    p = parts(spark, sf)
    found = g.majorities(g.contingency(p.select("node", "community"), p.select("node", F.col("layer").alias("value"))))
    return found.withColumn("share", F.round("share", 6))


@query(
    """u AS (SELECT src, dst FROM deps UNION ALL SELECT dst, src FROM deps),
      b AS (SELECT u.src AS node, count(DISTINCT o.community) AS neighbour_communities, count(*) AS boundary_edges FROM u JOIN parts s ON s.node = u.src JOIN parts o ON o.node = u.dst WHERE s.community <> o.community GROUP BY 1)
    SELECT p.node, p.community, coalesce(neighbour_communities, 0) AS neighbour_communities, coalesce(boundary_edges, 0) AS boundary_edges FROM parts p LEFT JOIN b USING (node)"""
)
def bridge_metrics(spark, sf):
    """How far each part bridges brands."""
    return g.bridges(parts(spark, sf).select("node", "community"), depends(spark, sf))


@query("RECURSIVE r AS (SELECT 'part-7' AS node, 0 AS hops UNION SELECT o.dst, r.hops + 1 FROM r JOIN org o ON o.src = r.node) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1", base=_ORG)
def closure_of_part(spark, sf):
    """Everything part 7 depends on, at any distance."""
    return g.closure(organisation(spark, sf), spark.createDataFrame([("part-7",)], "node string"))


@query("RECURSIVE r AS (SELECT DISTINCT dst AS node, 0 AS level FROM org WHERE dst NOT IN (SELECT src FROM org) UNION SELECT o.src, r.level + 1 FROM r JOIN org o ON o.dst = r.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY 1", base=_ORG)
def topological_levels(spark, sf):
    """Dependency levels of parts, suppliers, nations and regions."""
    return g.topological_levels(organisation(spark, sf))


@query(
    """u AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), a AS (SELECT 11 AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM u WHERE src = 11),
      b AS (SELECT node, hops FROM a UNION ALL SELECT u.dst, 2 FROM a JOIN u ON u.src = a.node WHERE a.hops = 1)
    SELECT CAST(node AS BIGINT) AS node, CAST(min(hops) AS INTEGER) AS hops FROM b GROUP BY 1"""
)
def neighbourhood(spark, sf):
    """Parts within two steps of part 11."""
    return g.k_hop(depends(spark, sf), spark.createDataFrame([(11,)], "node long"), 2)


@query(
    """n AS (SELECT DISTINCT dst AS node FROM deps WHERE src = 11 UNION SELECT src FROM deps WHERE dst = 11)
    SELECT src, dst FROM deps WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)"""
)
def neighbourhood_edges(spark, sf):
    """Dependencies among the neighbours of part 11."""
    d = depends(spark, sf)
    near = g.both_ways(d).where("src = 11").select("dst")
    return d.join(near, "dst", "left_semi").join(near.select(F.col("dst").alias("src")), "src", "left_semi").select("src", "dst")


@query(
    """SELECT 'link' AS type, CAST(s.s_nationkey AS VARCHAR) AS source, d.community AS target, count(*) AS weight FROM links l JOIN supplier s ON s.s_suppkey = l.src JOIN parts d ON d.node = l.dst GROUP BY 2, 3
    UNION ALL SELECT 'depends', NULL, b.community, count(*) FROM deps x JOIN parts b ON b.node = x.dst GROUP BY 3"""
)
def two_layer_edges(spark, sf):
    """Edges of the two-layer graph: nations to brands by links, dependencies by brand."""
    brand = parts(spark, sf).select(F.col("node").alias("dst"), F.col("community").alias("target"))
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("string").alias("source"))
    a = links(spark, sf).join(nation, "src").join(brand, "dst").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).select(F.lit("link").alias("type"), "source", "target", "weight")
    b = depends(spark, sf).join(brand, "dst").groupBy("target").agg(F.count(F.lit(1)).alias("weight")).select(F.lit("depends").alias("type"), F.lit(None).cast("string").alias("source"), "target", "weight")
    return a.unionByName(b)


@query(
    """RECURSIVE d AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
      s AS (SELECT min(src) AS n FROM d), f AS (SELECT n FROM s UNION SELECT d.dst FROM f JOIN d ON d.src = f.n), b AS (SELECT n FROM s UNION SELECT d.src FROM b JOIN d ON d.dst = b.n), c AS (SELECT n FROM f INTERSECT SELECT n FROM b)
    SELECT n AS node, (SELECT min(n) FROM c) AS component, (SELECT count(*) FROM c) AS size FROM c"""
)
def strong_components(spark, sf):
    """Strongly connected parts by consecutive lines of orders."""
    return g.strong_components(directed(spark, sf))


@query("SELECT node, (SELECT min(src) FROM (SELECT src FROM org UNION SELECT dst FROM org)) AS component FROM (SELECT src AS node FROM org UNION SELECT dst FROM org)", base=_ORG)
def weak_components(spark, sf):
    """Connected components of parts, suppliers, nations and regions (the line items tie all together)."""
    return g.components(organisation(spark, sf))


@query()
def communities_greedy(spark, sf):
    """Communities of parts, suppliers, nations and regions by greedy modularity."""
    return g.communities(organisation(spark, sf), method="greedy")


@query()
def communities_labels(spark, sf):
    """Communities of parts, suppliers, nations and regions by label propagation."""
    return g.communities(organisation(spark, sf), method="labels")


@query(f"{_IMPLIED} SELECT implied, count(DISTINCT owner) AS owners, count(*) AS ways FROM imp GROUP BY 1")
def implied_clusters(spark, sf):
    """Parts that nations imply without declaring them."""
    return g.clusters(g.implied(_declared(spark, sf), depends(spark, sf)))


@query(
    """c AS (SELECT d.dst AS node, count(*) FILTER (WHERE a.layer = 'mechanism') AS mechanisms, count(*) FILTER (WHERE a.layer = 'accounting') AS accounting, count(*) FILTER (WHERE a.layer = 'failure-state') AS failures FROM deps d JOIN parts a ON a.node = d.src GROUP BY 1)
    SELECT p.node, CAST(2.0 * mechanisms + 0.5 * accounting AS DOUBLE) AS weighted FROM parts p JOIN c USING (node) WHERE p.layer NOT IN ('mechanism', 'failure-state') AND mechanisms >= 3 AND accounting >= 2 AND failures >= 1"""
)
def hub_thresholds(spark, sf):
    """Hubs that reach all thresholds, by weights of one's own."""
    weights = {"mechanisms": 2.0, "accounting": 0.5, "failures": 0.0, "selectors": 0.0, "layers": 0.0}
    found = g.hubs(parts(spark, sf), depends(spark, sf), weights=weights, least={"mechanisms": 3, "accounting": 2, "failures": 1})
    return found.select("node", F.col("score").alias("weighted"))


_SIDES = """side AS (SELECT 'links' AS graph, src, dst FROM x UNION ALL SELECT 'depends', src, dst FROM deps UNION ALL SELECT 'both', src, dst FROM (SELECT src, dst FROM x UNION SELECT src, dst FROM deps)),
  und AS (SELECT DISTINCT graph, least(src, dst) AS a, greatest(src, dst) AS b FROM side WHERE src <> dst), u AS (SELECT graph, a AS src, b AS dst FROM und UNION ALL SELECT graph, b, a FROM und),
  br AS (SELECT u.graph, u.src AS node, count(DISTINCT o.community) AS neighbour_communities, count(*) AS boundary_edges FROM u JOIN parts s ON s.node = u.src JOIN parts o ON o.node = u.dst WHERE s.community <> o.community GROUP BY 1, 2),
  top AS (SELECT g.graph, p.node, p.community, coalesce(neighbour_communities, 0) AS neighbour_communities, coalesce(boundary_edges, 0) AS boundary_edges FROM parts p CROSS JOIN (VALUES ('links'), ('depends'), ('both')) g(graph) LEFT JOIN br ON br.node = p.node AND br.graph = g.graph)"""
_SECOND = "x AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 2 WHERE a.l_partkey <> b.l_partkey)"


def _topology(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    after = items.select("l_orderkey", F.col("l_partkey").alias("dst"), (F.col("l_linenumber") - 2).alias("l_linenumber"))
    second = items.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst")
    by_brand, d = parts(spark, sf).select("node", "community"), depends(spark, sf)
    return g.topology({"links": (by_brand, second), "depends": (by_brand, d), "both": (by_brand, second.unionByName(d))})


@query(f"{_SECOND}, {_SIDES} SELECT * FROM top")
def topology_rows(spark, sf):
    """How far parts bridge brands by links, by dependencies and by both."""
    return _topology(spark, sf)


@query(f"{_SECOND}, {_SIDES} SELECT community, count(*) AS nodes, count(*) FILTER (WHERE neighbour_communities > 0) AS bridges, CAST(sum(boundary_edges) AS BIGINT) AS boundary_edges, round(avg(neighbour_communities), 6) AS mean_neighbours FROM top WHERE graph = 'depends' GROUP BY 1")
def community_summary(spark, sf):
    """Brands with their bridges."""
    found = g.community_summary(g.bridges(parts(spark, sf).select("node", "community"), depends(spark, sf)))
    return found.withColumn("mean_neighbours", F.round("mean_neighbours", 6))


@query(
    """RECURSIVE r AS (SELECT 'part-21' AS node, 0 AS hops UNION SELECT o.dst, r.hops + 1 FROM r JOIN org o ON o.src = r.node), m AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1),
      v AS (SELECT node, 0 AS level FROM m WHERE starts_with(node, 'region') UNION SELECT o.src, v.level + 1 FROM v JOIN org o ON o.dst = v.node WHERE o.src IN (SELECT node FROM m)), x AS (SELECT node, max(level) AS level FROM v GROUP BY 1)
    SELECT m.node, CAST(hops AS INTEGER) AS hops, CAST(level AS INTEGER) AS level, hops = 1 AS direct, starts_with(m.node, 'region') AS missing FROM m JOIN x USING (node)""",
    base=_ORG,
)
def trace_of_part(spark, sf):
    """Everything part 21 rests on in dependency order; regions are no notes here."""
    org = organisation(spark, sf)
    return g.trace(org, spark.createDataFrame([("part-21",)], "node string"), org.select(F.col("src").alias("node")))


@query("l AS (SELECT dst AS node, count(*) AS links FROM deps GROUP BY 1) SELECT node, layer, CASE layer WHEN 'primitive' THEN 0 WHEN 'first-order' THEN 1 WHEN 'mechanism' THEN 2 WHEN 'accounting' THEN 3 ELSE 4 END AS x, CAST(row_number() OVER (PARTITION BY layer ORDER BY node) - 1 AS INTEGER) AS y, round(2 + sqrt(coalesce(links, 0)), 6) AS radius FROM parts LEFT JOIN l USING (node)")
def graph_layout(spark, sf):
    """Where a drawing puts each part."""
    linked = depends(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    return g.layout(parts(spark, sf).join(linked, "node", "left")).withColumn("radius", F.round("radius", 6))


@query("SELECT s.src, s.dst, s.n FROM (SELECT src, dst, n FROM links) s WHERE n > 1")
def repeated_links(spark, sf):
    """Links with their weight where it is more than one."""
    return links(spark, sf).where("n > 1")


@query("d AS (SELECT src AS node, count(*) AS degree FROM (SELECT src, dst FROM deps UNION ALL SELECT dst, src FROM deps) GROUP BY 1) SELECT * FROM d ORDER BY degree DESC, node DESC LIMIT 20")
def top_degrees(spark, sf):
    """The twenty parts of highest degree, ties by the larger name."""
    return g.degrees(depends(spark, sf)).select("node", "degree").orderBy(F.desc("degree"), F.desc("node")).limit(20)
