"""Parent-child links to full hierarchies by pointer doubling.

Every node holds a pointer and the path from itself to just before the node
the pointer names.  Each round joins the unresolved pointers with the state of
the nodes they name and concatenates the path segments, so the distance jumped
doubles; a tree of depth ``d`` is resolved in ``log2(d) + 1`` rounds.  A round
that resolves no further node ends this: the ancestors of an unresolved tree
node have all lesser depths, so what is left leads into cycles.  In deep trees
that is found by pointers alone before segments grow long.  The pointers into
cycles go on, with the smallest key passed, until all of them stand on a cycle
and have seen the whole of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.session import written

#: Rounds after which the nodes that lead into cycles are told apart by pointers alone; until then a segment has at most 2 ** 6 keys.
SEGMENT_ROUNDS = 6


def resolve_paths(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, path, cycle): one row per distinct node.

    ``path`` lists the node and its ancestors up to its root; for a node on or
    below a cycle it is null and ``cycle`` is the smallest key (by code points)
    on that cycle, otherwise null.  Rules: a null node gives no row; a node
    whose parents are all null is a root; of several parents the smallest key
    counts (:func:`several_parents` reports them); a parent that is no node of
    the table makes no link (its child is a root); a node that is its own parent
    is a cycle of one.  Repeated rows count once.  An empty table gives an empty
    result.
    """
    pairs = written(_pairs(links, node, parent), "hierarchy")
    state = written(_real(pairs).groupBy("node").agg(F.min("real").alias("nxt")).select("node", F.array("node").alias("path"), "nxt"), "hierarchy")
    done, undone = [state.where("nxt is null")], state.where("nxt is not null")
    left, rounds, looped = undone.count(), 0, None
    while left:
        if rounds == SEGMENT_ROUNDS and looped is None:
            # Nodes that lead into a cycle would lengthen their segments in vain from here on.
            looped = written(_unresolved(undone.select("node", "nxt")).select("node"), "hierarchy")
            ringed = undone.join(looped, "node", "left_semi")
            undone = written(undone.join(looped, "node", "left_anti"), "hierarchy")
            left = undone.count()
            continue
        known = reduce(DataFrame.unionByName, [*done, undone])
        ahead = known.select(F.col("node").alias("nxt"), F.col("path").alias("more"), F.col("nxt").alias("then"))
        step = written(undone.join(ahead, "nxt").select("node", F.concat("path", "more").alias("path"), F.col("then").alias("nxt")), "hierarchy")
        done.append(step.where("nxt is null"))
        undone, before = step.where("nxt is not null"), left
        left, rounds = undone.count(), rounds + 1
        if left == before:
            ringed = undone
            break
    trees = reduce(DataFrame.unionByName, done).select("node", "path", F.lit(None).cast("string").alias("cycle"))
    if not left and looped is None:
        return trees
    return trees.unionByName(_cycles(ringed).select("node", F.lit(None).cast("array<string>").alias("path"), "cycle"))


def _unresolved(pointers: DataFrame) -> DataFrame:
    """Those of some pointers (node, nxt) that never come to a node without one: the pointer of the pointer, until no more end."""
    left = pointers.count()
    while left:
        ahead = pointers.select(F.col("node").alias("nxt"), F.col("nxt").alias("then"))
        pointers, before = written(pointers.join(ahead, "nxt").select("node", F.col("then").alias("nxt")), "hierarchy"), left
        left = pointers.count()
        if left == before:
            break
    return pointers


def _pairs(links: DataFrame, node: str, parent: str) -> DataFrame:
    return links.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("nxt")).where("node is not null").distinct()


def _real(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``real``: the parent where it is a node of the table."""
    nodes = pairs.select(F.col("node").alias("nxt")).distinct().withColumn("_is", F.lit(True))
    return pairs.join(nodes, "nxt", "left").select("node", F.when(F.col("_is"), F.col("nxt")).alias("real"))


def _cycles(undone: DataFrame) -> DataFrame:
    """(node, cycle) of nodes all of whose pointers lead into cycles: the smallest key of the cycle each reaches.

    ``low`` is the smallest key from a node to just before its pointer.  When
    a round leaves the number of nodes pointed at as it was, jumping that far
    permutes them, so they are the nodes of the cycles; when it lowers no
    ``low`` either, theirs are the smallest of their cycle.
    """
    state = undone.select("node", F.array_min("path").alias("low"), "nxt")
    ends = state.select("nxt").distinct().count()
    if not ends:
        return state.select("node", F.col("low").alias("cycle"))
    while True:
        ahead = state.select(F.col("node").alias("nxt"), F.col("low").alias("far"), F.col("nxt").alias("then"))
        state = written(state.join(ahead, "nxt").select("node", F.least("low", "far").alias("low"), F.col("then").alias("nxt"), F.col("far").alias("cycle"), (F.col("far") < F.col("low")).alias("moved")), "hierarchy")
        seen = state.agg(F.count_distinct("nxt").alias("ends"), F.bool_or("moved").alias("moved")).first()
        if seen.ends == ends and not seen.moved:
            return state.select("node", "cycle")
        ends = seen.ends


def ancestors(paths: DataFrame) -> DataFrame:
    """(node, ancestor, steps) of the result of :func:`resolve_paths`: the node itself at 0; steps -1 and the cycle's smallest key below or on a cycle."""
    up = paths.where("cycle is null").select("node", F.posexplode("path").alias("steps", "ancestor"))
    looped = paths.where("cycle is not null").select("node", F.lit(-1).alias("steps"), F.col("cycle").alias("ancestor"))
    return up.unionByName(looped).select("node", "ancestor", "steps")


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, steps): all nodes below each node of a tree, by the number of steps down; nodes on or below a cycle have none."""
    return paths.where("cycle is null").select(F.col("node").alias("descendant"), F.posexplode("path").alias("steps", "node")).where("steps > 0").select("node", "descendant", "steps")


def hierarchy(paths: DataFrame, sep: str = "/") -> DataFrame:
    """(node, path, depth, root, cycle): the path from the root as text; null path, depth and root where a cycle keeps the node from any root."""
    return paths.select("node", F.array_join(F.reverse("path"), sep).alias("path"), (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("root"), "cycle").withColumn("depth", F.when(F.col("cycle").isNull(), F.col("depth")))


def several_parents(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, parents, taken): nodes with more than one parent that is a node of the table, how many, and the one that counts."""
    return _real(_pairs(links, node, parent)).groupBy("node").agg(F.count("real").alias("parents"), F.min("real").alias("taken")).where("parents > 1")
