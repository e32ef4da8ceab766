"""Graph operators over edge tables (src, dst); nodes are any orderable keys.

Loops write each round's table into the shared checkpoint folder, so a plan
never grows with the number of rounds and a lost executor re-reads a round.
Where a loop has gone on for ``ROUNDS`` and what is left of the graph proves to
be at most ``COMPONENT_EDGES`` edges, one task does the rest: graphs that need
many rounds are long and thin.  Larger rests stay distributed, however long.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush, heapreplace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.operators.ordering import numbered
from vaultweave.session import fits, written

#: Edges a single task may hold: of a component searched for cycles, of what a loop leaves over.
COMPONENT_EDGES = 2_000_000
#: Rounds of a loop before a small rest is done by one task.
ROUNDS = 24


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: each pair of different linked nodes once; self-loops and nulls dropped."""
    pairs = edges.where("src is not null and dst is not null and src <> dst")
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of every undirected edge in both directions."""
    und = undirected(edges)
    return und.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(und.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree): over distinct edges; self-loops count as out and in, not among the neighbours of ``degree``."""
    end = lambda a, b, o, i: F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    # Each edge once from either end; repeats, and edges both ways, fold in one aggregation by pair.
    ends = edges.where("src is not null and dst is not null").select(F.explode(F.array(end("src", "dst", 1, 0), end("dst", "src", 0, 1))).alias("e")).select("e.*")
    pairs = ends.groupBy("node", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return pairs.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count_if(F.col("node") != F.col("other")).alias("degree"))


def closure(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, hops): everything reachable from ``starts`` (node), the starts included at 0, by the fewest hops.

    ``max_rounds`` bounds the hops; without it the search ends where nothing new is reached.
    Names that are no node of the graph are reached like any other.
    """
    reached = written(starts.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)), "closure")
    frontier, parts = reached, [reached]
    steps = edges.select("src", "dst").where("src is not null and dst is not null")
    for hop in count(1) if max_rounds is None else range(1, max_rounds + 1):
        seen = reduce(DataFrame.unionByName, parts).select("node")
        if hop % ROUNDS == 0:
            parts = [written(reduce(DataFrame.unionByName, parts), "closure")]
            seen = parts[0].select("node")
            # Only edges from the last level and from nodes not reached yet matter any more.
            inner = seen.join(frontier.select("node"), "node", "left_anti").select(F.col("node").alias("src"))
            rest = written(steps.join(inner, "src", "left_anti"), "closure")
            if fits(rest, COMPONENT_EDGES) and fits(parts[0], COMPONENT_EDGES):
                parts.append(_rest_of_search(rest, parts[0], hop - 1, max_rounds))
                break
            steps = rest
        nxt = steps.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(nxt.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "closure")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def _rest_of_search(edges: DataFrame, reached: DataFrame, level: int, most: int | None) -> DataFrame:
    """What a breadth-first search from the nodes at ``level`` finds beyond those reached, in one task."""
    kind = reached.schema["node"].dataType
    nodes = reached.select(F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"), "hops")
    rows = edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), F.lit(None).cast("int").alias("hops")).unionByName(nodes)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf.hops.notna()]
        links = pdf[pdf.hops.isna()]
        ahead = defaultdict(list)
        for a, b in zip(links.src.tolist(), links.dst.tolist()):
            ahead[a].append(b)
        seen = set(known.dst.tolist())
        line = deque((n, level) for n in known.loc[known.hops == level, "dst"].tolist())
        found = []
        while line:
            n, hops = line.popleft()
            if most is not None and hops >= most:
                continue
            for x in ahead.get(n, ()):
                if x not in seen:
                    seen.add(x)
                    line.append((x, hops + 1))
                    found.append((x, hops + 1))
        return pd.DataFrame({"node": pd.Series([n for n, _ in found], dtype=pdf.dst.dtype), "hops": pd.Series([h for _, h in found], dtype="int32")})

    return rows.groupBy().applyInPandas(search, f"node {kind.simpleString()}, hops int")


def k_hop(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(node, hops) within ``k`` steps over undirected edges; all of the component for -1."""
    return closure(both_ways(edges), starts, max_rounds=k if k >= 0 else None)


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): 0 for nodes that depend on nothing, else one above their highest dependency; nodes on or above a cycle are left out.

    An edge goes from a node to what it depends on.  Each round peels the nodes
    all of whose dependencies are peeled.
    """
    es = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    every = es.select(F.col("src").alias("node")).unionByName(es.select(F.col("dst").alias("node")))
    every = (every.unionByName(nodes.select("node")) if nodes is not None else every).distinct()
    # Open dependencies by node: one table holds what is left, a node without any stands with a null.
    left = written(every.join(es.select(F.col("src").alias("node"), "dst"), "node", "left"), "levels")
    parts = []
    for level in count():
        # A node is ready if all that is left of it is its null.
        ready = written(left.groupBy("node").agg(F.count("dst").alias("open")).where("open = 0").select("node", F.lit(level).alias("level")), "levels")
        if ready.isEmpty():
            break
        parts.append(ready)
        gone = ready.select("node")
        rest = left.join(gone, "node", "left_anti").join(gone.select(F.col("node").alias("dst"), F.lit(True).alias("_met")), "dst", "left")
        left = written(rest.select("node", F.when(F.col("_met").isNull(), F.col("dst")).alias("dst")).distinct(), "levels")
        if level == ROUNDS and fits(left, COMPONENT_EDGES):
            parts.append(_rest_of_levels(left, level + 1))
            break
    return reduce(DataFrame.unionByName, parts) if parts else every.limit(0).withColumn("level", F.lit(0))


def _rest_of_levels(left: DataFrame, first: int) -> DataFrame:
    """(node, level) of what can be peeled off (node, dst) from level ``first`` on, in one task."""
    kind = left.schema["node"].dataType.simpleString()

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        waits: dict = dict.fromkeys(pdf.node.tolist(), 0)
        users = defaultdict(list)
        some = pdf[pdf.dst.notna()]
        for n, d in zip(some.node.tolist(), some.dst.astype(pdf.node.dtype).tolist()):
            waits[n] += 1
            users[d].append(n)
        line = deque((n, first) for n, w in waits.items() if not w)
        found = []
        while line:
            n, level = line.popleft()
            found.append((n, level))
            for u in users.get(n, ()):
                waits[u] -= 1
                if not waits[u]:
                    line.append((u, level + 1))
        return pd.DataFrame({"node": pd.Series([n for n, _ in found], dtype=pdf.node.dtype), "level": pd.Series([x for _, x in found], dtype="int32")})

    return left.groupBy().applyInPandas(peel, f"node {kind}, level int")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of its weakly connected component.

    Alternates joining each node to the smallest label around it with jumping
    to the label's own label, so long chains shorten by half each round.
    """
    es = written(both_ways(edges), "components")
    every = es.select(F.col("src").alias("node"))
    loops = edges.where("src is not null").select(F.col("src").alias("node"))
    every = reduce(DataFrame.unionByName, [every, loops, *([nodes.select("node")] if nodes is not None else [])]).distinct()
    labels = written(every.withColumn("component", F.col("node")), "components")
    while True:
        near = es.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("low"), F.col("component").alias("was"))
        # The label a node had passes the lower one on to all that share it.
        best = low.groupBy("was").agg(F.min("low").alias("best"))
        hooked = low.join(best, "was").select("node", F.least("low", "best").alias("mid"), "was")
        jump = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        nxt = written(hooked.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), (F.least("mid", F.coalesce("far", "mid")) != F.col("was")).alias("moved")), "components")
        labels = nxt.select("node", "component")
        if nxt.where("moved").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size): strongly connected components of two nodes or more; self-loops are none.

    Nodes without way in or out are trimmed a few times.  Weak components of at
    most ``COMPONENT_EDGES`` edges are then searched by one task each; in larger
    ones every node takes the largest key that reaches it, and what reaches that
    key back among nodes of the same colour is its component, and so on.
    """
    left = written(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), "scc")
    n = left.count()
    for _ in range(3):
        left, was = _trimmed(left), n
        n = left.count()
        if n == was:
            break
    kind = left.schema["src"].dataType.simpleString()
    if not n:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    weak = components(left)
    placed = written(left.join(weak.select(F.col("node").alias("src"), F.col("component").alias("part")), "src"), "scc")
    sizes = written(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "scc")
    small = placed.join(sizes.where(F.col("n") <= COMPONENT_EDGES).select("part"), "part", "left_semi")
    out = small.groupBy("part").applyInPandas(_search_components, f"node {kind}, component {kind}, size long")
    large = sizes.where(F.col("n") > COMPONENT_EDGES)
    if large.isEmpty():
        return out
    return out.unionByName(_by_colours(written(placed.join(large.select("part"), "part", "left_semi").select("src", "dst"), "scc")))


def _trimmed(left: DataFrame) -> DataFrame:
    """Edges between nodes that have a way in and a way out."""
    core = left.select(F.col("dst").alias("node")).distinct().join(left.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return written(left.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc")


def _search_components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth-first search with low links over one weak component; its own stack, so that depth does not matter."""
    names = sorted(set(pdf.src.tolist()) | set(pdf.dst.tolist()))
    place = {n: i for i, n in enumerate(names)}
    ahead: list[list[int]] = [[] for _ in names]
    for a, b in zip(pdf.src.tolist(), pdf.dst.tolist()):
        ahead[place[a]].append(place[b])
    order, low, done, open_, rows = [0] * len(names), [0] * len(names), [False] * len(names), [], []
    clock = 0
    for root in range(len(names)):
        if order[root]:
            continue
        clock += 1
        order[root] = low[root] = clock
        open_.append(root)
        walk = [(root, iter(ahead[root]))]
        while walk:
            v, ways = walk[-1]
            for w in ways:
                if not order[w]:
                    clock += 1
                    order[w] = low[w] = clock
                    open_.append(w)
                    walk.append((w, iter(ahead[w])))
                    break
                if not done[w]:
                    low[v] = min(low[v], order[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == order[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(open_.pop())
                        done[group[-1]] = True
                    if len(group) > 1:
                        rows += [(names[g], names[min(group)], len(group)) for g in group]
    return pd.DataFrame({"node": pd.Series([r[0] for r in rows], dtype=pdf.src.dtype), "component": pd.Series([r[1] for r in rows], dtype=pdf.src.dtype), "size": pd.Series([r[2] for r in rows], dtype="int64")})


def _by_colours(left: DataFrame) -> DataFrame:
    found = []
    while True:
        m = left.count()
        while True:
            left, was = _trimmed(left), m
            m = left.count()
            if m == was:
                break
        if m == 0:
            break
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")), "scc")
        while True:
            into = left.join(colour.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            nxt = written(colour.join(into, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), (F.coalesce("c", "colour") > F.col("colour")).alias("moved")), "scc")
            colour = nxt.select("node", "colour")
            if nxt.where("moved").isEmpty():
                break
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd")
        back = written(same.select(F.struct("cs", "dst").alias("src"), F.struct("cs", "src").alias("dst")), "scc")
        roots = colour.where("node = colour").select(F.struct(F.col("colour").alias("cs"), F.col("node").alias("dst")).alias("node"))
        members = _reached(back.select("src", F.col("dst").cast(back.schema["src"].dataType).alias("dst")), roots).select(F.col("node.dst").alias("node"), F.col("node.cs").alias("key"))
        members = written(members, "scc")
        found.append(members)
        left = written(left.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
    all_ = reduce(DataFrame.unionByName, found)
    per = all_.groupBy("key").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return all_.join(per, "key").select("node", "component", "size")


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) of everything reachable, by rounds alone."""
    known = written(starts.select("node").distinct(), "closure")
    frontier, parts = known, [known]
    while True:
        nxt = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(nxt.join(reduce(DataFrame.unionByName, parts), "node", "left_anti"), "closure")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(frontier)
        if len(parts) == ROUNDS:
            parts = [written(reduce(DataFrame.unionByName, parts), "closure")]


# -- communities ---------------------------------------------------------------


def spread_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): label propagation, every node in the order of the keys taking the commonest label around it, ties to the smallest.

    A sweep in order means that a node sees the new labels of the smaller nodes
    around it and the old ones of the larger.  Nodes that only wait for nodes
    already seen to therefore move together: the levels of the graph whose edges
    lead from larger to smaller keys, one round each.  Ends with a sweep that
    moves nothing, or after ``rounds`` sweeps.
    """
    near = written(both_ways(edges), "labels")
    und = undirected(edges)
    levels = written(topological_levels(und.select(F.col("b").alias("src"), F.col("a").alias("dst")), nodes), "labels")
    around = written(near.join(levels.select(F.col("node").alias("src"), "level"), "src"), "labels")
    last = levels.agg(F.max("level")).first()[0]
    labels = levels.select("node", F.col("node").alias("label"))
    for _ in range(max(1, rounds)):
        moved = False
        for level in range((last if last is not None else -1) + 1):
            votes = around.where(F.col("level") == level).join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
            pick = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("node", F.col("best.label").alias("pick"))
            step = written(labels.join(pick, "node", "left").select("node", F.coalesce("pick", "label").alias("label"), (F.coalesce("pick", "label") != F.col("label")).alias("moved")), "labels")
            labels = step.select("node", "label")
            moved = moved or not step.where("moved").isEmpty()
        if not moved:
            break
    return labels


def _around(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of every node of the edges (x, y), one node's after the other's, and where each node's begin."""
    ends = np.zeros(n + 1, np.int64)
    step = 4_000_000
    parts = [(p[s : s + step], q[s : s + step]) for p, q in ((x, y), (y, x)) for s in range(0, len(x), step)]
    for p, _ in parts:
        ends[1:] += np.bincount(p, minlength=n)
    starts = np.cumsum(ends)
    near, at = np.empty(2 * len(x), np.int32), starts[:-1].copy()
    for p, q in parts:
        order = np.argsort(p, kind="stable")
        p = p[order]
        near[at[p] + np.arange(len(p)) - np.searchsorted(p, p)] = q[order]
        at += np.bincount(p, minlength=n)
    return near, starts


def _merge_greedily(x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Greedy modularity: the merge of two linked communities that gains most, while any gains; ties to the first pair.

    The edges of a component, ``x`` < ``y``, nodes numbered from 0, in the order
    of the product of their degrees, then of ``x`` and ``y``; gives each node the
    first of its community.  Gains are whole numbers, 2 m² times those of
    modularity: 2 m for each edge between, less the product of the degrees.

    Pairs of nodes not merged yet come in the order of the edges.  A community of
    several keeps its pairs by the number of edges between: among those the
    neighbour of the smallest degree gains most, whatever its own degree grows
    to, so a merge moves no other pair.  Degrees only grow: a gain noted before is
    never too low while the edges between are the same, and is made anew when it
    comes first.  Nodes not merged yet hold nothing but their part of the edges.
    """
    n, twice = int(y.max()) + 1, 2 * m
    near, starts = _around(x, y, n)
    degree = np.diff(starts)
    total, first = degree.tolist(), list(range(n))
    root, lone = np.arange(n, dtype=np.int32), np.ones(n, bool)
    members: dict[int, list[int]] = {}
    between: dict[int, dict[int, int]] = {}
    #: Of a community, by edges between: a heap of neighbours as degree << 32 | first node, and the entry of ``heap`` for it.
    waiting: dict[int, dict[int, list]] = {}
    heap: list[tuple[int, int, int, int, int]] = []

    def post(own: int, e: int, line: list) -> None:
        gain, a, b = total[own] * (line[0][0] >> 32) - twice * e, first[own], line[0][0] & 0xFFFFFFFF
        if gain >= 0:
            del waiting[own][e]
            return
        line[1] = (gain, a, b, own, e) if a < b else (gain, b, a, own, e)
        heappush(heap, line[1])

    def offer(own: int, other: int, e: int) -> None:
        if total[own] * total[other] < twice * e:
            code = total[other] << 32 | first[other]
            line = waiting[own].get(e)
            if line is None:
                line = waiting[own][e] = [[code], None]
            else:
                heappush(line[0], code)
            if line[0][0] == code:
                post(own, e, line)

    def settle(own: int, e: int, codes: list[int]) -> int | None:
        """The neighbour that gains most by ``e`` edges; passes over those that have changed since."""
        mine = between[own]
        while codes:
            code = codes[0]
            other = int(root[code & 0xFFFFFFFF])
            if other == own or mine.get(other) != e:
                heappop(codes)
            elif code == (now := total[other] << 32 | first[other]):
                return other
            elif total[other] > total[own] and other in waiting:
                heappop(codes)
                offer(other, own, e)
            else:
                heapreplace(codes, now)
        return None

    def counted(a: int) -> tuple[list[int], list[int]]:
        found, edges = np.unique(root[near[starts[a] : starts[a + 1]]], return_counts=True)
        return found.tolist(), edges.tolist()

    def begin(a: int) -> None:
        """Makes a node a community of its own."""
        found, edges = counted(a)
        between[a], waiting[a], members[a], lone[a] = dict(zip(found, edges)), {}, [a], False
        others = np.array(found)
        others = others[lone[others]]
        if codes := np.sort(degree[others] << 32 | others).tolist():
            waiting[a][1] = [codes, None]
            post(a, 1, waiting[a][1])

    def merge(a: int, b: int) -> None:
        if lone[a] and lone[b]:
            a, b = (a, b) if total[a] >= total[b] else (b, a)
            begin(a)
        elif lone[a] or not lone[b] and len(between[a]) < len(between[b]):
            a, b = b, a
        if lone[b]:
            links, inside = zip(*counted(b)), [b]
            lone[b] = False
        else:
            links, inside = between.pop(b).items(), members.pop(b)
            del waiting[b]
        mine = between[a]
        del mine[b]
        total[a] += total[b]
        first[a] = min(first[a], first[b])
        root[inside] = a
        members[a] += inside
        for c, e in links:
            if c == a:
                continue
            mine[c] = e = mine.get(c, 0) + e
            if (theirs := between.get(c)) is not None:
                del theirs[b]
                theirs[a] = e
                if total[c] > total[a]:
                    offer(c, a, e)
                    continue
            offer(a, c, e)

    at = 0
    while True:
        while at < len(x) and not (lone[x[at]] and lone[y[at]]):
            both = lone[x[at : at + 1000]] & lone[y[at : at + 1000]]
            at += int(both.argmax()) if both.any() else len(both)
        pair = None
        if at < len(x):
            a, b = int(x[at]), int(y[at])
            pair = (total[a] * total[b] - twice, a, b) if total[a] * total[b] < twice else None
        best = None
        while heap and best is None and (pair is None or heap[0] < pair):
            entry = heappop(heap)
            own, e = entry[3:]
            line = waiting[own].get(e) if own in waiting else None
            if line is None or line[1] is not entry:
                continue
            other = settle(own, e, line[0])
            if other is None:
                del waiting[own][e]
                continue
            a, b = first[own], first[other]
            if (total[own] * total[other] - twice * e, min(a, b), max(a, b)) == entry[:3]:
                best = own, other
                heappop(line[0])
            if line[0]:
                post(own, e, line)
            else:
                del waiting[own][e]
        if best is None and pair is None:
            return np.array(first)[root]
        merge(*(best or pair[1:]))


def communities(edges: DataFrame, nodes: DataFrame | None = None, method: str = "greedy", rounds: int = 20) -> DataFrame:
    """(node, community): ``c1``, ``c2``, ... by size, then first member.

    ``method`` is ``greedy`` (modularity) or ``labels`` (propagation, see
    :func:`spread_labels`).  Greedy merges are sequential, but decide within a
    connected component by the number of all edges alone, so components are
    worked through in parallel, each in one task whatever its size: nodes are
    numbered and edges ordered before, so a task holds sixteen bytes an edge and
    what its communities of several nodes are linked to.  A graph without edges
    is one community by ``greedy``, single ones by ``labels``.
    """
    und = written(undirected(edges), "communities")
    every = [und.select(F.explode(F.array("a", "b")).alias("node")), edges.where("src is not null").select(F.col("src").alias("node"))]
    every += [nodes.select("node")] if nodes is not None else []
    named = reduce(DataFrame.unionByName, every).distinct()
    if method == "labels":
        return _named(written(spread_labels(und.select(F.col("a").alias("src"), F.col("b").alias("dst")), named, rounds), "communities"))
    parts = components(edges, nodes)
    m = und.count()
    if m == 0:
        return parts.select("node", F.lit("c1").alias("community"))
    # A component's nodes stand together: each has a number of its own and a place in its component.
    found = numbered(parts, "component", "node")
    starts = found.groupBy("component").agg(F.min("number").alias("start"))
    ends = und.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    placed = written(found.join(starts, "component").join(ends, "node", "left").select("node", "number", "start", (F.col("number") - F.col("start")).cast("int").alias("place"), "degree"), "communities")
    low = placed.select(F.col("node").alias("a"), "start", F.col("place").alias("x"), F.col("degree").alias("da"))
    high = placed.select(F.col("node").alias("b"), F.col("place").alias("y"), F.col("degree").alias("db"))
    rows = und.join(low, "a").join(high, "b").select("start", "x", "y", (F.col("da") * F.col("db")).alias("product"))
    whole = rows.repartition("start").sortWithinPartitions("start", "product", "x", "y").select("start", "x", "y")
    labels = whole.mapInArrow(lambda batches: _merged(batches, m), "number long, label long")
    return _named(written(placed.join(labels, "number", "left").select("node", F.coalesce("label", "number").alias("label")), "communities"))


def _merged(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """(number, label) of the nodes of each component; its edges (start, x, y) stand together, ordered for :func:`_merge_greedily`."""

    def label(start: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        first = _merge_greedily(x, y, m) + start
        for s in range(0, len(first), 100_000):
            part = first[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + (s + start), pa.int64()), pa.array(part, pa.int64())], ["number", "label"])

    begun, parts = None, []
    for batch in batches:
        start, x, y = (c.to_numpy() for c in batch.columns)
        cuts = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), len(start)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if parts and begun != start[s]:
                yield from label(begun, parts)
            begun = int(start[s])
            parts.append((x[s:e].copy(), y[s:e].copy()))
    if parts:
        yield from label(begun, parts)


def _named(found: DataFrame) -> DataFrame:
    """(node, community) of (node, label): labels numbered by size, then first member."""
    groups = found.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    names = numbered(groups, F.desc("size"), "first").select("label", F.concat(F.lit("c"), F.col("number")).alias("community"))
    return found.join(names, "label").select("node", "community")


# -- how a partition fits ---------------------------------------------------------


def modularity(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """(communities, edges, modularity) of a partition (node, community); 0 without edges."""
    und = undirected(edges)
    total = und.agg(F.count(F.lit(1)).alias("m"))
    ends = und.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    weight = partition.join(ends, "node", "left").groupBy("community").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    side = lambda s: partition.select(F.col("node").alias(s), F.col("community").alias(f"c{s}"))
    inner = und.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    terms = weight.join(inner, "community", "left").join(F.broadcast(total))
    q = F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2))
    return terms.agg(F.count(F.lit(1)).alias("communities"), F.max("m").alias("edges"), F.coalesce(q, F.lit(0.0)).alias("modularity"))


def within_fraction(attribute: DataFrame, edges: DataFrame) -> DataFrame:
    """(edges, fraction): the share of undirected edges whose ends have the same ``value`` (node, value), of those where both have one."""
    side = lambda s: attribute.where("value is not null").select(F.col("node").alias(s), F.col("value").alias(f"v{s}"))
    joined = undirected(edges).join(side("a"), "a").join(side("b"), "b")
    return joined.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.avg((F.col("va") == F.col("vb")).cast("double")), F.lit(0.0)).alias("fraction"))


def contingency(partition: DataFrame, attribute: DataFrame) -> DataFrame:
    """(community, value, n) over the nodes that have both."""
    return partition.join(attribute.where("value is not null"), "node").groupBy("community", "value").agg(F.count(F.lit(1)).alias("n"))


def majorities(table: DataFrame) -> DataFrame:
    """(community, size, value, share): the commonest value of each community, ties to the larger value."""
    best = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), F.desc("value")))
    size = F.sum("n").over(Window.partitionBy("community"))
    return table.withColumn("size", size).withColumn("k", best).where("k = 1").select("community", "size", "value", (F.col("n") / F.col("size")).alias("share"))


def alignment(table: DataFrame) -> DataFrame:
    """(nodes, purity, nmi) of a contingency table: NMI by natural logarithm over the geometric mean, 0 if either side has one value."""
    total = F.broadcast(table.agg(F.sum("n").alias("t")))
    rows = table.groupBy("community").agg(F.sum("n").alias("nc"), F.max("n").alias("top"))
    cols = table.groupBy("value").agg(F.sum("n").alias("nv"))
    entropy = lambda df, c, name: df.join(total).agg(F.sum(-(F.col(c) / F.col("t")) * F.log(F.col(c) / F.col("t"))).alias(name))
    mi = table.join(rows, "community").join(cols, "value").join(total)
    info = mi.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nc") * F.col("nv")))).alias("mi"), F.max("t").alias("nodes"))
    pure = rows.agg(F.sum("top").alias("top"))
    one = info.join(pure).join(entropy(rows, "nc", "hc")).join(entropy(cols, "nv", "hv"))
    nmi: Column = F.when((F.col("hc") < 1e-15) | (F.col("hv") < 1e-15), F.lit(0.0)).otherwise(F.col("mi") / F.sqrt(F.col("hc") * F.col("hv")))
    return one.select("nodes", (F.col("top") / F.col("nodes")).alias("purity"), nmi.alias("nmi"))


def bridges(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, neighbour_communities, boundary_edges) of every node of the partition."""
    far = both_ways(edges).join(partition.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst")
    near = far.join(partition.select(F.col("node").alias("src"), "community"), "src").where("other <> community")
    counted = near.groupBy(F.col("src").alias("node")).agg(F.count_distinct("other").alias("neighbour_communities"), F.count(F.lit(1)).alias("boundary_edges"))
    return partition.join(counted, "node", "left").na.fill(0, ["neighbour_communities", "boundary_edges"])


#: Weights of a hub's score by what depends on it.
HUB_WEIGHTS = {"mechanisms": 1.0, "accounting": 1.0, "failures": 1.0, "selectors": 1.0, "layers": 1.0}


def hubs(
    nodes: DataFrame, depends: DataFrame, others: DataFrame | None = None, exclude: tuple[str, ...] = ("mechanism", "failure-state"), weights: dict[str, float] | None = None, least: dict[str, int] | None = None
) -> DataFrame:
    """One row per node (node, layer) outside ``exclude``: its dependents by layer, distinct layers, other dependents, class and score.

    ``depends`` (src depends on dst) links nodes; ``others`` (src, dst) adds
    dependents that are no nodes.  Counts are of distinct dependents.
    ``weights`` change how much each count adds to the score; ``least`` leaves
    only nodes that reach all of its counts.
    """
    layered = nodes.select("node", F.lower(F.trim(F.coalesce("layer", F.lit("unknown")))).alias("layer"))
    links = depends.select("src", "dst").distinct().join(layered.select(F.col("node").alias("src"), F.col("layer").alias("of")), "src")
    of = lambda *names: F.count_if(F.col("of").isin(*names))
    counted = links.groupBy(F.col("dst").alias("node")).agg(
        of("mechanism").alias("mechanisms"), of("accounting").alias("accounting"), of("failure-state").alias("failures"),
        of("selector", "meta-analytical").alias("selectors"), F.count_distinct("of").alias("layers"), F.count(F.lit(1)).alias("dependents"),
    )
    out = layered.where(~F.col("layer").isin(*exclude)).join(counted, "node", "left")
    if others is not None:
        foreign = others.select(F.col("src").cast("string").alias("src"), "dst").distinct().join(layered.select(F.col("node").cast("string").alias("src")), "src", "left_anti")
        out = out.join(foreign.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("others")), "node", "left")
    else:
        out = out.withColumn("others", F.lit(0).cast("long"))
    out = out.na.fill(0, [*HUB_WEIGHTS, "dependents", "others"])
    for name, at_least in (least or {}).items():
        out = out.where(F.col(name) >= at_least)
    weight = HUB_WEIGHTS | (weights or {})
    score = sum((F.col(c) * float(w) for c, w in weight.items()), F.lit(0.0))
    return out.withColumn("hub_class", hub_class()).withColumn("score", score)


def hub_class() -> Column:
    """What kind of hub a row of :func:`hubs` is."""
    name = F.lower(F.trim(F.col("node").cast("string")))
    rest = F.col("accounting") + F.col("failures") + F.col("selectors")
    return (
        F.when(F.col("layer").isin("primitive", "foundational"), "Primitive hub")
        .when(name.contains("load") | name.endswith("-set"), "Aggregation hub")
        .when((F.col("mechanisms") >= 2) & (rest >= 2), "Mechanism-output hub")
        .when((F.col("mechanisms") > 0) & (F.col("accounting") > 0) & (F.col("failures") > 0), "Cross-layer hub")
        .otherwise("Hub-adjacent")
    )


def rank_hubs(found: DataFrame, by: str = "spread", top: int = 50) -> DataFrame:
    """The ``top`` hubs with ``rank``: by ``spread`` over layers first, or by ``score``; names break ties, last first."""
    total = F.col("dependents") + F.col("others")
    if by == "score":
        order = ["score", "layers", total, "mechanisms", "accounting", "failures", "selectors", "node"]
    else:
        order = [F.col("mechanisms") > 0, F.col("accounting") > 0, F.col("failures") > 0, "layers", "mechanisms", "accounting", "failures", total, "node"]
    keys = [(F.col(o) if isinstance(o, str) else o).desc() for o in order]
    best = found.orderBy(*keys).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def implied(declared: DataFrame, depends: DataFrame) -> DataFrame:
    """(owner, implied, via): what the things an owner declares (owner, node) depend on without the owner declaring it."""
    two = declared.select("owner", F.col("node").alias("via")).distinct().join(depends.select(F.col("src").alias("via"), F.col("dst").alias("implied")).distinct(), "via")
    return two.join(declared.select("owner", F.col("node").alias("implied")).distinct(), ["owner", "implied"], "left_anti").select("owner", "implied", "via")


def clusters(implied_rows: DataFrame) -> DataFrame:
    """(implied, owners, ways): what several owners imply without declaring it: by how many and in how many ways."""
    return implied_rows.groupBy("implied").agg(F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("ways"))


def simple_cycles(edges: DataFrame, most: int = 10) -> DataFrame:
    """(cycle): simple cycles of at most ``most`` nodes, each once as the list of its nodes from the smallest on; self-loops are cycles of one.

    Paths grow from their smallest node through larger ones inside strongly
    connected components only, so each cycle is found from one start.
    """
    plain = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    inside = strong_components(plain).select("node", "component")
    side = lambda c: inside.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    ring = written(plain.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst").select("src", "dst"), "cycles")
    found = [plain.where("src = dst").select(F.array("src").alias("cycle"))]
    paths = ring.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    for _ in range(most - 1):
        step = written(paths.join(ring.select(F.col("src").alias("end"), F.col("dst").alias("nxt")), "end").where(F.col("nxt") >= F.element_at("path", 1)), "cycles")
        found.append(step.where(F.col("nxt") == F.element_at("path", 1)).select(F.col("path").alias("cycle")))
        paths = step.where(~F.array_contains("path", F.col("nxt"))).select(F.concat("path", F.array("nxt")).alias("path"), F.col("nxt").alias("end"))
        if paths.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def trace(edges: DataFrame, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hops, level, direct, missing): what a node depends on at any distance, in dependency order; ``missing`` names no node of ``nodes``."""
    inside = closure(edges, start)
    kept = edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi")
    levels = topological_levels(kept, inside)
    known = nodes.select("node").distinct().withColumn("_is", F.lit(True))
    out = inside.join(levels, "node", "left").join(known, "node", "left")
    return out.select("node", "hops", "level", (F.col("hops") == 1).alias("direct"), F.col("_is").isNull().alias("missing"))


def topology(partitions: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(graph, node, community, neighbour_communities, boundary_edges): :func:`bridges` of several graphs, each a (partition, edges)."""
    return reduce(DataFrame.unionByName, [bridges(p, e).select(F.lit(name).alias("graph"), "node", "community", "neighbour_communities", "boundary_edges") for name, (p, e) in partitions.items()])


def community_summary(found: DataFrame) -> DataFrame:
    """(community, nodes, bridges, boundary_edges, mean_neighbours) of :func:`bridges`."""
    return found.groupBy("community").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("neighbour_communities") > 0).alias("bridges"), F.sum("boundary_edges").alias("boundary_edges"), F.avg(F.coalesce("neighbour_communities", F.lit(0))).alias("mean_neighbours")
    )


def layout(nodes: DataFrame, order: str = "node") -> DataFrame:
    """(node, layer, x, y, radius): where a drawing puts each node (node, layer, links): layers from left to right, names from top to bottom, larger with more links."""
    from vaultweave.functions.signals import layer_rank

    y = F.row_number().over(Window.partitionBy("layer").orderBy(order)) - 1
    return nodes.select("node", "layer", layer_rank(F.col("layer")).alias("x"), y.alias("y"), (2 + F.sqrt(F.coalesce("links", F.lit(0)))).alias("radius"))


def pack(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, level, reason, place): ``start`` (node) with all it depends on, dependencies first, and why each is there: itself, direct or transitive."""
    inside = closure(edges, start)
    levels = topological_levels(edges.join(inside.select(F.col("node").alias("src")), "src", "left_semi"), inside)
    why = F.when(F.col("hops") == 0, "itself").when(F.col("hops") == 1, "direct").otherwise("transitive")
    return numbered(levels.join(inside, "node").select("node", "level", why.alias("reason")), "level", "node", number="place")
