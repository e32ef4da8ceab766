import inspect
import random
from collections import defaultdict

import pytest

from vaultweave.operators import graph as g

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5), (6, 7), (7, 6), (8, 9), (None, 1), (1, 2), (10, 11), (11, 12), (12, 10), (12, 13), (13, 12)]


def frame(spark, edges=EDGES):
    return spark.createDataFrame(edges, "src long, dst long")


def adjacency(edges, both=False):
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            if both:
                near[b].add(a)
    return near


def reach(near, start):
    seen, todo = {start: 0}, [start]
    for x in todo:
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                todo.append(y)
    return seen


def test_closure_and_hops(spark):
    starts = spark.createDataFrame([(3,), (99,)], "node long")
    got = {r.node: r.hops for r in g.closure(frame(spark), starts).collect()}
    assert got == {**reach(adjacency(EDGES), 3), 99: 0}
    near = {r.node: r.hops for r in g.k_hop(frame(spark), starts, 1).collect()}
    assert near == {3: 0, 1: 1, 2: 1, 4: 1, 99: 0}


def test_levels(spark):
    edges = [(5, 3), (5, 4), (3, 1), (4, 1), (4, 2), (7, 8), (8, 7), (9, 7), (1, None)]
    got = {r.node: r.level for r in g.topological_levels(frame(spark, edges), spark.createDataFrame([(20,)], "node long")).collect()}
    assert got == {1: 0, 2: 0, 20: 0, 3: 1, 4: 1, 5: 2}
    assert g.topological_levels(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, rng.choice([a + 1, rng.randrange(60)])) for a in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    near = adjacency(edges, True)
    got = {r.node: r.component for r in g.components(frame(spark, edges), spark.createDataFrame([(500,)], "node long")).collect()}
    assert got == {**{n: min(reach(near, n)) for n in {x for e in edges for x in e}}, 500: 500}


def test_strong_components(spark):
    rng = random.Random(5)
    for edges in (EDGES, [(rng.randrange(30), rng.randrange(30)) for _ in range(45)], []):
        near = adjacency(edges)
        nodes = {x for e in edges for x in e if x is not None}
        groups = {n: frozenset(m for m in nodes if m in reach(near, n) and n in reach(near, m)) for n in nodes}
        want = {n: (min(s), len(s)) for n, s in groups.items() if len(s) > 1}
        assert {r.node: (r.component, r.size) for r in g.strong_components(frame(spark, edges)).collect()} == want


def test_long_paths(spark, monkeypatch):
    """A path and a ring of 3,000: nothing ends early, and not one round per step either."""
    monkeypatch.setattr(g, "ROUNDS", 5)
    n = 3000
    path = [(i, i + 1) for i in range(n)]
    ring = [(10_000 + i, 10_000 + (i + 1) % n) for i in range(n)]
    df = frame(spark, path + ring + [(10_000, 0)])
    got = {r.node: r.hops for r in g.closure(df, spark.createDataFrame([(10_005,)], "node long")).collect()}
    assert len(got) == 2 * n + 1 and got[10_004] == n - 1 and got[n] == n - 5 + 1 + n
    near = {r.node for r in g.closure(frame(spark, path), spark.createDataFrame([(0,)], "node long"), max_rounds=100).collect()}
    assert near == set(range(101))
    assert {(r.node, r.level) for r in g.topological_levels(frame(spark, path)).collect()} == {(i, n - i) for i in range(n + 1)}
    assert {(r.node, r.component, r.size) for r in g.strong_components(df).collect()} == {(10_000 + i, 10_000, n) for i in range(n)}


def test_large_components(spark, monkeypatch):
    """Components too large for one task are found by rounds."""
    monkeypatch.setattr(g, "COMPONENT_EDGES", 3)
    test_strong_components(spark)
    test_closure_and_hops(spark)
    test_levels(spark)


def test_label_sweeps(spark):
    """Levels of waiting nodes move like a sweep node by node."""
    rng = random.Random(13)
    for _ in range(2):
        edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
        near = adjacency([e for e in edges if e[0] != e[1]], True)
        label = {n: n for n in range(26)}
        for _ in range(3):
            for n in sorted(label):
                votes = defaultdict(int)
                for x in near[n]:
                    votes[label[x]] += 1
                if votes:
                    label[n] = min(votes, key=lambda c: (-votes[c], c))
        got = {r.node: r.label for r in g.spread_labels(frame(spark, edges), spark.range(26).toDF("node"), rounds=3).collect()}
        assert got == label


def greedy(nodes, edges):
    und = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    m = len(und)
    deg = {n: sum(n in e for e in und) for n in nodes}
    groups = [[n] for n in sorted(nodes)]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                e = sum((a in groups[i] and b in groups[j]) or (a in groups[j] and b in groups[i]) for a, b in und)
                if e:
                    gain = e / m - sum(deg[x] for x in groups[i]) * sum(deg[x] for x in groups[j]) / (2 * m * m)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, i, j)
        if best is None:
            return sorted((sorted(x) for x in groups), key=lambda x: (-len(x), x[0]))
        _, i, j = best
        groups[i] += groups.pop(j)


def test_communities(spark):
    rng = random.Random(7)
    edges = [(a, b) for k in range(3) for a in range(k * 6, k * 6 + 6) for b in range(k * 6, a) if rng.random() < 0.8] + [(0, 6), (7, 12), (40, 41)]
    got = defaultdict(list)
    for r in g.communities(frame(spark, edges), method="greedy").collect():
        got[r.community].append(r.node)
    want = greedy({x for e in edges for x in e}, edges)
    assert [sorted(got[f"c{i + 1}"]) for i in range(len(want))] == want
    labels = {r.node: r.community for r in g.communities(frame(spark, [(1, 2), (2, 1), (3, 4)]), method="labels").collect()}
    assert labels == {1: "c1", 2: "c1", 3: "c2", 4: "c2"}
    assert {r.community for r in g.communities(frame(spark, [(1, 1)])).collect()} == {"c1"}


def test_communities_of_every_part(spark, small):
    from vaultweave.plans import graph as plans

    nodes = {r.node for r in plans.weak_components(spark, small).collect()}
    assert any(n.startswith("part-") for n in nodes)
    for query in (plans.communities_greedy, plans.communities_labels):
        assert sorted(r.node for r in query(spark, small).collect()) == sorted(nodes)
    rng = random.Random(13)
    edges = sorted({(rng.randrange(40), 100 + rng.randrange(9)) for _ in range(130)})
    got = defaultdict(list)
    for r in g.communities(frame(spark, edges), method="greedy").collect():
        got[r.community].append(r.node)
    assert sorted(sorted(x) for x in got.values()) == sorted(greedy({x for e in edges for x in e}, edges))


def test_communities_of_any_size(spark, monkeypatch):
    """A component above what a loop's rest may have is merged like any other; several components and single nodes beside it."""
    monkeypatch.setattr(g, "COMPONENT_EDGES", 20)
    rng = random.Random(17)
    edges = sorted({(rng.randrange(30), 100 + rng.randrange(8)) for _ in range(110)}) + [(200 + i, 201 + i) for i in range(12)] + [(300, 301), (302, 303), (310, 310)]
    alone = spark.createDataFrame([(400,), (401,)], "node long")
    got = defaultdict(list)
    for r in g.communities(frame(spark, edges), alone, method="greedy").collect():
        got[r.community].append(r.node)
    want = greedy({x for e in edges for x in e} | {400, 401}, edges)
    assert [sorted(got[f"c{i + 1}"]) for i in range(len(want))] == want


def test_greedy_merges_of_a_hub():
    """Twenty thousand leaves around two hubs are merged at once: a merge moves only the pairs of the smaller side."""
    import time

    import numpy as np

    n = 20_000
    leaves = np.arange(2, n, dtype=np.int32)
    x = np.concatenate([[0], np.where(leaves % 2, 1, 0)]).astype(np.int32)
    y = np.concatenate([[1], leaves]).astype(np.int32)
    degree = np.bincount(np.concatenate([x, y]))
    order = np.lexsort((y, x, degree[x] * degree[y]))
    began = time.perf_counter()
    label = g._merge_greedily(x[order], y[order], len(x))
    assert time.perf_counter() - began < 30 and label.tolist() == [0, 1, *(leaves % 2).tolist()]


def test_fit_of_a_partition(spark):
    part = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "node long, community string")
    q = g.modularity(part, frame(spark, [(1, 2), (3, 4)])).first()
    assert (q.communities, q.edges) == (2, 2) and q.modularity == pytest.approx(0.5)
    table = g.contingency(part, spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "node long, value string"))
    fit = g.alignment(table).first()
    assert (fit.nodes, fit.purity) == (4, 1.0) and fit.nmi == pytest.approx(1.0)
    assert g.alignment(g.contingency(part, part.selectExpr("node", "'x' as value"))).first().nmi == 0.0


def test_hubs(spark):
    nodes = spark.createDataFrame([("hub", "primitive"), ("m1", "mechanism"), ("a1", "Accounting"), ("f1", "failure-state"), ("n", None)], "node string, layer string")
    deps = spark.createDataFrame([("m1", "hub"), ("a1", "hub"), ("f1", "hub"), ("m1", "hub")], "src string, dst string")
    found = {r.node: r for r in g.hubs(nodes, deps).collect()}
    assert set(found) == {"hub", "a1", "n"} and (found["hub"].mechanisms, found["hub"].accounting, found["hub"].failures, found["hub"].layers, found["hub"].score) == (1, 1, 1, 3, 6.0)
    assert [r.node for r in g.rank_hubs(g.hubs(nodes, deps), top=2).orderBy("rank").collect()] == ["hub", "n"]


def test_implied(spark):
    got = g.implied(spark.createDataFrame([("d", "load")], "owner string, node string"), spark.createDataFrame([("load", "sum"), ("load", "load")], "src string, dst string")).collect()
    assert [tuple(r) for r in got] == [("d", "sum", "load")]


def test_every_line_item_declares(spark, small):
    from vaultweave.plans import graph as plans
    from vaultweave.session import table

    nation = {r.s_suppkey: r.s_nationkey for r in table(spark, small, "supplier").collect()}
    declared = {(nation[r.l_suppkey], r.l_partkey) for r in table(spark, small, "lineitem").collect()}
    deps = defaultdict(set)
    for r in plans.depends(spark, small).collect():
        deps[r.src].add(r.dst)
    want = {(o, x, v) for o, v in declared for x in deps[v] if (o, x) not in declared}
    got = {r.owner: (r.n_implied, r.n_ways) for r in plans.implied_two_hop(spark, small).collect()}
    assert got == {o: (len({x for p, x, _ in want if p == o}), sum(p == o for p, _, _ in want)) for o in {w[0] for w in want}}
    owners = {r.implied: r.owners for r in plans.junctions_top_via(spark, small).collect()}
    assert owners == {x: len({o for o, y, _ in want if y == x}) for x in {w[1] for w in want}}


def test_closure_has_no_bound_of_its_own():
    assert inspect.signature(g.closure).parameters["max_rounds"].default is None
