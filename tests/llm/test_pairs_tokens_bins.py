from collections import Counter, defaultdict
from itertools import combinations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultweave.llm import queries
from vaultweave.llm.bpe import MergeReplay, token_ids
from vaultweave.llm.cooccurrence import cooccurrences
from vaultweave.llm.packing import best_two_fit, pack
from vaultweave.session import table

PATH = f"{queries.TOKENIZERS}/{queries.BYTE_BPE}"
ODD = [None, "", " ", "a" * 5000, "<|endoftext|> x", "  \n\n  b", "日本" * 300, "é ​ 👩‍👩‍👧 Ⅷ½", "it's we'll", "\x00�"]


def test_pairs_tables(spark, small):
    papers = defaultdict(set)
    for r in table(spark, small, "papers").select("paper", "concepts_linked").collect():
        papers[brute.key(r.paper)] |= {brute.key(v) for v in brute.split(r.concepts_linked)}
    papers = {p: c for p, c in papers.items() if c}
    n, single, pair = len(papers), Counter(), Counter()
    for c in papers.values():
        single.update(c)
        pair.update(combinations(sorted(c), 2))
    want = {(a, b) for (a, b), k in pair.items() if k >= max(5, 0.004 * n) and k * n >= 3 * single[a] * single[b]}
    got = [tuple(r) for r in queries.p4_found(spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_pairs_small(spark):
    rows = [(b, i) for b in range(3000) for i in (f"x{b % 1500:04}", f"y{b % 1500:04}", "common")] * 2 + [(None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "b int, item_a string")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in cooccurrences(df, "b", "item_a", min_count=2, min_lift=1.5).collect()}
    assert len(got) == 1500 and got["x0007", "y0007"] == (2, 2, 2, 3000, 1500.0)
    assert cooccurrences(df.limit(0), "b", "item_a").count() == 0


@pytest.mark.parametrize("listed, chunk", [(500_000, 2_000_000), (0, 50)])
def test_pairs_blocks(spark, monkeypatch, listed, chunk):
    """Sparse and dense blocks, one huge basket, a basket with a third of all rows: equal to brute force."""
    from vaultweave.llm import cooccurrence

    monkeypatch.setattr(cooccurrence, "LISTED_ITEMS", listed)
    monkeypatch.setattr(cooccurrence, "CHUNK", chunk)
    monkeypatch.setattr(cooccurrence, "FOLD", 5_000)
    monkeypatch.setattr(cooccurrence, "HAND_ON", 2_000)
    monkeypatch.setattr(cooccurrence, "DENSE_FILL", 20)
    rng = np.random.default_rng(3)
    rows = [(f"b{b}", f"i{i:05}") for b in range(60) for i in rng.choice(120, 40, replace=False)]
    rows += [(f"s{b}", f"i{i:05}") for b in range(200) for i in rng.choice(4000, 5)]
    rows += [("huge", f"i{i:05}") for i in range(0, 4000, 3)] + [("hot", f"i{i % 7:05}") for i in range(3000)]
    sets = defaultdict(set)
    for b, i in rows:
        sets[b].add(i)
    single, pair = Counter(), Counter()
    for c in sets.values():
        single.update(c)
        pair.update(combinations(sorted(c), 2))
    want = {(a, b): (k, single[a], single[b], len(sets)) for (a, b), k in pair.items() if k >= 2 and k * len(sets) >= 1.1 * single[a] * single[b]}
    df = spark.createDataFrame(rows, "basket string, item string")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrences(df, "basket", "item", min_count=2, min_lift=1.1).collect()}
    assert got == want and len(want) > 1000


def test_many_items(monkeypatch):
    """A product over a million items holds what is there, not a million squared."""
    import pyarrow as pa

    from vaultweave.llm.cooccurrence import _gram

    rng = np.random.default_rng(4)
    items = rng.integers(0, 1_000_000, (20_000, 6))
    lists = pa.array([sorted(set(r)) for r in items.tolist()], pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([lists.slice(s, 10_000)], ["items"]) for s in (0, 10_000)]
    out = list(_gram(iter(batches), lambda x: x))
    assert sum(b.num_rows for b in out) >= 20_000 * 14 and sum(b.column(2).to_numpy().sum() for b in out) == sum(len(x) * (len(x) - 1) // 2 for x in lists.to_pylist())


def test_ids_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    docs = table(spark, small, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in queries.p6_ids(spark, small).collect()}
    assert got == {k: lib.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    odd = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ODD)] * 2, "ids int, text string, key string")
    rows = token_ids(odd, "ids", "text", PATH).toDF("k", "v").collect()
    assert len(rows) == 2 * len(ODD)
    assert all(r.v == lib.encode(ODD[r.k] or "", add_special_tokens=False).ids for r in rows)
    assert token_ids(odd.limit(0), "key", "text", PATH).count() == 0


def test_replay_forgets(monkeypatch):
    from vaultweave.llm import bpe

    coder = MergeReplay(PATH)
    whole = [coder.encode([t])[0].tolist() for t in ODD]
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    coder = MergeReplay(PATH)
    assert [coder.encode([t])[0].tolist() for t in ODD] == whole


def test_best_two_fit():
    rng = np.random.default_rng(1)
    for cap in (1, 7, 100):
        sizes = np.sort(rng.integers(0, cap + 1, 400))[::-1].copy()
        bins = best_two_fit(sizes, cap)
        load = np.bincount(bins, weights=sizes)
        assert load.max() <= cap and len(load) <= -(-sizes.sum() // cap) * 1.05 + 2
    assert best_two_fit(np.array([6, 5, 5, 3], np.int64), 10).tolist() in ([1, 0, 0, 1], [0, 1, 1, 0])
    assert best_two_fit(np.zeros(0, np.int64), 5).tolist() == []


def test_pack(spark):
    items = [(i, s, "z") for i, s in enumerate([0, None, 5, 10, 10, 11, 25, 30, 3, 7, 1, 9])] + [(None, 4, "z"), (2, 5, "z")]
    df = spark.createDataFrame(items, "id int, tokens long, bin string")
    budgets = spark.createDataFrame([("s", 10), ("l", 1000)], "budget string, capacity int")
    for shard in (3, 1000):
        rows = pack(df, budgets, "id", "tokens", shard).collect()
        for name, cap in (("s", 10), ("l", 1000)):
            mine = [r for r in rows if r.budget == name]
            load, spans = Counter(), defaultdict(list)
            for r in mine:
                load[r.bin] += r.tokens
                spans[r.id].append((r.start, r.tokens))
            assert max(load.values()) <= cap and sum(load.values()) == sum(s or 0 for _, s, _ in items)
            assert Counter(r.id for r in mine if r.part == 0) == Counter(i for i, _, _ in items)
            assert sorted(spans[7]) == ([(0, 10), (10, 10), (20, 10)] if cap == 10 else [(0, 30)])
            assert all(r.tokens in (cap, (items[r.id][1] or 0) % cap if r.id is not None else 4) for r in mine)
    assert pack(df.limit(0), budgets, "id", "tokens").count() == 0


def test_pack_tables(spark, small):
    fill = {r.budget: r.fill for r in queries.p7_fill(spark, small).collect()}
    assert fill["short"] > 0.97 and fill["medium"] > 0.93 and max(fill.values()) <= 1
    docs = table(spark, small, "documents").count()
    placed = queries.p7_containers(spark, small).groupBy("budget").agg(F.count_distinct("doc_id").alias("n")).collect()
    assert {r.n for r in placed} == {docs}
