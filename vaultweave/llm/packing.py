"""Filling fixed-capacity containers with items of varying length: best-two-fit.

A bin is filled greedily with the largest items that still fit.  Its smallest
item then gives way to two unpacked ones that together fit the expanded gap
more tightly, if there are such.  Items are dealt to shards of bounded size by
a hash, each packed by itself: a shard wastes at most its last bins, so the
share of space lost to sharding shrinks with the shard's size, not with the data.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.session import written

#: Items of a shard: some MB in one task, and thousands of bins, so that open last bins do not count.
SHARD_ITEMS = 20_000


class _Pool:
    """Unpacked items by size: item lists, and the sizes there are in order."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.items: dict[int, list[int]] = {}
        for i in np.argsort(-sizes, kind="stable"):
            self.items.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.items)
        self.has = np.zeros(capacity + 1, bool)
        self.has[self.sizes] = True
        self.many = np.zeros(capacity + 1, bool)
        for s, x in self.items.items():
            self.many[s] = len(x) > 1

    def take(self, size: int) -> int:
        stack = self.items[size]
        item = stack.pop()
        self.many[size] = len(stack) > 1
        if not stack:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
            self.has[size] = False
        return item

    def give(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            insort(self.sizes, size)
            self.has[size] = True
        self.items[size].append(item)
        self.many[size] = len(self.items[size]) > 1

    def largest(self, gap: int) -> int:
        """The largest size up to ``gap``, 0 if none."""
        k = bisect_right(self.sizes, gap)
        return self.sizes[k - 1] if k else 0

    def two(self, most: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes whose sum is largest, at most ``most`` and above ``more_than``."""
        for total in range(most, more_than, -1):
            half = total // 2
            low = self.has[1 : half + 1]
            high = self.has[total - half : total][::-1]
            hit = low & high
            if total % 2 == 0 and half:
                hit[half - 1] = self.many[half]
            k = int(hit.argmax()) if hit.size else 0
            if hit.size and hit[k]:
                return k + 1, total - k - 1
        return None


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each item; sizes lie between 0 and ``capacity``.

    Items of size 0 go into bin 0.  The result depends on the sizes and their order only.
    """
    bins = np.zeros(len(sizes), np.int64)
    real = np.flatnonzero(sizes > 0)
    pool = _Pool(sizes[real], capacity)
    bin_no = 0
    while pool.sizes:
        gap, inside = capacity, []
        while s := pool.largest(gap):
            inside.append((s, pool.take(s)))
            gap -= s
        if gap and pool.sizes:
            smallest, item = inside[-1]
            if pair := pool.two(gap + smallest, smallest):
                inside.pop()
                inside += [(s, pool.take(s)) for s in pair]
                pool.give(smallest, item)
        for _, i in inside:
            bins[real[i]] = bin_no
        bin_no += 1
    return bins


def pack(items: DataFrame, budgets: DataFrame, key: str, size: str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(budget, bin, key, part, start, size): every item in a container of each budget's capacity.

    ``budgets`` has (budget, capacity), one row each.  An item above the
    capacity is cut into parts of ``capacity`` that fill a container each, and a
    rest that is packed like the others; all other items stay whole (part 0,
    start 0).  Null sizes count as 0; items of size 0 are put into their shard's
    first container.  Keys need not be unique, repeated and null ones are
    packed each.  ``bin`` is unique within a budget.
    """
    rows = written(items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")), "sizes")
    shards = max(1, ceil(rows.count() / shard_items))
    caps = [(r.budget, r.capacity) for r in budgets.select("budget", "capacity").distinct().orderBy("capacity", "budget").collect()]
    if any(c is None or c < 1 for _, c in caps):
        raise ValueError("capacities must be positive")
    # The place in the written table takes part, so that one repeated key does not fill one shard.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    kind = rows.schema["key"].dataType.simpleString()

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("key", "ascending")])
        sizes = group.column("size").to_numpy()
        no = group.column("shard")[0].as_py()
        out = []
        for budget, cap in caps:
            full = sizes // cap
            rest = sizes - full * cap
            tail = (rest > 0) | (sizes == 0)
            bins = best_two_fit(rest[tail], cap)
            first = int(bins.max()) + 1 if len(bins) else 0
            of_full = np.repeat(np.arange(len(sizes)), full)
            part = np.arange(len(of_full)) - np.repeat(np.cumsum(full) - full, full)
            item = np.concatenate([np.flatnonzero(tail), of_full])
            start = np.concatenate([(full * cap)[tail], part * cap])
            in_bin = np.concatenate([bins, first + np.arange(len(of_full))]) + (no << 32)
            length = np.concatenate([rest[tail], np.full(len(of_full), cap)])
            parts = np.concatenate([full[tail], part])
            out.append(pa.table({
                "budget": pa.array([budget] * len(item), pa.string()), "bin": in_bin, "key": group.column("key").take(pa.array(item)),
                "part": pa.array(parts, pa.int32()), "start": start, "size": length,
            }))
        return pa.concat_tables(out)

    packed = dealt.groupBy("shard").applyInArrow(shard, f"budget string, bin long, key {kind}, part int, start long, size long")
    return packed.select("budget", "bin", F.col("key").alias(key), "part", "start", F.col("size").alias(size))


def faults(packed: DataFrame, items: DataFrame, budgets: DataFrame, key: str, size: str) -> DataFrame:
    """One row per budget with what must not happen: (budget, capacity, items, lost, overfull, split, loose).

    ``items`` is the number of items given; ``lost`` the size by which the parts
    differ from the items, ``overfull`` the containers above the capacity,
    ``split`` the items in several parts that would have fitted, ``loose`` whether
    more containers were used than one and a hundredth of the least possible
    number, beside one open for each shard.
    """
    caps = budgets.select("budget", "capacity").distinct()
    given = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("_given"))
    bins = packed.groupBy("budget", "bin").agg(F.sum(size).alias("_in"))
    of_bins = bins.join(F.broadcast(caps), "budget").groupBy("budget").agg(F.count(F.lit(1)).alias("_bins"), F.sum("_in").alias("_packed"), F.count_if(F.col("_in") > F.col("capacity")).alias("overfull"), F.count_distinct(F.shiftright("bin", 32)).alias("_shards"))
    parts = packed.groupBy("budget", key).agg(F.count(F.lit(1)).alias("_parts"), F.sum(size).alias("_whole")).join(F.broadcast(caps), "budget")
    of_parts = parts.groupBy("budget").agg(F.count_if((F.col("_parts") > 1) & (F.col("_whole") <= F.col("capacity"))).alias("split"))
    out = caps.join(of_bins, "budget", "left").join(of_parts, "budget", "left").join(F.broadcast(given)).na.fill(0)
    least = F.ceil(F.col("_given") / F.col("capacity"))
    return out.select("budget", "capacity", "items", (F.col("_given") - F.col("_packed")).alias("lost"), "overfull", "split", (F.col("_bins") > 1.01 * least + F.col("_shards")).alias("loose"))


def fill_report(packed: DataFrame, budgets: DataFrame, size: str) -> DataFrame:
    """(budget, capacity, containers, used, fill): how full the containers are."""
    of = packed.groupBy("budget").agg(F.count_distinct("bin").alias("containers"), F.sum(size).alias("used"))
    caps = budgets.select("budget", "capacity").distinct()
    return of.join(F.broadcast(caps), "budget").select("budget", "capacity", "containers", "used", (F.col("used") / (F.col("containers") * F.col("capacity"))).alias("fill"))
