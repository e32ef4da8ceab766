"""References to records that do not exist, or not at the time of the reference.

References are grouped by the null mask of their (composite) key; each mask is
joined on its non-null columns only, under the declared match semantics of SQL:

* ``simple``: a key with any null is not checked;
* ``partial``: the non-null columns must match some target, an all-null key is not checked;
* ``full``: an all-null key is not checked, a partly null one is an orphan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultweave.session import fits

MATCHES = ("simple", "partial", "full")
#: Targets of at most so many rows are broadcast: the check reads that many rows, and a row of keys and times is under 200 bytes.
LOOKUP_ROWS = 20_000
_SINCE, _UNTIL, _HAS = "_since", "_until", "_has"


def _lifetimes(targets: DataFrame, keys: Sequence[str], created: str | None, removed: str | None) -> DataFrame:
    """One row per key: since the earliest creation (null: always), until the latest removal (null: still)."""
    at = lambda c: F.col(c) if c else F.lit(None).cast("timestamp_ntz")
    low, high = at(created), at(removed)
    return (
        targets.select(*keys, low.alias("_c"), high.alias("_r"))
        .groupBy(*keys)
        .agg(
            F.when(F.count("_c") == F.count(F.lit(1)), F.min("_c")).alias(_SINCE),
            F.when(F.count("_r") == F.count(F.lit(1)), F.max("_r")).alias(_UNTIL),
        )
        .withColumn(_HAS, F.lit(True))
    )


def _kind(when: Column) -> Column:
    """``late`` or ``deleted`` for a matched reference, null for a sound one."""
    return F.when(F.col(_SINCE) > when, F.lit("late")).when(F.col(_UNTIL) <= when, F.lit("deleted"))


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    at: str | None = None,
    created: str | None = None,
    removed: str | None = None,
    match: str = "simple",
    lookup: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``refs`` whose key names no target, with ``kind`` added.

    ``keys`` name the same columns in ``refs`` and ``targets``.  ``kind`` is
    ``missing``, or where ``at`` (the reference's time) is given ``late``
    (created after it) or ``deleted`` (removed at or before it).  A null time of
    the reference, of creation or of removal never makes an orphan.  Several
    targets of one key count as one, from the earliest creation to the latest
    removal.  Repeated references are kept, targets with null keys match nothing
    under ``simple`` and ``full``.  Other columns of ``refs`` are kept, one named
    ``kind`` is replaced.

    ``lookup`` are further targets, few and often referred to (a canonical
    list).  If they prove to be at most ``LOOKUP_ROWS`` they are broadcast and
    sound references to them go no further, so only the rest is shuffled;
    otherwise they join the other targets.  Hot keys of the rest are split by
    adaptive skew joins: the row per target key is one, only references repeat.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    refs = refs.drop("kind")
    time = F.col(at) if at else F.lit(None).cast("timestamp_ntz")
    life = [c for c in (created, removed) if c]
    only = targets.select(*keys, *life)
    extra = lookup.select(*keys, *life) if lookup is not None else None
    every = only if extra is None else only.unionByName(extra)
    parts = []
    for mask in product((False, True), repeat=len(keys)):
        have = [k for k, is_null in zip(keys, mask) if not is_null]
        if not have or (match == "simple" and any(mask)):
            continue
        rows = refs
        if match != "simple" or len(keys) > 1:
            rows = rows.where(reduce(Column.__and__, [F.col(k).isNull() if n else F.col(k).isNotNull() for k, n in zip(keys, mask)]))
        else:
            rows = rows.where(F.col(keys[0]).isNotNull())
        if match == "full" and any(mask):
            parts.append(rows.withColumn("kind", F.lit("missing")))
            continue
        pool = every
        if extra is not None and fits(extra, LOOKUP_ROWS):
            few = extra.select(*have).distinct()
            near = _lifetimes(extra.unionByName(only.join(F.broadcast(few), have, "left_semi")), have, created, removed)
            rows = rows.join(F.broadcast(near), have, "left").withColumn("_near", F.when(F.col(_HAS), F.coalesce(_kind(time), F.lit("sound"))))
            rows = rows.drop(_SINCE, _UNTIL, _HAS).where("_near is null or _near <> 'sound'")
            pool = only
        else:
            rows = rows.withColumn("_near", F.lit(None).cast("string"))
        joined = rows.join(_lifetimes(pool, have, created, removed), have, "left")
        kind = F.coalesce("_near", F.when(F.col(_HAS).isNull(), F.lit("missing")).otherwise(_kind(time)))
        parts.append(joined.withColumn("kind", kind).where("kind is not null").select(*refs.columns, "kind"))
    if not parts:
        return refs.limit(0).withColumn("kind", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, parts)


def orphan_report(orphans: DataFrame, tab: str, period: str) -> DataFrame:
    """(tab, period, kind, n_references, n_targets) of found orphans."""
    return orphans.groupBy(tab, period, "kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target").alias("n_targets"))
