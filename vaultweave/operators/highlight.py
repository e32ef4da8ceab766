"""The stretch of a text that shows most of a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_window(texts: DataFrame, key: str, text: str, prefixes: list[str], size: int = 30) -> DataFrame:
    """(key, at, hits): where the ``size`` words with most hits begin, the last such place; texts without a hit give no row.

    Words are runs without blanks, counted from 1; a word is a hit if it begins
    with any of ``prefixes`` in lower case.
    """
    low = F.lower(text)
    near = texts.where(reduce(Column.__or__, [low.contains(p.lower()) for p in prefixes])) if prefixes else texts.limit(0)
    is_hit = lambda w: reduce(Column.__or__, [w.startswith(p.lower()) for p in prefixes], F.lit(False))
    words = near.select(key, F.array_remove(F.split(low, r"\s+"), "").alias("_w"))
    # The places of the hits alone; a window with most hits begins at one of its hits or reaches to the last word it can begin at.
    placed = words.select(key, F.size("_w").alias("_n"), F.filter(F.transform("_w", lambda w, i: F.when(is_hit(w), i + 1)), lambda i: i.isNotNull()).alias("_at")).where(F.size("_at") > 0)
    count = lambda s: F.size(F.filter("_at", lambda i: (i >= s) & (i < s + size)))
    # From a hit on the number of hits ahead only falls where one is passed: the last best window begins at a hit.
    best = F.array_max(F.transform("_at", lambda s: F.struct(count(s).cast("long").alias("hits"), s.alias("at"))))
    return placed.select(key, best.alias("_b")).select(key, F.col("_b.at").alias("at"), F.col("_b.hits").alias("hits"))


def marked(text: Column, terms: list[str]) -> Column:
    """``text`` with every word that begins with a search term, whatever its case, between ``<mark>`` tags; longer terms first."""
    known = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not known:
        return text
    words = "|".join("\\Q" + t.replace("\\E", "") + "\\E" for t in known)
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_])((?:{words})[\p{{L}}\p{{N}}_]*)", "<mark>$1</mark>")


def search_terms(asked: str) -> list[str]:
    """The words of a search and every run of words from its first, longest first."""
    words = [w for w in asked.split() if w]
    runs = [" ".join(words[:n]) for n in range(2, len(words) + 1)]
    return sorted([*words, *runs], key=len, reverse=True)
