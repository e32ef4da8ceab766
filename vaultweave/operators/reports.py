"""Reports and cards: small results as text, differences of texts, point look-ups, chains of user functions."""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a report takes at most: reports are read by people.
REPORT_ROWS = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows is none; write the table instead")
    return rows


def as_markdown(df: DataFrame, title: str) -> str:
    """A table under a heading."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in _rows(df))]) + "\n"


def as_json(df: DataFrame, title: str) -> str:
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in _rows(df)]}, default=str, ensure_ascii=False, sort_keys=True)


def as_dot(edges: DataFrame, title: str) -> str:
    """Edges (src, dst) in the graph language of drawing programs."""
    name = lambda v: json.dumps(str(v), ensure_ascii=False)
    lines = sorted(f"  {name(r.src)} -> {name(r.dst)};" for r in _rows(edges.select("src", "dst").distinct()))
    return "\n".join([f"digraph {name(title)} {{", *lines, "}"]) + "\n"


def difference(before: str, after: str, names: tuple[str, str] = ("stored", "generated")) -> str:
    """Two texts compared line by line, in the unified form; empty where they agree."""
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), *names))


def row_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): rows added, removed or changed between two tables with the same columns."""
    digest = lambda df: F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c != key])
    a, b = before.select(key, digest(before).alias("_a"), F.lit(True).alias("_in_a")), after.select(key, digest(after).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def card(notes: DataFrame, name: str, aliases: DataFrame | None = None) -> dict | None:
    """What a hover shows of a note by its name or alias: title, layer, role, dependencies and the first sentence; null if there is none."""
    from vaultweave.functions.markdown import description, section_loose

    low = name.strip().lower()
    hits = notes.where(F.lower("name") == low)
    if aliases is not None:
        meant = aliases.where(F.lower("alias") == low).select(F.lower("canonical").alias("_n")).distinct()
        hits = hits.unionByName(notes.join(meant, F.lower("name") == F.col("_n"), "left_semi")).distinct()
    text = section_loose(F.coalesce("content", F.lit("")), "## Definition")
    row = hits.select("name", "title", "layer", "role", "deps", description(text, 1).alias("says")).orderBy("name").limit(1).collect()
    return row[0].asDict() if row else None


def neighbours(edges: DataFrame, node: str | int, inward: bool = False, limit: int = 100) -> DataFrame:
    """The links out of a note, or into it, as a tool gives them: at most 500, in order."""
    from vaultweave.operators.ordering import clamped

    at, other = ("dst", "src") if inward else ("src", "dst")
    return clamped(edges.where(F.col(at) == node).select(F.col(other).alias("node")).distinct().orderBy("node"), limit)


def members(partition: DataFrame, community: str, limit: int = 100) -> DataFrame:
    """The nodes of a community, at most 500, in order."""
    from vaultweave.operators.ordering import clamped

    return clamped(partition.where(F.col("community") == community).select("node").orderBy("node"), limit)


def chained(frame: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], needs: Sequence[str] = ()) -> DataFrame:
    """``frame`` passed through a user's functions in turn; each must keep the columns ``needs``."""
    for step in steps:
        frame = frame.transform(step)
        if lost := [c for c in needs if c not in frame.columns]:
            raise ValueError(f"{getattr(step, '__name__', step)!r} lost the columns {', '.join(lost)}")
    return frame
