"""Declarative table views: filters, formulas, grouping, sorting and footers as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOOTERS = {"Filled": F.count, "Sum": F.sum, "Average": F.avg, "Min": F.min, "Max": F.max, "Unique": F.count_distinct}


@dataclass(frozen=True)
class View:
    """A view over a frame of notes; filters and formulas are SQL expressions.

    ``filters`` must all hold, and one of ``any_of`` if there are such.
    ``formulas`` may use columns and earlier formulas.  ``sort`` names columns,
    ``-`` in front for descending; nulls come last either way.
    """

    columns: Sequence[str]
    formulas: Mapping[str, str] = field(default_factory=dict)
    filters: Sequence[str] = ()
    any_of: Sequence[str] = ()
    sort: Sequence[str] = ()
    group_by: str | None = None
    footers: Mapping[str, str] = field(default_factory=dict)


def _shaped(notes: DataFrame, view: View) -> DataFrame:
    out = notes
    for f in view.filters:
        out = out.where(f)
    if view.any_of:
        out = out.where(" OR ".join(f"({f})" for f in view.any_of))
    for name, expr in view.formulas.items():
        out = out.withColumn(name, F.expr(expr))
    return out


def rows(notes: DataFrame, view: View) -> DataFrame:
    """The rows of a view in its order."""
    out = _shaped(notes, view).select(*view.columns)
    keys = ([view.group_by] if view.group_by else []) + list(view.sort)
    return out.orderBy(*[F.col(k[1:]).desc_nulls_last() if k[0] == "-" else F.col(k).asc_nulls_last() for k in keys]) if keys else out


def footers(notes: DataFrame, view: View) -> DataFrame:
    """The footers of a view, one row for each group (or one in all): ``n`` and one column for each footer."""
    shaped = _shaped(notes, view)
    aggs = [F.count(F.lit(1)).alias("n"), *[FOOTERS[kind](F.col(c)).alias(f"{c}_{kind.lower()}") for c, kind in view.footers.items()]]
    return shaped.groupBy(view.group_by).agg(*aggs) if view.group_by else shaped.agg(*aggs)


def has_link(links: str, target: str) -> str:
    """The SQL expression of a yes/no column: whether an array of links holds ``target``."""
    return f"if(array_contains({links}, '{target}'), 'yes', 'no')"
