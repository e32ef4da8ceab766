"""Column functions that make values readable, and dates out of what front matter gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(ms: Column) -> Column:
    """Milliseconds as text: ``340ms`` below a second, ``1.5s`` below a minute, else ``2m 05s``; ``-`` for none."""
    whole = F.floor(ms / 1000)
    return (
        F.when(ms.isNull(), "-").when(ms < 1000, F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_string("%.1f", ms.cast("double") / 1000), F.lit("s")))
        .otherwise(F.format_string("%dm %02ds", F.floor(whole / 60), (whole % 60)))
    )


def truncated_to(text: Column, most: int) -> Column:
    """``text`` cut to ``most`` characters, the last three ``...``, if it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substr(text, F.lit(1), F.lit(max(most - 3, 0))), F.lit("..."))).otherwise(text)


def resources(numbers: Column) -> Column:
    """A map of resources as ``name=value`` pairs in order of the names."""
    pairs = F.array_sort(F.map_entries(numbers))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["value"].cast("string"))), ", ")


def moment(ts: Column) -> Column:
    """A time to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def status_word(status: Column) -> Column:
    """A state as a reader would say it."""
    words = {"created": "proposed", "validated": "ready for approval", "approved": "ready to execute", "executed": "done", "rejected": "turned down", "superseded": "replaced"}
    out = status
    for k, v in words.items():
        out = F.when(status == k, F.lit(v)).otherwise(out)
    return out


def coerced_date(text: Column, otherwise: Column) -> Column:
    """A date out of text; one that is none, or the beginning of the epoch, counts as ``otherwise``."""
    found = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.when(found.isNull() | (found == F.lit("1970-01-01").cast("timestamp")), otherwise).otherwise(found)


def first_date(sources: dict[str, Column], priority: Sequence[str] = ("frontmatter", "git", "filesystem")) -> Column:
    """The date of the first source in order of ``priority`` that has one."""
    return F.coalesce(*[sources[p] for p in priority if p in sources])


def note_name(cell: Column) -> Column:
    """The name in a cell like ``[[path/x.md|Name]]``: what is shown, else the last segment without its ending; other texts as they are."""
    inner = F.regexp_extract(cell, r"^\s*\[\[([^\]]*)\]\]\s*$", 1)
    shown = F.element_at(F.split(inner, r"\|"), -1)
    return F.when(inner == "", F.trim(cell)).otherwise(F.regexp_replace(F.substring_index(F.trim(shown), "/", -1), r"\.md$", ""))
