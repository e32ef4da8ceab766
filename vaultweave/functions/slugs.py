"""Column functions over paths and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify_path(path: Column) -> Column:
    """The slug of a file path: blanks as ``-``, ``&`` and ``%`` spelt out, no ``?`` and ``#``, no markdown or html ending, ``_index`` as ``index``."""
    bare = F.btrim(path, F.lit("/"))
    ext = F.regexp_extract(bare, r"(\.[A-Za-z0-9]+)$", 1)
    page = ext.isin("", ".md", ".html")
    stem = F.regexp_replace(bare, r"\.[A-Za-z0-9]+$", "")
    s = F.regexp_replace(stem, r"\s", "-")
    s = F.replace(F.replace(s, F.lit("&"), F.lit("-and-")), F.lit("%"), F.lit("-percent"))
    s = F.rtrim(F.regexp_replace(s, r"[?#]", ""), F.lit("/"))
    s = F.regexp_replace(s, r"(^|/)_index$", "$1index")
    return F.concat(s, F.when(page, F.lit("")).otherwise(ext))


def simplify_slug(slug: Column) -> Column:
    """A slug without a final ``index`` segment; ``/`` for the root."""
    s = F.ltrim(F.regexp_replace(slug, r"(^|/)index$", "$1"), F.lit("/"))
    return F.when(s == "", F.lit("/")).otherwise(s)


def segment_prefixes(path: Column) -> Column:
    """``a``, ``a/b``, ``a/b/c`` of ``a/b/c``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folder(path: Column) -> Column:
    """The path without its last segment; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def natural_key(name: Column) -> Column:
    """A sort key that orders runs of digits by number, however long: the number of its digits stands in front of it."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def relative(source: Column, target: Column) -> Column:
    """``target`` as seen from ``source``: one ``..`` per folder above the source."""
    depth = F.size(F.split(source, "/")) - 1
    return F.when(depth > 0, F.concat(F.repeat(F.lit("../"), depth), target)).otherwise(F.concat(F.lit("./"), target))
