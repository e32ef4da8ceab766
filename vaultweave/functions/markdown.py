"""Column functions over markdown text; all stay inside the JVM.

Line ends are ``\\n``; a carriage return before one never belongs to a value.
A null text gives null (or an empty array where an array is returned).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target of a wikilink: before the first ``#`` and ``|``.
WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def link_occurrences(text: Column) -> Column:
    """Every wikilink target as written, repeats kept."""
    return _all(text, WIKILINK)


def links(text: Column) -> Column:
    """Wikilink targets in lower case, each once, in order of first mention."""
    return F.array_distinct(F.transform(link_occurrences(text), lambda x: F.trim(F.lower(x))))


def headings(text: Column) -> Column:
    """Second-level headings, each once."""
    return F.array_distinct(_all(text, r"(?md)^## ([^\r\n]+)"))


def title(text: Column, otherwise: Column) -> Column:
    """The first first-level heading, else ``otherwise``."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?md)^# ([^\r\n]*)", 1)), F.lit("")), otherwise)


def section_strict(text: Column, heading: str) -> Column:
    """The text under ``## heading`` (case-sensitive, a line of its own) up to the next such heading; null if there is none."""
    start = rf"(?ms)^## {heading}[ \t\r]*\n"
    body = F.element_at(F.split(text, start, 2), 2)
    return F.when(text.rlike(start), F.btrim(F.substring_index(F.concat(F.lit("\n"), body), "\n## ", 1), F.lit(" \t\r\n")))


def section_loose(text: Column, heading: str) -> Column:
    """The text after the first place where ``heading`` stands, whatever its case, up to the next second-level heading; empty if nowhere."""
    low, mark = F.lower(text), heading.lower()
    at = F.instr(low, mark)
    rest = F.substr(text, at + len(mark))
    return F.when(at > 0, F.btrim(F.substring_index(rest, "\n## ", 1), F.lit(" \t\r\n"))).when(text.isNotNull(), F.lit(""))


def structural_dependencies(text: Column) -> Column:
    """Links of the section on structural dependencies; none where it says there are none for a primitive or axiomatic note."""
    section = section_strict(text, "Structural dependencies")
    low = F.lower(section)
    none = low.contains("none") & (low.contains("primitive") | low.contains("axiomatic"))
    return F.when(section.isNull() | none, F.array().cast("array<string>")).otherwise(links(section))


def dependency_lines(text: Column) -> Column:
    """A map from each target in the section on structural dependencies to the last line (from 1) it stands on; computed inside the row."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("line"), F.lit(False).alias("inside"), F.array().cast("array<struct<link:string,line:int>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        here = acc.line + 1
        inside = F.when(t.startswith("## "), t.rlike(r"^## Structural dependencies\s*$")).otherwise(acc.inside)
        links_ = F.transform(_all(t, r"\[\[([^\]|#]+)"), lambda x: F.struct(F.trim(F.lower(x)).alias("link"), here.alias("line")))
        return F.struct(here.alias("line"), inside.alias("inside"), F.when(inside, F.concat(acc.found, links_)).otherwise(acc.found).alias("found"))

    found = F.aggregate(lines, start, step, lambda acc: acc.found)
    names = F.array_distinct(F.transform(found, lambda x: x["link"]))
    last = F.transform(names, lambda n: F.array_max(F.transform(F.filter(found, lambda x: x["link"] == n), lambda x: x["line"])))
    # Texts without the section are passed over before they are cut into lines.
    return F.when(text.contains("## Structural dependencies"), F.map_from_arrays(names, last))


def front_matter(text: Column) -> Column:
    """The block between the fences that open a text; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1), F.lit(""))


def front_matter_field(block: Column, name: str) -> Column:
    """One scalar field of a front matter block; null if absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?md)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def inline_tags(text: Column) -> Column:
    """Inline tags: ``#`` at the start or after a blank, then letters, digits, ``-``, ``_``, ``/``, not digits alone."""
    return F.array_distinct(F.filter(_all(text, r"(?:^|\s)#([\p{L}\p{N}_/-]+)"), lambda t: ~t.rlike(r"^[0-9/]+$")))


def description(text: Column, goal: int = 150, most: int = 300) -> Column:
    """Whole sentences up to ``goal`` characters, one at least, cut hard after ``most``."""
    sentences = F.split(F.regexp_replace(text, r"\s+", " "), r"\.\s")
    dotted = F.transform(sentences, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))
    empty = F.struct(F.lit("").alias("text"), F.lit(True).alias("going"))

    def step(acc: Column, pair: Column) -> Column:
        joined = F.when(acc.text == "", pair.dot).otherwise(F.concat_ws(" ", acc.text, pair.dot))
        more = acc.going & (pair.raw != "") & ((acc.text == "") | (F.length(joined) <= goal))
        return F.struct(F.when(more, joined).otherwise(acc.text).alias("text"), more.alias("going"))

    pairs = F.transform(F.arrays_zip(sentences.alias("raw"), dotted.alias("dot")), lambda p: F.struct(p["raw"].alias("raw"), p["dot"].alias("dot")))
    out = F.aggregate(pairs, empty, step, lambda acc: acc.text)
    return F.when(F.length(out) > most, F.concat(F.substr(out, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(out)


def reading_minutes(text: Column, per_minute: int = 200) -> Column:
    """Minutes to read a text, rounded up."""
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    return F.when(text.isNotNull(), F.ceil(words / per_minute))


def heading_slug(c: Column) -> Column:
    """The anchor of a heading: lower case, letters, digits, ``_``, ``-`` kept, blanks as ``-``."""
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_ -]", ""), F.lit(" "), F.lit("-"))
