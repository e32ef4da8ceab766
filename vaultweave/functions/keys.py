"""Column functions that read a note's key out of a reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank around a value.
BLANKS = " \t\n\r\x0b\x0c 　﻿"


def blank_trim(c: Column) -> Column:
    """``c`` without outer blanks of any of :data:`BLANKS`."""
    return F.btrim(c, F.lit(BLANKS))


def is_wikilink(c: Column) -> Column:
    """Whether a (trimmed) value is one wikilink, embedded (``!``) or not."""
    return (c.startswith("[[") | c.startswith("![[")) & c.endswith("]]")


def note_key(c: Column) -> Column:
    """The key of the note a reference names.

    The target inside the brackets (or the bare name): before the first ``|``
    (or its escaped form) and the first ``#``, last path segment, without a
    final ``.md`` and outer blanks, lower case.  Null stays null; a reference
    without target (``[[#heading]]``) gives the empty string.
    """
    inner = F.substring_index(F.substring_index(c, "[[", -1), "]]", 1)
    target = F.rtrim(F.substring_index(inner, "|", 1), F.lit(" \\"))
    name = F.lower(F.substring_index(F.substring_index(target, "#", 1), "/", -1))
    return blank_trim(F.regexp_replace(name, r"\.md\s*$", ""))
