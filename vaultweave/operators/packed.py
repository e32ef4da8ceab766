"""Several values packed in one field: one row per value, position kept.

Method: every text is masked to its delimiter skeleton (which structural marks
it uses outside wikilinks, ordinary characters dropped), the splitting rule is
resolved once per distinct skeleton, the rules are broadcast and each text is
cut by the rule of its skeleton.

The skeleton is the *set* of structural marks in a fixed order, so there are
at most ``2 ** len(MARKS)`` of them however large the table: the broadcast
table of rules is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultweave.functions.keys import BLANKS, blank_trim

#: A structural mark and the text that shows it, in skeleton order.  ``J`` is
#: the bracket that opens a JSON array, ``L`` a list marker
#: that opens the text (where there are lines, each may have one anyway).
MARKS = (",", ";", "|", "\n", "\r", "\t", "·", "•", "<br", "/", '"', "'")
_SLASH, _DQ, _SQ = "/", '"', "'"
_WIKILINK = r"\[\[[^\]]*+(?:\](?!\])[^\]]*+)*+\]\]"
_BREAK = r"<br\s*+/?+>"


def skeleton(text: Column) -> Column:
    """The skeleton of ``text``: ``J`` for a JSON array, else its marks, each once, in order.

    Ordinary characters are masked away altogether.  A mark that occurs inside
    a wikilink only is kept too: it makes the rule no wrong one, as rules pass
    over wikilinks whole.
    """
    marks = [F.when(text.contains(m if m != _SLASH else " / "), F.lit(m[0])).otherwise(F.lit("")) for m in MARKS]
    head = F.ltrim(text)
    is_json = head.startswith("[") & ~head.startswith("[[") & F.rtrim(text).endswith("]")
    listed = F.substr(head, F.lit(1), F.lit(2)).isin("- ", "* ", "+ ", "-\t", "*\t", "+\t")
    return F.when(is_json, F.lit("J")).otherwise(F.concat(*marks, F.when(listed, F.lit("L")).otherwise(F.lit(""))))


#: The marks each pattern knows.  Few patterns, each a literal, so the JVM compiles them once
#: and not anew whenever the next row has another skeleton.
RULES = {"simple": ",;|\t·•", "quotes": ",;|\n\r\t·•\"'L", "every": ",;|\n\r\t·•</\"'L"}


def resolve(skel: Column) -> Column:
    """The splitting rule of a skeleton: ``json``, ``whole`` or the name of the leanest pattern that knows all its marks."""
    rule = F.when(skel == "J", F.lit("json")).when(skel == "", F.lit("whole"))
    for name, marks in RULES.items():
        rule = rule.when(F.translate(skel, marks, "") == "", F.lit(name))
    return rule


def pattern(skel: str) -> str:
    """The pattern whose group 1 is one value of a text with (at most) the marks of ``skel``.

    Every repetition is possessive, so long texts neither backtrack nor recurse.
    """
    seps = [m for m in ",;|\n\r\t·•" if m in skel]
    one = "".join("\\" + m if m == "|" else m for m in seps)
    blank = "[^\\S" + "".join(m for m in seps if m.isspace()) + "]"
    ends = ([f"[{one}]"] if one else []) + ([_BREAK] if "<" in skel else []) + [r"\z"]
    end = f"(?={blank}*+(?:" + "|".join(ends) + (r"|(?<=\s)/\s" if _SLASH in skel else "") + "))"
    quoted = [q for m, q in ((_DQ, r'"[^"]*+(?:""[^"]*+)*+"'), (_SQ, r"'[^']*+(?:''[^']*+)*+'")) if m in skel]
    skips = [rf"{m}\s*+{m}{end}" for m in (_DQ, _SQ) if m in skel] + [_BREAK] * ("<" in skel)
    special = "<" * ("<" in skel) + _SLASH * (_SLASH in skel)
    parts = [rf"[^{one}{special}\s\[]++", _WIKILINK, r"\["]
    if _DQ in skel:
        parts.append(rf'(?<=[^\s"{one}]){blank}++{quoted[0]}')
    parts.append(f"{blank}++(?!" + "|".join([*ends, *[r"/\s"] * (_SLASH in skel)]) + ")")
    if "<" in skel:
        parts.append("(?!" + _BREAK + ")<")
    if _SLASH in skel:
        parts.append(r"(?<!\s)/|/(?!\s)")
    plain = "(?:" + "|".join(parts) + ")++"
    marker = r"(?:[-*+][ \t]++)?+" if {"L", "\n", "\r"} & set(skel) else ""
    whole = "|".join([*(q + end for q in quoted), plain])
    return rf"(?=\S)(?:{'|'.join([*skips, ''])}{marker}({whole}))"


def _clean(t: Column) -> Column:
    """A value without outer quotes, doubled quotes undone; rules cut values without outer blanks."""
    body = F.substr(t, F.lit(2), F.length(t) - 2)
    bare = lambda q: blank_trim(F.replace(body, F.lit(q + q), F.lit(q)))
    return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1), bare('"')).when(t.startswith("'") & t.endswith("'") & (F.length(t) > 1), bare("'")).otherwise(t)


def rules_for(texts: DataFrame, column: str) -> DataFrame:
    """(skel, rule): one row per distinct skeleton of ``column``."""
    found = texts.select(skeleton(F.col(column)).alias("skel")).where("skel is not null").distinct()
    return found.select("skel", resolve(F.col("skel")).alias("rule"))


def split_packed(df: DataFrame, column: str, keep: Sequence[str], rules: DataFrame | None = None, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per value of ``column``: the columns ``keep``, ``pos`` (from 1) and ``value``.

    Null, empty and blank texts give no row, nor do blank values between
    separators, and positions count the others only.  Repeated values and rows
    are kept.  A text that opens as a JSON array but is none is cut by its
    separators.  ``keep`` may hold any names but those two.
    """
    src = df.select(*keep, F.col(column).alias("_text")).where(F.col("_text").isNotNull() & (F.col("_text") != ""))
    rules = rules_for(src, "_text") if rules is None else rules
    ruled = src.withColumn("_skel", skeleton(F.col("_text"))).join(F.broadcast(rules.select(F.col("skel").alias("_skel"), F.col("rule").alias("_rule"))), "_skel", "left")
    text, is_rule = F.col("_text"), lambda name: F.col("_rule") == name
    cut = {name: F.array_remove(F.regexp_extract_all(text, F.lit(pattern(marks)), F.lit(1)), "") for name, marks in RULES.items()}
    parsed = F.from_json(text, "array<string>")
    as_json = F.filter(F.transform(F.array_compact(parsed), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    items = (
        F.when(is_rule("simple"), cut["simple"])
        .when(is_rule("quotes"), cut["quotes"])
        .when(is_rule("json"), F.coalesce(as_json, cut["every"]))
        .when(is_rule("whole"), F.array_remove(F.array(blank_trim(text)), ""))
        .otherwise(cut["every"])
    )
    out = ruled.select(*keep, is_rule("json").alias("_json"), F.posexplode(items).alias("_pos", "_item"))
    return out.select(*keep, (F.col("_pos") + 1).alias(pos), F.when(F.col("_json"), F.col("_item")).otherwise(_clean(F.col("_item"))).alias(value))
