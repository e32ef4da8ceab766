"""Text signals: word classes, negations, phrases, prescriptive sentences, scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultweave.functions.markdown import section_loose

# The word lists and phrases that define the signals.
STATE_VERBS = "remains persists exists is are was were stays continues remain persist exist stay continue".split()
ACTION_VERBS = (
    "removes constrains eliminates narrows forecloses reduces blocks prevents restricts "
    "remove constrain eliminate narrow foreclose reduce block prevent restrict"
).split()
MODAL_VERBS = "can cannot must may might should could would requires require".split()
CAUSAL_VERBS = (
    "causes produces transforms converts creates generates leads results "
    "cause produce transform convert create generate lead result"
).split()
VERBS = {"state": STATE_VERBS, "action": ACTION_VERBS, "modal": MODAL_VERBS, "causal": CAUSAL_VERBS}
NEGATIONS = ["not", "does not", "is not", "are not", "do not", "cannot", "without", "never"]
OPERATIONAL = ["detected by", "revealed when", "test for", "operationally", "operational test"]
COST = [r"requires?", r"expends?", r"pays?", "burden", "cost", "effort"]
SPATIAL = ["local", "non-local", "boundary", "inside", "beyond", "within"]
#: The one spatial phrase that counts inside longer words too (``non-locality``).
SPATIAL_OPEN = ["non-local"]
# Who should do something, and what is only described as needing it.
PRESCRIBED = r"(we|one|users?|systems?|agents?|operators?)\s+(should|must|require)"
DESCRIBED = r"(it|this|the\s+\w+)\s+(requires?|must)"
BARE_MODAL, BARE_AGENT = r"(should|must)", r"(you|we|one)"
#: Ranks of layers in dependency order.
LAYER_RANK = {
    "primitive": 0, "foundational": 0, "first-order": 1, "mechanism": 2,
    "accounting": 3, "selector": 4, "failure-state": 4, "meta-analytical": 4,
}

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def words(text: Column) -> Column:
    """Words of the letters a-z alone; a run with any other letter, digit or ``_`` is none."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{_B}[a-z]++{_E}"), F.lit(0))


def count_words(text: Column, lexicon: list[str]) -> Column:
    """How many words of ``text`` belong to ``lexicon``, repeats counted."""
    return F.regexp_count(F.lower(text), F.lit(rf"{_B}(?:{'|'.join(sorted(lexicon, key=lambda w: (-len(w), w)))}){_E}"))


def count_phrases(text: Column, phrases: list[str], bounded: bool = True) -> Column:
    """The sum of the occurrences of each phrase; phrases within phrases count again."""
    low = F.lower(text)
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(low, F.lit(rf"{_B}{p}{_E}" if bounded else p))
    return total


def spatial(text: Column) -> Column:
    """How many spatial phrases a text has."""
    return count_phrases(text, [p for p in SPATIAL if p not in SPATIAL_OPEN]) + count_phrases(text, SPATIAL_OPEN, bounded=False)


def negations(text: Column) -> Column:
    return count_phrases(text, NEGATIONS)


def prescriptive(sentence: Column) -> Column:
    """Whether a sentence tells someone what to do."""
    bare = sentence.rlike(rf"(?i){_B}{BARE_MODAL}{_E}") & sentence.rlike(rf"(?i){_B}{BARE_AGENT}{_E}")
    return sentence.rlike(rf"(?i){_B}{PRESCRIBED}") | (~sentence.rlike(rf"(?i){_B}{DESCRIBED}") & bare)


def prescriptive_sentences(text: Column) -> Column:
    """The sentences (cut at ``.``, ``!``, ``?``) that are prescriptive."""
    return F.filter(F.transform(F.split(text, r"[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\r\n"))), prescriptive)


def scope_metrics(text: Column) -> tuple[Column, Column, Column]:
    """(sentences of the definition, items on what it is not, share of the first; 0.5 if both are 0, half-even to 2 places)."""
    sentences = F.regexp_count(section_loose(text, "## Definition"), F.lit("[.!?]+"))
    nots = F.regexp_count(section_loose(text, "## What this is NOT"), F.lit(r"(?mdi)^-\s+Not\b"))
    total = sentences + nots
    return sentences, nots, F.when(total > 0, F.bround(sentences / total, 2)).otherwise(F.lit(0.5))


def layer_rank(layer: Column) -> Column:
    """The rank of a layer, 99 for an unknown or null one."""
    out = F.lit(99)
    for name, rank in LAYER_RANK.items():
        out = F.when(F.lower(layer) == name, F.lit(rank)).otherwise(out)
    return out


def search_tokens(text: Column) -> Column:
    """Search tokens: each CJK character by itself, else runs without blanks, in lower case."""
    cjk = r"぀-ゟ゠-ヿ一-鿿가-힯\x{20000}-\x{2A6DF}"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{cjk}]|[^ \t\r\n{cjk}]++"), F.lit(0))
