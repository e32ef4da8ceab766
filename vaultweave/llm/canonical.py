"""Mapping freely typed values to the entries of a canonical list.

A multi-pattern automaton over all names and aliases (in their written, joined
and turned-round forms) finds embedded mentions; the longest that do not
overlap win.  What it leaves over goes to token-set similarity: every word
typed is compared with the words of the list, forgiving plurals, slips,
dropped vowels and shortened words, and the entry of the best set of words
wins, unless some pair of words that is no entry explains the value better.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.session import per_process

#: A canonical list of at most so many entries is sent to every task (some 100 bytes each).
MAX_ENTRIES = 50_000
#: Typed words a process remembers the near words of.
KNOWN_WORDS = 200_000
#: Least score of a word, how much better a pair that is no entry must be to win, and least score of a whole value.
LEAST_WORD, MARGIN, LEAST_VALUE = 0.5, 0.12, 0.7
#: Letters of other scripts that look like Latin ones, and digits typed for letters (fixed values).
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏɡкмтвн", "aeopcyxijsdhlgkmtbh")
DIGITS = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t"}
#: Words that frame a value without being part of it, if the caller names no others.
FRAME = frozenset("the a an of re cf see old new draft".split())
_WORD = re.compile(r"[^\W_]+\.?(?![^\W_]*/)")


def plain(text: str) -> str:
    """``text`` in lower case Latin letters where it only looks like something else."""
    t = unicodedata.normalize("NFKC", text).casefold().translate(LOOKALIKES)
    t = unicodedata.normalize("NFD", t)
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def words(text: str) -> list[str]:
    """The words of a value, a shortened one with its full stop; CamelCase is not told apart here."""
    t = plain(text)
    t = re.sub(r"^\s*[^\s/]+/(?=\S)", " ", t)  # a folder before the name
    t = re.sub(r"\.md\b", " ", t)
    return _WORD.findall(t)


def _counts(word: str) -> np.ndarray:
    """How often each letter a-z stands in a word."""
    return np.bincount([ord(c) - 97 for c in word if "a" <= c <= "z"], minlength=26).astype(np.int8)


def places(word: str) -> dict[str, int]:
    """Where each letter of a word stands, as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(word):
        at[c] = at.get(c, 0) | 1 << i
    return at


def distance(a: str, b: str, most: int, at: dict[str, int] | None = None) -> int:
    """Edit distance with swaps of neighbours, ``most`` + 1 if larger; ``at`` are the places of ``a``, if known.

    A column of the usual table is kept as bits of two whole numbers, so each
    letter of ``b`` takes a few operations.
    """
    m = len(a)
    if abs(m - len(b)) > most:
        return most + 1
    if not m:
        return len(b)
    at = places(a) if at is None else at
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, diagonal, before, score = full, 0, 0, 0, m
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        here = at.get(c, 0)
        swapped = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - left > most:
            return most + 1
        plus = (plus << 1) | 1
        up = ((minus << 1) | ~(diagonal | plus)) & full
        down = plus & diagonal
        before = here
    return min(score, most + 1)


def shortened(w: str) -> set[str]:
    """A word and all it becomes by leaving one letter out; words one edit or swap apart share one of these."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


def bones(w: str) -> str:
    """A word without its inner vowels."""
    return w[:1] + "".join(c for c in w[1:-1] if c not in "aeiou") + w[-1:] if len(w) > 2 else w


def letters(w: str) -> int:
    """The letters a-z of a word as bits."""
    m = 0
    for c in w:
        if "a" <= c <= "z":
            m |= 1 << (ord(c) - 97)
    return m


def plurals(w: str) -> set[str]:
    return {w + "s", w + "es"} | ({w[:-1] + "ies"} if w.endswith("y") else set())


class Matcher:
    """The canonical list, ready to map values: ``entries`` are (id, names), ``frame`` words that may stand around a name."""

    def __init__(self, entries: Sequence[tuple[int, Sequence[str]]], frame: Iterable[str] = FRAME):
        import ahocorasick

        self.frame = frozenset(frame)
        self.ids: dict[tuple[str, ...], int] = {}
        for number, names in sorted(entries):
            for name in names:
                key = tuple(w.rstrip(".") for w in words(name))
                if key and key not in self.ids:
                    self.ids[key] = number
        self.vocabulary = sorted({w for key in self.ids for w in key})
        self.sets: dict[tuple[str, ...], int] = {}
        for key, number in self.ids.items():
            self.sets.setdefault(tuple(sorted(key)), number)
        self.letters = {w: letters(w) for w in self.vocabulary}
        #: Words of the longest entry.
        self.most_words = max(map(len, self.ids), default=0)
        # Of each word: its bones, how they end in the plural, its forms with what each costs and the places of their letters.
        self.looks = []
        for w in self.vocabulary:
            forms = {w: 0.0} | dict.fromkeys(sorted(plurals(w)), 0.02)
            self.looks.append((w, bones(w), {bones(w) + "s", bones(w + "s")}, {f: (cut, places(f)) for f, cut in forms.items()}))
        self._index()
        self.by_word = defaultdict(set)
        for key in self.sets:
            for w in key:
                self.by_word[w].add(key)
        self.by_word = {w: sorted(keys) for w, keys in self.by_word.items()}
        self.automaton = ahocorasick.Automaton()
        for key, number in self.ids.items():
            ends = [key[-1], *plurals(key[-1])]
            forms = {" ".join([*key[:-1], e]) for e in ends} | {"".join([*key[:-1], e]) for e in ends} | {" ".join([e, *key[:-1]]) for e in ends}
            for form in forms:
                form = f" {form} "
                # A form that is an entry of its own keeps its own meaning.
                own = self.ids.get(tuple(form.split()))
                if form not in self.automaton:
                    self.automaton.add_word(form, (len(form), own if own is not None else number, len(key)))
        if self.ids:
            self.automaton.make_automaton()
        self.starts = ahocorasick.Automaton()
        for w in self.vocabulary:
            self.starts.add_word(w, w)
        if self.vocabulary:
            self.starts.make_automaton()
        #: No typed word longer than this is near any word, none longer than twice this any two.
        self.longest = max(map(len, self.vocabulary), default=0) + 8
        self.close: dict[str, list[tuple[float, str]]] = {}

    # -- single words -----------------------------------------------------

    def word(self, w: str) -> list[tuple[float, str]]:
        """(score, word of the list) for every word ``w`` may stand for, best first."""
        if len(w) > self.longest:
            return []
        if w not in self.close:
            if len(self.close) > KNOWN_WORDS:
                self.close.clear()
            forms = [(1.0, w)]
            for digit, letters in DIGITS.items():
                forms = [(s - 0.03 * (digit in f), f.replace(digit, x)) for s, f in forms for x in (letters if digit in f else " ")] if digit in w else forms
            best: dict[str, float] = {}
            for s, f in forms:
                for score, t in self._word(f):
                    best[t] = max(best.get(t, 0), score * s)
            self.close[w] = sorted(((s, t) for t, s in best.items() if s >= LEAST_WORD), reverse=True)
        return self.close[w]

    def _index(self) -> None:
        """The ways from a typed word to the few words of the list it could be near."""
        same: dict[str, set[int]] = defaultdict(set)
        near_bones: dict[str, set[int]] = defaultdict(set)
        begins: dict[tuple[int, str], set[int]] = defaultdict(set)
        for i, (w, bone, more_bones, forms) in enumerate(self.looks):
            for x in (bone, *more_bones, *forms):
                same[x].add(i)
            if len(bone) >= 4:
                for x in shortened(bone):
                    near_bones[x].add(i)
            for at, x in ((0, w[:1]), (0, w[:2]), (1, w[1:2])):
                begins[at, x].add(i)
        self.same, self.near_bones, self.begins = dict(same), dict(near_bones), dict(begins)
        self.masks = np.array([self.letters[w] for w in self.vocabulary], np.uint32)
        self.sizes = np.array([len(w) for w in self.vocabulary], np.int32)
        self.most = np.where(self.sizes < 4, 1, np.where(self.sizes <= 7, 2, 3))
        self.counts = np.array([_counts(w) for w in self.vocabulary], np.int8).reshape(-1, 26)

    def _candidates(self, w: str, short: bool) -> list[int]:
        """Every word of the list that may score, in order; which do is for :meth:`_word` to tell."""
        size = len(w)
        out = set(self.same.get(w, ()))
        if size >= 3:
            out.update(range(bisect_left(self.vocabulary, w), bisect_right(self.vocabulary, w + "\U0010ffff")))
            for x in shortened(w):
                out |= self.near_bones.get(x, set())
            # Each letter that only one of the two has costs an edit of its own; a plural adds up to three letters.
            mask = np.uint32(letters(w))
            near = np.abs(self.sizes - size) <= self.most + 2
            near &= np.bitwise_count(self.masks & ~mask) <= self.most
            near &= np.bitwise_count(mask & ~self.masks) <= self.most + 1
            few = np.flatnonzero(near)
            if len(few):
                extra = self.counts[few] - _counts(w)
                lacking, more = np.maximum(extra, 0).sum(1), np.maximum(-extra, 0).sum(1)
                out.update(few[(lacking <= self.most[few] + 1) & (more <= self.most[few] + 3)].tolist())
            if short:
                out |= self.begins.get((0, w[:1]), set()) | self.begins.get((0, w[1:3]), set()) | self.begins.get((1, w[:1]), set())
        return sorted(out)

    def _word(self, w: str) -> Iterator[tuple[float, str]]:
        short, w = w.endswith("."), w.rstrip(".")
        if not w:
            return
        if w in self.letters:
            yield 1.0, w
        mask, size = letters(w), len(w)
        for i in self._candidates(w, short):
            t, bone, more_bones, forms = self.looks[i]
            if w == t:
                continue
            score = 0.98 if w in forms else 0.0
            if not score and size >= 3 and t.startswith(w):
                score = 0.94 if short else 0.78 if size >= 4 else 0.0
            if score < 0.9 and size >= 3:
                if w == bone:
                    score = max(score, 0.92)
                elif w in more_bones:
                    score = max(score, 0.9)
                elif len(bone) >= 4 and abs(size - len(bone)) <= 1 and distance(w, bone, 1) == 1:
                    score = max(score, 0.7)
                most = 1 if len(t) < 4 else 2 if len(t) <= 7 else 3
                if (self.letters[t] & ~mask).bit_count() <= most and (mask & ~self.letters[t]).bit_count() <= most + 1:
                    # A plural in (e)s is at most two letters nearer than the word itself.
                    itself = distance(t, w, most + 2, forms[t][1])
                    for form, (cut, at) in forms.items():
                        if abs(len(form) - size) <= most and (itself - len(form) + len(t) <= most or form[:-3] + "y" == t):
                            d = itself if form == t else distance(form, w, most, at)
                            if d <= most:
                                score = max(score, 1 - cut - 0.8 * d / len(form) - (0.1 if d == most > 1 else 0))
                if short:
                    d = min(distance(w, t[:k], 1) for k in (size - 1, size, size + 1) if k > 1) if t[:1] == w[:1] or t[:2] == w[1:3] or t[1:2] == w[:1] else 2
                    if d == 1:
                        score = max(score, 0.64 if size > 3 else 0.6)
            if score:
                yield score, t

    # -- whole values -----------------------------------------------------

    def find(self, value: str | None) -> int:
        """The id of the entry a value means, -1 if none."""
        if value is None or not self.ids:
            return -1
        typed = words(value)
        bare = [w.rstrip(".") for w in typed]
        if not bare:
            return -1
        hit = self._mention(bare)
        if hit is not None:
            return hit
        kept = [w for w, b in zip(typed, bare) if b not in self.frame] or typed
        return self._similar(kept)

    def _mention(self, bare: list[str]) -> int | None:
        """The entry of the longest mention, if what is left over is frame only, or near no word of the list."""
        best: tuple[int, int, int] | None = None
        for span in (bare, [b for b in bare if b not in self.frame]):
            text = f" {' '.join(span)} "
            found = sorted(((n, end - n + 1, number, size) for end, (n, number, size) in self.automaton.iter(text)), key=lambda m: (-m[0], m[1]))
            if not found:
                continue
            # Mentions begin and end at words: the words before each letter, and how many of them are loose or near the list.
            before = [0, *accumulate(c == " " for c in text)]
            loose = [0, *accumulate(w not in self.frame for w in span)]
            near: list[int] | None = None
            taken: list[tuple[int, int]] = []
            for n, start, number, size in found:
                k = bisect_left(taken, (start, 0))
                if (k and taken[k - 1][1] - 1 > start) or (k < len(taken) and taken[k][0] < start + n - 1):
                    continue
                taken.insert(k, (start, start + n))
                i, j = before[start + 1] - 1, before[start + n] - 1
                rest = loose[-1] - loose[j] + loose[i]
                if rest and size > 1:
                    near = near or [0, *accumulate(w not in self.frame and bool(self.word(w)) for w in span)]
                if not rest or (size > 1 and near[-1] - near[j] + near[i] == 0):
                    best = max(best or (0, 0, 0), (n, -start, number))
        return best[2] if best else None

    def _similar(self, typed: list[str]) -> int:
        """The entry whose words are closest to the words typed.

        A set of more words than the longest entry has is no entry's; it may
        still be one word typed in pieces.
        """
        ways = [typed] if len(typed) <= self.most_words else []
        if len(typed) < max(self.most_words, 2):
            ways += self._cuts(typed)
        if len(typed) > 1:
            ways.append(["".join(typed)])
        best_entry, best_other = (0.0, -1), 0.0
        for way in ways:
            close = [self.word(w) for w in way]
            if not all(close):
                continue
            less = 0.0 if way is typed else 0.01
            best_other = max(best_other, sum(c[0][0] for c in close) / len(close) - less)
            for score, key in self._entries(close):
                if (score - less, -self.sets[key]) > (best_entry[0], -best_entry[1]):
                    best_entry = (score - less, self.sets[key])
        score, number = best_entry
        return number if score >= LEAST_VALUE and score >= best_other - MARGIN else -1

    def _entries(self, close: list[list[tuple[float, str]]]) -> Iterator[tuple[float, tuple[str, ...]]]:
        if len(close) == 1:
            for s, t in close[0]:
                if (t,) in self.sets:
                    yield s, (t,)
            return
        for s, t in close[0]:
            for key in self.by_word.get(t, ()):
                if len(key) != len(close):
                    continue
                rest = list(key)
                rest.remove(t)
                total = s
                for c in close[1:]:
                    got = max(((x, y) for x, y in c if y in rest), default=None)
                    if got is None:
                        break
                    rest.remove(got[1])
                    total += got[0]
                else:
                    yield total / len(close), key

    def _cuts(self, typed: list[str]) -> Iterator[list[str]]:
        """The words with one cut in two: where a word of the list starts or ends in it, else anywhere.

        Beside others a word is cut only if it is near no word of the list as it stands.
        """
        for i, w in enumerate(typed):
            if not 6 <= len(w.rstrip(".")) <= 2 * self.longest or (len(typed) > 1 and self.word(w)):
                continue
            places = set()
            if any(c in DIGITS for c in w):
                w = "".join(DIGITS.get(c, c)[0] for c in w)
            for end, t in self.starts.iter(w) if self.vocabulary else ():
                start = end - len(t) + 1
                if start == 0:
                    places.add(end + 1)
                if end + 1 == len(w.rstrip(".")) or w[end + 1 :] in ("s", "es"):
                    places.add(start)
            places = {p for p in places if 3 <= p <= len(w) - 3} or set(range(3, len(w) - 2))
            for p in sorted(places):
                yield [*typed[:i], w[:p], w[p:], *typed[i + 1 :]]




def canonical_entries(entries: DataFrame, number: str, name: str, aliases: str) -> list[tuple[int, list[str]]]:
    """The list as plain rows, after a check that it is small enough to send to every task."""
    rows = entries.select(number, name, aliases).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a canonical list of more than {MAX_ENTRIES} entries must be split by a key first")
    return sorted((r[0], [n for n in [r[1], *(r[2] or [])] if n]) for r in rows if r[0] is not None)


def map_values(values: DataFrame, value: str, entries: Sequence[tuple[int, Sequence[str]]], into: str = "concept_id", frame: Iterable[str] = FRAME) -> DataFrame:
    """``values`` with ``into``: the id of the entry each value means, -1 if it means none.

    Distinct values are mapped once and joined back, so a value that fills a
    third of all rows is matched once; a Python process builds the automaton
    once.  ``frame`` are words that may stand around a name without being part
    of it.  A null or blank value means none; so does every value where the list
    is empty.  Of entries with the same words the smallest id wins.  All rows
    and columns are kept; a column that has the name ``into`` is replaced.
    """
    if into in values.columns and into != value:
        values = values.drop(into)
    listed = [(int(i), list(names)) for i, names in entries]
    around = tuple(sorted(frame))
    run = uuid4().hex  # nothing is kept from one query to the next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = per_process("canonical", run, lambda: Matcher(listed, around))
        for batch in batches:
            typed = batch.column(0)
            yield pa.RecordBatch.from_arrays([typed, pa.array([matcher.find(v) for v in typed.to_pylist()], pa.int64())], ["_typed", "_means"])

    spark = values.sparkSession
    plain_value, means_id = (_free(n, values.columns) for n in ("_typed", "_means"))
    # As many tasks as a shuffle has: matching costs time, not bytes, so small partitions must not be joined.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    typed = values.select(F.col(f"`{value}`").cast("string").alias("_typed")).where("_typed is not null").distinct().repartition(tasks, "_typed")
    means = typed.mapInArrow(run, "_typed string, _means bigint").toDF(plain_value, means_id)
    kept = [F.col(f"`{c}`") for c in values.columns if c != into]
    joined = values.join(means, F.col(f"`{value}`").cast("string") == F.col(plain_value), "left")
    return joined.select(*kept, F.coalesce(means_id, F.lit(-1).cast("bigint")).alias(into))


def _free(name: str, taken: Sequence[str]) -> str:
    """``name``, lengthened until it is none of those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def unmatched_report(mapped: DataFrame, value: str, by: str, into: str = "concept_id") -> DataFrame:
    """(by, n_values, n_unmatched, n_distinct_unmatched) of mapped values."""
    none = F.col(into) == -1
    return mapped.groupBy(by).agg(F.count(F.lit(1)).alias("n_values"), F.count_if(none).alias("n_unmatched"), F.count_distinct(F.when(none, F.col(value))).alias("n_distinct_unmatched"))
