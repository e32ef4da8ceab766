"""Text cut off by field limits and broken transfers.

The method is a self-join by prefix, on three levels, which come first:

* ``prefix``: ladders of hashed fixed-length prefixes find texts that are strict
  prefixes of longer copies elsewhere, checked on the texts themselves;
* ``word``: a last word the corpus does not know, but as a strict prefix of
  longer words, was cut;
* ``passage``: the last passage of a text (a fixed number of tokens, links,
  numbers and names masked) is joined by its hash with all passages of the
  corpus.  Where those go on elsewhere it is a strict prefix of longer copies
  and the text stops short; where they end their sentence or line it is
  complete, whatever it ends with.

What they leave open is completed by structure (``open``: brackets, fences, table rows
and front matter) and by lengths at which a source piles up texts
(``limit``).  A text that ends its sentence exactly at such a length counts as
cut only if no more texts do so there than chance would have it: a source may
also fill notes up to its limit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultweave.llm.bpe import text_blocks
from vaultweave.session import fits, written

#: Shortest prefix of the ladder; each further step doubles it.
FIRST_STEP = 32
#: A text of whole sentences is a cut copy of a longer one from this length on; below, both may just begin alike.
SURE_PREFIX = 128
#: A length is a field limit of a source if so many distinct texts have it, and so many times the texts of a length below it.
LIMIT_TEXTS, LIMIT_RATIO = 8, 6.0
#: Lengths below one that tell how many texts it would have otherwise.
LIMIT_FROM, LIMIT_TO = 130, 30
#: Texts at a limit that end a sentence are cut like the others if they are at most so many times what chance gives.
CHANCE_RATIO = 2.0
#: Field limits of at most so many rows (100 bytes each) are broadcast, others joined.
LIMIT_ROWS = 20_000
#: Texts with a shared opening of at most so many rows and cuts are looked up by broadcast, others joined.
MEMBER_ROWS, MEMBER_CUTS = 100_000, 1_000_000
#: Occurrences a context needs to count, and the share of ends above which it is an end.
CONTEXT_COUNT, END_SHARE = 3, 0.5
#: A line's opening marks a closing line if it is the last of so many other distinct texts, and more often than not.
CLOSING_COUNT = 3
_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(
    rf"[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*|\[\[[^\[\]\n]*\]\]|[{_CJK}]|[\r\n]+|\d+|\*\*[^*\n]+\*\*|#[^\s#]+|-{{2,}}|\S"
)
_CUT_MARKS = ("[...]", "...", "…")
_LAST_WORD = re.compile(r"\w(?=\W*\Z)")
_STOP = re.compile(r"[.?!](?=\s|$)|。")
_ENDS, _PAUSES, _KINDS = frozenset(".?!。"), frozenset(",;:"), frozenset("-*|>#^`")
_BLANKS = " \t\r\n\x0b\x0c\xa0　﻿​"
_LINK, _NUMBER, _TAG, _PAD, _ANY = "[[]]", "0", "#t", "^^", "**"


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def mask(token: str) -> str:
    """A token with what varies freely taken out: links, emphasis, numbers, tags, runs of line ends."""
    if token.startswith("[[") and token.endswith("]]") or (token.startswith("**") and len(token) > 4):
        return _LINK
    if token.isdigit():
        return _NUMBER
    if token[0] in "\r\n":
        return "\n"
    if token[0] == "#" and len(token) > 1:
        return _TAG
    return token


class _Tokens(dict):
    """Numbers of the distinct tokens of a block, with what is known of each."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _mix(parts: Sequence[np.ndarray], salt: int) -> np.ndarray:
    """One 64-bit number of several hashes in order."""
    h = np.full(len(parts[0]), salt, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Corpus:
    """The tokens of some texts as arrays, and the contexts in them."""

    def __init__(self, texts: Sequence[str], mentions: frozenset[tuple[str, ...]]):
        index = _Tokens()
        find = _TOKEN.findall
        ids: list[int] = []
        nl = index["\n"]
        bounds = []
        for t in texts:
            ids.append(nl)
            start = len(ids)
            ids += map(index.__getitem__, find(t))
            bounds.append((start, len(ids)))
        ids.append(nl)
        names = [mask(t) for t in index]
        raw = np.array(ids, np.int64)
        # What can be told of a token is told once per distinct token.
        low = [n.lower() for n in names]
        singles = {m[0] for m in mentions if len(m) == 1}
        longer: dict[str, list[tuple[str, ...]]] = {}
        for m in sorted(mentions, key=lambda m: (-len(m), m)):
            if len(m) > 1:
                longer.setdefault(m[0], []).append(m)
        link = np.uint64(_hash(_LINK))
        own = np.array([link if n in singles else _hash(names[k]) for k, n in enumerate(low)], np.uint64)
        self.h = own[raw]
        at = np.flatnonzero(np.array([n in longer for n in low], bool)[raw[:-1]]) if longer else raw[:0]
        keep = np.ones(len(raw), bool)
        upto = 0
        for k in at.tolist():
            # The longest mention that begins here, none inside another; line ends keep it within its text.
            for m in longer[low[ids[k]]] if k >= upto else ():
                if all(j < len(ids) and low[ids[j]] == w for j, w in enumerate(m[1:], k + 1)):
                    upto = k + len(m)
                    self.h[k] = link
                    keep[k + 1 : upto] = False
                    break
        place = np.cumsum(keep) - 1
        self.bounds = [(place[s], place[e - 1] + 1 if e > s else 0) for s, e in bounds]
        self.h, raw = self.h[keep], raw[keep]
        flag = lambda f: np.array([f(n) for n in names], bool)[raw]
        self.is_nl, self.ends, self.pauses = flag(lambda n: n == "\n"), flag(lambda n: n in _ENDS), flag(lambda n: n in _PAUSES)
        cjk = re.compile(f"[{_CJK}]")
        self.is_word, self.raw, self.names = flag(lambda n: n[0].isalpha() and not cjk.match(n)), raw, names
        i = np.arange(len(raw))
        self.line = np.maximum.accumulate(np.where(self.is_nl, i + 1, 0))
        self.line[self.is_nl] = i[self.is_nl]
        kinds = np.array([_hash(n) if n in _KINDS or n == _NUMBER else 7 for n in names], np.uint64)
        self.kind = kinds[raw[np.minimum(self.line, len(raw) - 1)]]

    def lag(self, k: int, at: np.ndarray) -> np.ndarray:
        """The token ``k`` before each place, or the pad before its line."""
        j = at - k
        return np.where(j >= self.line[at], self.h[np.maximum(j, 0)], np.uint64(_hash(_PAD)))

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        """The contexts of each place, the most telling first."""
        w = [self.lag(k, at) for k in range(6)]
        kind, any_ = self.kind[at], np.full(len(at), _hash(_ANY), np.uint64)
        return [
            _mix([kind, w[4], w[3], any_, w[1], w[0]], 2), _mix([kind, w[5], w[4], any_, w[2], w[1], w[0]], 3), _mix([kind, w[3], w[2], w[1], w[0]], 4),
            _mix([kind, w[2], w[1], w[0]], 5), _mix([kind, w[3], w[2], w[1], any_], 6), _mix([w[0]], 7),
        ]

    def openings(self, at: np.ndarray) -> np.ndarray:
        """The opening of each line that begins at a place."""
        nxt = np.minimum(at + 1, len(self.h) - 1)
        alone = np.isin(self.h[at], np.array([_hash(_TAG), _hash("--")], np.uint64))
        return _mix([self.h[at], np.where(alone | self.is_nl[nxt], np.uint64(_hash(_PAD)), self.h[nxt])], 8)


def _open(text: str) -> bool:
    """Whether a text leaves something open that its note would close."""
    if text.endswith("�") or text.count("```") % 2:
        return True
    last = text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]
    if last.rfind("[[") > last.rfind("]]") or (not last.endswith("**") and last.replace("***", "").count("**") % 2):
        return True
    if last.startswith("|") and not last.endswith("|"):
        return True
    return text.startswith("---") and re.search(r"[\r\n]---", text[3:]) is None


_STATUS = {"blank": 0, "open": 1, "ended": 2, "ask": 3}
_TAIL = "doc KEY, source string, n_chars long, n_bytes long, digest long, size long, ladder array<long>, status int, word string, keys array<long>, opening long, short boolean, stops long, words long"
_EVIDENCE = "kind string, word string, key long, ends long, runs long, pauses long, whole long"
#: A map of hashes has so many bits for each, within these bounds (at most 128 MB); a fuller map lets more pass that nobody asks about, no fewer.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 30


def _stem(text: str | None) -> tuple[str, bool]:
    """A text without outer blanks and the marks some tools put where they cut, and whether it had such."""
    bare = (text or "").strip(_BLANKS)
    for mark in _CUT_MARKS:
        if bare.endswith(mark):
            return bare[: -len(mark)].rstrip(), True
    return bare, False


def _tails(batches: Iterator[pa.RecordBatch], mentions: frozenset[tuple[str, ...]]) -> Iterator[pa.RecordBatch]:
    """One row for each text: its sizes and hashes, how it ends, and the contexts of its last token."""
    for block, texts in text_blocks(batches, 2):
        stems = [_stem(t) for t in texts]
        lines = [s[max(s.rfind("\n"), s.rfind("\r")) + 1 :] for s, _ in stems]
        corpus = Corpus(lines, mentions)
        tails = np.array([e - 1 if e > s else -1 for s, e in corpus.bounds], np.int64)
        at = np.maximum(tails, 0)
        keys = [_signed(k).tolist() for k in corpus.keys(at)]
        heads = _signed(corpus.openings(np.minimum(corpus.line[at], len(corpus.h) - 1))).tolist()
        # The opening of a line of two tokens or less holds the last token itself, so it tells nothing of how the line goes on.
        short = pa.array((at - corpus.line[at]) < 2, pa.bool_())
        status, word, ladders, sizes, asked = [], [], [], [], []
        for k, (stem, shortened) in enumerate(stems):
            t = tails[k]
            if t < 0:
                state = "blank"
            elif _open(stem):
                state = "open"
            elif (corpus.ends[t] and not shortened) or stem.endswith("```"):
                state = "ended"
            else:
                state = "ask"
            status.append(_STATUS[state])
            asked.append([x[k] for x in keys] if state == "ask" else [])
            word.append(corpus.names[corpus.raw[t]] if state == "ask" and corpus.is_word[t] else None)
            flat = " ".join(stem.split())
            sizes.append(len(flat))
            steps, step = [], FIRST_STEP
            while step <= len(flat):
                steps.append(_hash(flat[:step]))
                step *= 2
            ladders.append(_signed(np.array([*steps, _hash(flat)], np.uint64)).tolist())
        long, longs = pa.int64(), pa.list_(pa.int64())
        columns = [
            block.column(0), block.column(1), pa.array([len(t or "") for t in texts], long), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], long),
            pa.array(_signed(np.array([_hash(t or "") for t in texts], np.uint64)), long), pa.array(sizes, long), pa.array(ladders, longs), pa.array(status, pa.int32()),
            pa.array(word, pa.string()), pa.array(asked, longs), pa.array(heads, long), short,
            pa.array([len(_STOP.findall(s)) for s, _ in stems], long), pa.array([s.count(" ") + 1 for s, _ in stems], long),
        ]
        yield pa.RecordBatch.from_arrays(columns, "doc source n_chars n_bytes digest size ladder status word keys opening short stops words".split())


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values))


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys a bit map holds."""
    bit = keys & np.uint64(len(bits) * 64 - 1)
    return np.flatnonzero((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


#: Rows of counts a task folds, and hands on if they are as many still.
FOLD_ROWS, HAND_ON_ROWS, HAND_ON_WORDS = 2_000_000, 1_500_000, 500_000


def _evidence(batches: Iterator[pa.RecordBatch], mentions: frozenset[tuple[str, ...]], asked: np.ndarray, copied: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of one task: contexts that are asked about ``c``, openings of lines ``o`` and words ``w``.

    Openings are those of distinct texts: of texts that may have copies they are
    given text by text, ``whole`` telling which, so that copies can be dropped.
    Where a text opens other lines as its last one, ``l`` gives their number.
    """
    held: list[tuple[np.ndarray, ...]] = []
    openings: list[tuple[np.ndarray, ...]] = []
    words: Counter[str] = Counter()
    names = "kind word key ends runs pauses whole".split()
    long = pa.int64()

    def rows(kind: str, word=None, key=None, ends=None, runs=None, pauses=None, whole=None) -> pa.RecordBatch:
        n = len(runs)
        fill = lambda v: pa.nulls(n, long) if v is None else pa.array(v, long)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(word or [None] * n, pa.string()), fill(key), fill(ends), fill(runs), fill(pauses), fill(whole)], names)

    def contexts(parts) -> Iterator[pa.RecordBatch]:
        k, e, r, p = _summed(*(np.concatenate(x) for x in zip(*parts)))
        for s in range(0, len(k), 100_000):
            cut = slice(s, s + 100_000)
            yield rows("c", key=_signed(k[cut]), ends=e[cut], runs=r[cut], pauses=p[cut])

    def opened(parts) -> Iterator[pa.RecordBatch]:
        k, e, r = _summed(*(np.concatenate(x) for x in zip(*parts)))
        for s in range(0, len(k), 100_000):
            cut = slice(s, s + 100_000)
            yield rows("o", key=_signed(k[cut]), ends=e[cut], runs=r[cut])

    for block, texts in text_blocks(batches, 0):
        stems = [_stem(t)[0] for t in texts]
        corpus = Corpus(stems, mentions)
        n = len(corpus.h)
        # A text's last token is what is asked about, so it is no evidence.
        tails = np.array([e - 1 for s, e in corpus.bounds if e > s], np.int64)
        evidence = ~corpus.is_nl
        evidence[tails] = False
        at = np.flatnonzero(evidence)
        nxt = np.minimum(at + 1, n - 1)
        ends = (corpus.ends[nxt] | corpus.is_nl[nxt]).astype(np.int64)
        pauses = corpus.pauses[nxt].astype(np.int64)
        runs = 1 - ends - pauses
        for k in corpus.keys(at):
            hit = _in_map(asked, k)
            held.append(_summed(k[hit], ends[hit], runs[hit], pauses[hit]))
        times = np.bincount(corpus.raw[at[corpus.is_word[at]]], minlength=len(corpus.names))
        for w in np.flatnonzero(times).tolist():
            words[corpus.names[w]] += int(times[w])
        starts = np.flatnonzero(~corpus.is_nl & (np.arange(n) == corpus.line))
        last_line = np.zeros(n, bool)
        last_line[corpus.line[tails]] = True
        heads, last = corpus.openings(starts), last_line[starts].astype(np.int64)
        whole = np.array([_hash(" ".join(s.split())) for s in stems], np.uint64)
        of = np.searchsorted(np.array([s for s, _ in corpus.bounds], np.int64), starts, side="right") - 1
        final = np.zeros(len(stems), np.uint64)
        final[of[last > 0]] = heads[last > 0]
        more = np.bincount(of[heads == final[of]], minlength=len(stems))
        again = np.flatnonzero(more > 1)
        if len(again):
            yield rows("l", key=_signed(final[again]), runs=more[again], whole=_signed(whole[again]))
        single = np.zeros(len(stems), bool)
        single[_in_map(copied, whole)] = True
        alone = ~single[of]
        openings.append(_summed(heads[alone], last[alone], np.ones(int(alone.sum()), np.int64)))
        if not alone.all():
            text, h, e = of[~alone], heads[~alone], last[~alone]
            order = np.lexsort((h, text))
            text, h, e = text[order], h[order], e[order]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
            yield rows("o", key=_signed(h[first]), ends=np.add.reduceat(e, first), runs=np.diff(np.append(first, len(h))), whole=_signed(whole[text[first]]))
        if sum(len(x[0]) for x in held) > FOLD_ROWS:
            held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
            if len(held[0][0]) > HAND_ON_ROWS:
                yield from contexts(held)
                held = []
        if sum(len(x[0]) for x in openings) > FOLD_ROWS:
            openings = [_summed(*(np.concatenate(x) for x in zip(*openings)))]
            if len(openings[0][0]) > HAND_ON_ROWS:
                yield from opened(openings)
                openings = []
        if len(words) > HAND_ON_WORDS:
            yield rows("w", word=list(words), runs=list(words.values()))
            words.clear()
    if held:
        yield from contexts(held)
    if openings:
        yield from opened(openings)
    if words:
        yield rows("w", word=list(words), runs=list(words.values()))


def _map(keys: DataFrame) -> np.ndarray:
    """The bit map of some keys (k), as large as their number asks for, put together by the cluster."""
    n_bits = LEAST_BITS
    while n_bits < min(BITS_EACH * keys.count(), MOST_BITS):
        n_bits *= 2
    at = keys.select(F.col("k").bitwiseAND(n_bits - 1).alias("b"))
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    rows = at.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _limits(docs: DataFrame, measure: str, per_char: float, per_word: float) -> DataFrame:
    """(source, measure, _n, _by_chance) of the lengths at which a source piles up distinct texts.

    ``_n`` is the number of texts there, ``_by_chance`` whether so few of them
    end a sentence that the cut alone explains it.  Where lengths just below
    pile up too, the source cuts between words, else at a character.
    """
    per = docs.where("status > 0").groupBy("source", measure).agg(F.count_distinct("digest").alias("_n"), F.count_distinct(F.when(F.col("status") == _STATUS["ended"], F.col("digest"))).alias("_ended"))
    near = Window.partitionBy("source").orderBy(measure)
    usual = F.coalesce(F.sum("_n").over(near.rangeBetween(-LIMIT_FROM, -LIMIT_TO)), F.lit(0)) / (LIMIT_FROM - LIMIT_TO + 1)
    piled = (F.col("_n") >= LIMIT_TEXTS) & (F.col("_n") >= LIMIT_RATIO * usual) & (F.col(measure) >= FIRST_STEP)
    marked = per.withColumn("_piled", piled)
    between = F.coalesce(F.max(F.col("_piled").cast("int")).over(near.rangeBetween(-3, -1)), F.lit(0)) + F.coalesce(F.max(F.col("_piled").cast("int")).over(near.rangeBetween(1, 3)), F.lit(0)) > 0
    chance = F.when(between, per_word).otherwise(per_char)
    # Half a text more than chance gives, so that few texts are judged like many.
    few = F.col("_ended") <= CHANCE_RATIO * chance * F.col("_n") + 0.5
    return marked.withColumn("_few", few).where("_piled").select("source", measure, F.col("_n").alias(f"_n_{measure}"), F.col("_few").alias(f"_few_{measure}"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it proves to have at most so many rows."""
    return F.broadcast(df) if fits(df, rows) else df


def _prefixes(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc) of the texts that are strict prefixes of longer ones, blanks aside."""
    steps = F.size("ladder") - 1
    have = docs.where(F.col("status") > 0).select("doc", "size", "ladder", steps.alias("steps")).where("steps > 0")
    own = have.select("doc", "size", F.col("steps").alias("step"), F.element_at("ladder", F.col("steps")).alias("mark"), F.element_at("ladder", -1).alias("whole"))
    every = have.select("doc", "size", F.posexplode(F.slice("ladder", 1, F.col("steps"))).alias("step", "mark")).withColumn("step", F.col("step") + 1)
    longest = every.groupBy("step", "mark").agg(F.max("size").alias("longest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    open_ = own.join(longest, ["step", "mark"]).where("longest > size").select("doc", "size", "step", "mark", "whole")
    sizes = open_.groupBy("step", "mark").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    members = every.join(sizes, ["step", "mark"]).where(F.col("size") > F.element_at("sizes", 1))
    of = written(members.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sizes")))).alias("sizes")), "members")
    n = of.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("sizes")).alias("cuts")).first()
    few = n.rows <= MEMBER_ROWS and (n.cuts or 0) <= MEMBER_CUTS
    reading = texts.join(F.broadcast(of) if few else of, "doc").select("text", "sizes")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block, read in text_blocks(batches, 0):
            out = set()
            for t, cuts in zip(read, block.column(1).to_pylist()):
                flat = " ".join(_stem(t)[0].split())
                last = max((m.start() for m in _LAST_WORD.finditer(flat)), default=-1)
                rolling, upto = xxhash.xxh64(), 0
                for c in cuts:  # in order, so that each character is hashed once
                    if c > last:
                        break
                    rolling.update(flat[upto:c].encode("utf-8", "surrogatepass"))
                    upto = c
                    out.add((c, int(_signed(np.array([rolling.intdigest()], np.uint64))[0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["size", "whole"])

    found = reading.mapInArrow(heads, "size long, whole long").distinct()
    return open_.join(found, ["size", "whole"], "left_semi").select("doc").distinct()


def truncated(docs: DataFrame, key: str, text: str, source: str, mentions: Sequence[str] = ()) -> DataFrame:
    """(key, source, truncated, reason): whether each text was cut off before its end.

    ``reason`` is the first of ``prefix``, ``word``, ``passage``, ``open`` and ``limit`` that holds, null for a whole text.
    ``mentions`` are names that stand in for each other in a passage (a bounded
    list).  ``key`` must be unique; rows with a null key are judged alike but
    cannot be told apart.  Null, empty and blank texts are whole.  A null source
    counts as the empty one.  Very long texts are read whole, one block each.
    """
    names = frozenset(filter(None, (tuple(m.lower().replace("-", " ").split()) for m in mentions)))
    src = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    ddl = _TAIL.replace("KEY", src.schema["doc"].dataType.simpleString())
    d = written(src.mapInArrow(lambda batches: _tails(batches, names), ddl), "tails")
    asked = src.sparkSession.sparkContext.broadcast(_map(d.select(F.explode("keys").alias("k"))))
    whole = F.element_at("ladder", -1)
    copied = src.sparkSession.sparkContext.broadcast(_map(d.groupBy(whole.alias("k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")))
    found = written(src.select("text").mapInArrow(lambda batches: _evidence(batches, names, asked.value, copied.value), _EVIDENCE), "evidence")
    contexts = found.where("kind = 'c'").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("ends", "runs", "pauses")))
    once = lambda c: F.when(F.col("whole").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c)
    opened = found.where("kind = 'o'").groupBy("key", "whole").agg(once("ends"), once("runs"))
    closing = written(opened.groupBy(F.col("key").alias("opening")).agg(F.sum("ends").alias("_last"), F.sum("runs").alias("_all")).where(F.col("_last") > CLOSING_COUNT), "closing")
    lines = found.where("kind = 'l'").select("whole", F.col("key").alias("opening"), F.col("runs").alias("_own")).join(closing.select("opening"), "opening", "left_semi").distinct()
    # Words that end closing lines stand nowhere else, perhaps; behind the same opening they are known by the other texts they end.
    ended = d.where("word is not null").select(whole.alias("whole"), "opening", "word").join(closing.select("opening"), "opening", "left_semi").distinct().groupBy("opening", "word").agg(F.count(F.lit(1)).alias("_same"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.struct(F.substr("word", F.lit(1), n).alias("word"), F.when(n == F.length("word"), F.col("_same")).alias("_same"), F.col("_same").alias("_begun"))))
    last_words = ended.select("opening", starts.alias("x")).groupBy("opening", F.col("x.word").alias("word")).agg(F.sum("x._same").alias("_same"), F.sum("x._begun").alias("_begun")).where("_same is not null")
    words = found.where("kind = 'w'").groupBy("word").agg(F.sum("runs").alias("_known"))
    longer = words.where("_known > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substr("word", F.lit(1), n))).alias("word"), "_known").where("word <> ''").groupBy("word").agg(F.sum("_known").alias("_longer"))
    ask = d.where(F.col("status") == _STATUS["ask"])
    met = ask.select("doc", F.posexplode("keys").alias("_j", "key")).join(contexts, "key")
    total = F.col("ends") + F.col("runs") + F.col("pauses")
    n_keys = 6
    of = [F.max(F.when((F.col("_j") == j) & (total >= (CONTEXT_COUNT if j < 5 else 1)), F.struct("ends", "runs", "pauses"))).alias(f"_k{j}") for j in range(n_keys)]
    evidence = met.groupBy("doc").agg(*of)
    verdict: Column = F.lit(None).cast("boolean")
    for j in reversed(range(5)):
        k = F.col(f"_k{j}")
        runs_on = F.when(k.ends + k.runs == 0, F.lit(True)).otherwise(k.ends < END_SHARE * (k.ends + k.runs))
        if j == 4:  # the last word counts for nothing here, so it must be one that ends sentences
            last = F.col("_k5")
            runs_on = runs_on | last.isNull() | (last.ends < 2) | (last.ends * 100 < last.runs)
        verdict = F.when(k.isNotNull(), runs_on).otherwise(verdict)
    sums = d.where("status > 0").agg(F.sum("stops").alias("stops"), F.sum("n_chars").alias("chars"), F.sum("words").alias("words")).first()
    limits = {m: written(_limits(d, m, (sums.stops or 0) / max(sums.chars or 0, 1), (sums.stops or 0) / max(sums.words or 0, 1)), "limits") for m in ("n_chars", "n_bytes")}
    joined = (
        d.withColumn("whole", whole)
        .drop("keys", "ladder")
        .join(closing, "opening", "left")
        .join(lines, ["whole", "opening"], "left")
        .join(last_words, ["opening", "word"], "left")
        .join(words, "word", "left")
        .join(longer, "word", "left")
        .join(evidence, "doc", "left")
        .join(_small(limits["n_chars"], LIMIT_ROWS), ["source", "n_chars"], "left")
        .join(_small(limits["n_bytes"], LIMIT_ROWS), ["source", "n_bytes"], "left")
        .join(_prefixes(d, src.select("doc", "text")).withColumn("_prefix", F.lit(True)), "doc", "left")
    )
    unknown = F.col("word").isNotNull() & (F.coalesce("_known", F.lit(0)) < 2)
    # What a text and its copies add themselves is no evidence.
    others, of_others = F.col("_last") - 1, F.col("_all") - F.coalesce("_own", F.lit(1))
    closes = F.coalesce((others >= CLOSING_COUNT) & (others * 2 > of_others), F.lit(False))
    fellows = F.coalesce("_same", F.lit(1)) - 1
    usual = (fellows >= CLOSING_COUNT) & (fellows * 2 > F.coalesce("_begun", F.lit(1)) - 1)
    longer_there = F.coalesce(F.col("_begun") > F.col("_same"), F.lit(False))
    ended = F.col("status") == _STATUS["ended"]
    in_chars, in_bytes = F.coalesce("_n_n_chars", F.lit(0)), F.coalesce("_n_n_bytes", F.lit(0))
    # Of two limits a text may be at, the one more texts are at is the source's.
    few = F.when(in_chars >= in_bytes, F.col("_few_n_chars")).otherwise(F.col("_few_n_bytes"))
    at_limit = (in_chars + in_bytes > 0) & (~ended | few)
    ask = F.col("status") == _STATUS["ask"]
    cut_word = unknown & ((F.coalesce("_longer", F.lit(0)) > 0) | longer_there) & ~(closes & usual & ~F.col("short"))
    reason = (
        F.when(F.col("status") == _STATUS["blank"], None)
        .when(F.col("_prefix") & (~ended | (F.col("size") >= SURE_PREFIX)), "prefix")
        .when(ask & cut_word, "word")
        .when(ask & ~(closes & ~F.col("short")) & ~unknown & verdict, "passage")
        .when(F.col("status") == _STATUS["open"], "open")
        .when(at_limit, "limit")
    )
    out = joined.select(F.col("doc").alias(key), F.col("source").alias(source), reason.cast("string").alias("reason"))
    return out.select(key, source, F.col("reason").isNotNull().alias("truncated"), "reason")


def truncation_report(found: DataFrame, source: str) -> DataFrame:
    """(source, n_texts, n_truncated, share): how often each source truncates."""
    return found.groupBy(source).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("double")).alias("share"))
