"""Byte-level BPE of a whole corpus by replaying the merges over its words.

The texts of a block are cut into words, and each distinct word is encoded
once: an inverted index from token pair to word positions applies every merge
that occurs in rank order, touching only the neighbours of merged positions.
No text is shuffled; blocks are bounded by their characters, not their rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultweave.session import per_process

#: Characters of text whose distinct words are replayed together, and words a task remembers.
BLOCK_CHARS, KNOWN_WORDS = 8_000_000, 400_000
#: The published word pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeReplay:
    """A byte-level BPE vocabulary file (the ``tokenizers`` JSON form), ready to encode."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.words = regex.compile(PATTERN).findall
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym += [self.of_byte[b] for b in w.encode("utf-8", "surrogatepass")]
            sym.append(-1)  # no pair crosses it
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        where: dict[tuple[int, int], list[int]] = {}
        merges, heap = self.merges, []
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            at = where.get(pair)
            if at is not None:
                at.append(i)
            elif pair in merges:
                where[pair] = [i]
                heap.append(merges[pair][0])
        by_rank = {merges[p][0]: p for p in where}
        heapq.heapify(heap)
        while heap:
            pair = by_rank.pop(heapq.heappop(heap))
            a, b = pair
            new = merges[pair][1]
            for i in sorted(where.pop(pair)):
                if sym[i] != a:
                    continue
                j = right[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i] = new
                sym[j] = -2
                k = right[j]
                right[i] = k
                if k < n:
                    left[k] = i
                for p in (left[i], i):
                    if p < 0 or right[p] >= n:
                        continue
                    q = (sym[p], sym[right[p]])
                    at = where.get(q)
                    if at is not None:
                        at.append(p)
                    elif q in merges:
                        where[q] = [p]
                        rank = merges[q][0]
                        by_rank[rank] = q
                        heapq.heappush(heap, rank)
        out = []
        for s, e in zip(starts, [*starts[1:], n]):
            out.append([t for t in sym[s : e - 1] if t >= 0])
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes the words not known yet; forgets all when they are too many."""
        fresh = words - self.index.keys()
        if len(self.index) + len(fresh) > KNOWN_WORDS and self.index:
            self.index, self.flat, self.ends, fresh = {}, np.zeros(0, np.int32), np.zeros(1, np.int64), words
        if fresh:
            order = sorted(fresh)
            ids = self.replay(order)
            base = len(self.ends) - 1
            self.index.update((w, base + k) for k, w in enumerate(order))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each text); none for null or empty."""
        cut = [self.words(t) if t else [] for t in texts]
        self.learn({w for words in cut for w in words})
        index = self.index
        which = np.fromiter((index[w] for words in cut for w in words), np.int64)
        per_word = (self.ends[1:] - self.ends[:-1])[which]
        total = int(per_word.sum())
        shift = np.repeat(self.ends[:-1][which] - (np.cumsum(per_word) - per_word), per_word)
        ids = self.flat[np.arange(total) + shift]
        words_in = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(words_in)])]
        return ids, np.diff(ends)


def load(path: str, run: str) -> MergeReplay:
    """The vocabulary at ``path`` and the words encoded so far, kept per process for the tasks of one run."""
    return per_process("bpe", (path, run), lambda: MergeReplay(path))


def text_blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches cut so that none holds many more than ``limit`` characters; one longer text is a block of its own."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= limit:
                yield batch.slice(start, k + 1 - start), texts[start : k + 1]
                start, size = k + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def token_ids(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids): the token ids of every text by the byte-level BPE at ``vocabulary``, without special tokens.

    A null or empty text has the empty list, never null; the strings of special
    tokens are ordinary text.  Repeated rows and null keys are kept as they are.
    """

    run = uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, run)
        for block, texts in text_blocks(batches):
            ids, lengths = coder.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(encode, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, tokens): the number of token ids of every text, 0 for null and empty."""

    run = uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, run)
        for block, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(coder.encode(texts)[1], pa.int64())], ["key", "tokens"])

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(count, f"key {kind}, tokens long").select(F.col("key").alias(key), "tokens")
