"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is the stated query set. It is taken in blocks of bounded size, some of
which go through the documents together; a scan finds, document by document, the items
with a matched n-gram, and aligns each with the stretches of the document that hold one,
unless too few of the item's words occur in a stretch for the score. How often other documents hold an item does not matter,
unless a caller asks for a gate by rarity: then a scan before counts in how many documents
each n-gram occurs. Nothing but counts is shuffled.

Words are lower-cased, ASCII punctuation parts them. Defined cases: null or wordless
items and documents match nothing; an item shorter than the n-gram is sought as a whole;
each row of documents is judged by itself, also where a doc_id repeats; items that share
an id are separate; equal alignments go to the earlier one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

BREAKS = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: str | None) -> list[bytes]:
    return [] if not text else text.lower().encode("utf-8", "surrogatepass").translate(BREAKS).split()


def best_end(item: np.ndarray, part: np.ndarray, match: int, mismatch: int, gap: int) -> tuple[int, int, int]:
    """(score, words of item, words of part) at the end of the best local alignment, the first in item and then in part; one row at a time."""
    row, best = np.zeros(len(part) + 1, dtype=np.int32), (0, 0, 0)
    slope = np.arange(len(part) + 1, dtype=np.int32) * -gap
    for i in range(len(item)):
        now = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(part == item[i], match, mismatch), row[1:] + gap, out=now[1:])
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + slope) - slope
        high = int(row.max())
        if high > best[0]:
            best = (high, i + 1, int(row.argmax()))
    return best


def align(item: np.ndarray, part: np.ndarray, least: int = 1, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: (score, start, end) of the best local alignment in part, in linear space.

    The start is found by aligning backwards from the end; for scores below `least` it is
    not sought.
    """
    score, i, j = best_end(item, part, match, mismatch, gap)
    if score < max(least, 1):
        return score, 0, 0
    low = max(0, j - i - match * i // -gap)  # more words of part than that cost more gaps than there are matches
    _, _, back = best_end(item[:i][::-1], part[low:j][::-1], match, mismatch, gap)
    return score, j - back, j


class ItemBlock:
    """A bounded part of the benchmark, ready for look-up."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.n = n
        self.ids = [i for i, _ in items]
        self.known: dict[bytes, int] = {}
        self.items = [np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], dtype=np.int64) for _, words in items]
        self.base = len(self.known) + 1
        grams, owner = [], []
        for k, words in enumerate(self.items):
            g = self.grams(words if len(words) >= n else np.concatenate([words, np.zeros(n - len(words), dtype=np.int64)]))
            grams.append(g)
            owner.append(np.full(len(g), k))
        flat, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.lexsort((owner, flat))
        flat, self.owner = flat[order], owner[order]
        self.codes, at = np.unique(flat, return_index=True)
        self.starts = np.append(at, len(flat))
        self.short = sorted({len(w) for w in self.items if len(w) < n})
        self.bits: np.ndarray | None = None

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Codes of n consecutive word ids; an unknown word (0) only passes as padding of a short item."""
        out = ids[: len(ids) - self.n + 1].copy()
        for k in range(1, self.n):
            out = self.coded(out, ids[k : len(ids) - self.n + 1 + k])
        return out

    def coded(self, code: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The code of an n-gram with one more word: a number to the base, or a 64-bit hash if that would not fit."""
        if self.base**self.n < 1 << 62:
            return code * self.base + ids
        return mix(code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64)).view(np.int64)

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document and the n-grams (indices into codes) found there."""
        found_at, found = [], []
        for size in [self.n, *self.short]:
            if len(ids) < size:
                continue
            run = np.ones(len(ids) - size + 1, dtype=bool)
            for k in range(size):
                run &= ids[k : len(ids) - size + 1 + k] > 0
            at = np.flatnonzero(run)
            code = np.zeros(len(at), dtype=np.int64)
            for k in range(self.n):
                word = ids[at + k] if k < size else np.zeros(len(at), dtype=np.int64)
                code = word if k == 0 else self.coded(code, word)
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ok = self.codes[k] == code
            found_at.append(at[ok])
            found.append(k[ok])
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(found_at), np.concatenate(found)

    def matches(self, ids: np.ndarray, least_bits: float | None, least_grams: int, score: float) -> list[tuple]:
        """(item, score in 0..1, first word, end word) of the items that reach the score in a document."""
        at, gram = self.hits(ids)
        if not len(at):
            return []
        size = self.starts[gram + 1] - self.starts[gram]
        owner = self.owner[np.repeat(self.starts[gram], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        at, gram = np.repeat(at, size), np.repeat(gram, size)
        pair = np.unique(owner * len(self.codes) + gram)
        of = pair // len(self.codes)
        several = np.bincount(of, minlength=len(self.items))
        taken = several >= least_grams
        if self.bits is not None:
            taken |= np.bincount(of, weights=self.bits[pair % len(self.codes)], minlength=len(self.items)) >= least_bits
        out = []
        for k in np.flatnonzero(taken):
            item = self.items[k]
            spots = np.unique(at[owner == k])
            best = (0, 0, 0)
            for group in np.split(spots, np.flatnonzero(np.diff(spots) > len(item)) + 1):
                low, high = max(0, group[0] - len(item)), min(len(ids), group[-1] + self.n + len(item))
                if np.isin(item, ids[low:high]).sum() < max(score * len(item), best[0] / 2):
                    continue
                got = align(item, ids[low:high], max(int(np.ceil(2 * score * len(item))), best[0] + 1))
                if got[0] > best[0]:
                    best = (got[0], low + got[1], low + got[2])
            if best[0] >= score * 2 * len(item):
                out.append((self.ids[k], best[0] / (2 * len(item)), int(best[1]), int(best[2])))
        return out


def item_blocks(benchmark: DataFrame, n: int, block_words: int) -> Iterator[ItemBlock]:
    """The benchmark in id order, in blocks of at most block_words words (one item at least)."""
    held, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if held and size + len(words) > block_words:
            yield ItemBlock(held, n)
            held, size = [], 0
        held.append((item_id, words))
        size += len(words)
    if held:
        yield ItemBlock(held, n)


def _weigh(docs: DataFrame, block: ItemBlock) -> None:
    """Set the block's bits: how rare each n-gram is among all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(block.codes) + 1, dtype=np.int64), 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen[np.unique(block.hits(block.ids_of(words_of(text)))[1])] += 1
            rows += b.num_rows
        seen[-1] = rows
        k = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(k, pa.int64()), pa.array(seen[k], pa.int64())], names=["gram", "n"])

    counts = np.zeros(len(block.codes) + 1)
    for r in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    block.bits = np.log2((counts[-1] + 1) / (counts[:-1] + 1))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least_bits: float | None = None, least_grams: int = 1, score: float = 0.5, block_words: int = 200_000, blocks: int = 8) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each benchmark item that a document holds.

    score is the alignment score over that of a perfect copy. An item is aligned if
    least_grams of its n-grams are matched (by default one) or, where least_bits is given,
    matched ones tell so much. block_words bounds a block of the benchmark and blocks how
    many are sent to the tasks at once, for one scan of the documents.
    """
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    every = item_blocks(benchmark, n, block_words)
    while some := list(itertools.islice(every, blocks)):
        if least_bits is not None:
            for block in some:
                _weigh(docs, block)

        def run(batches: Iterator[pa.RecordBatch], some: list[ItemBlock] = some) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = words_of(text)
                    for block in some:
                        rows += [(doc_id, *m) for m in block.matches(block.ids_of(words), least_bits, least_grams, score)]
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "score", "start_word", "end_word"), r)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    return out
