"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent character n-grams (1 to 3 letters, words
bounded by a space), counted over all learning rows. A document's own ranking, over its
whole text, is compared with each profile by the out-of-place distance: the sum of rank
differences, where an n-gram that the profile lacks costs the profile's length.

Defined cases: null text and text without letters give `und` and score 0; so does every
text if nothing was learned; rows with null lang, text or doc_id are not learned from;
equal counts rank by the n-gram's overall frequency, then by its code; equal distances
go to the smaller language name; repeated rows count each time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, unused

UNKNOWN = "und"


class GramCoder:
    """Codes of a text's n-grams: letters in lower case, anything else a word border."""

    def __init__(self) -> None:
        self.letter = np.array([chr(c).isalpha() for c in range(0x10000)])

    def sequence(self, text: str | None) -> np.ndarray:
        """Letters as code point + 1 with single 1s between words; empty without letters."""
        if not text:
            return np.empty(0, dtype=np.int64)
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.letter[np.minimum(c, 0xFFFF)]
        for k in np.flatnonzero(c > 0xFFFF):
            is_letter[k] = chr(c[k]).isalpha()
        if not is_letter.any():
            return np.empty(0, dtype=np.int64)
        seq = np.ones(len(c) + 2, dtype=np.int64)
        seq[1:-1] = np.where(is_letter, c + np.uint32(1), 1)
        keep = seq != 1
        keep[1:] |= seq[:-1] != 1
        keep[0] = True
        return seq[keep]

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of a text and how often each occurs."""
        s = self.sequence(text)
        if not len(s):
            return s, s
        two = (s[:-1] << 21) | s[1:]
        return np.unique(np.concatenate([s[s != 1], two, (two[:-1] << 21) | s[2:]]), return_counts=True)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return [(codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64))]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text); summed inside each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size = GramCoder(), {}, {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = coder.counts(text)
                held.setdefault(lang, []).append(got)
                size[lang] = size.get(lang, 0) + len(got[0])
                if size[lang] > 1_000_000:
                    held[lang] = _merge(held[lang])
                    size[lang] = len(held[lang][0][0]) // 2
        for lang, parts in held.items():
            codes, n = _merge(parts)[0]
            for at in range(0, len(codes), 50_000):
                part = slice(at, at + 50_000)
                yield pa.record_batch([pa.array([lang] * len(codes[part]), pa.string()), pa.array(codes[part], pa.int64()), pa.array(n[part], pa.int64())], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """Ranked n-grams of the languages, as arrays for look-up."""

    def __init__(self, rows: list, size: int):
        """rows: (lang, gram, n, place); place counts from 1."""
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        total = np.zeros(len(self.codes) + 1, dtype=np.int64)
        name = {x: k for k, x in enumerate(self.langs)}
        at = np.searchsorted(self.codes, np.array([r[1] for r in rows], dtype=np.int64))
        for r, k in zip(rows, at):
            self.places[name[r[0]], k] = r[3] - 1
            total[k] += r[2]
        self.total = total

    def rank(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Indices into self.codes (its length: none) of a document's n-grams, most frequent first."""
        k = np.searchsorted(self.codes, codes)
        k[k == len(self.codes)] = 0
        k = np.where(self.codes[k] == codes, k, len(self.codes))
        return k[np.lexsort((codes, -self.total[k], -counts))[: self.size]]

    def predict(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        k = self.rank(codes, counts)
        place = self.places[:, k]
        apart = np.where(place < 0, self.size, np.minimum(np.abs(place - np.arange(len(k))), self.size)).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(k))


def learn(rows: DataFrame, size: int = 400) -> Profiles:
    """Profiles from rows (lang, text); what is collected is size n-grams per language."""
    rows = rows.where("lang is not null and text is not null")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(rows).withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    return Profiles([tuple(r) for r in top.select("lang", "gram", "n", "place").collect()], size)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "has_letters")) -> DataFrame:
    """The columns `keep` of docs with the prediction for column text, its score, and whether the text holds a letter."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = GramCoder()
        for b in slices(batches):
            grams = [coder.counts(t) for t in b.column(b.num_columns - 1).to_pylist()]
            found = [profiles.predict(*g) for g in grams]
            yield pa.record_batch([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()), pa.array([len(g) > 0 for g, _ in grams], pa.bool_())], names=[*b.schema.names[:-1], *names])

    (whole,) = unused(docs, "whole")
    own = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")


def language_id(docs: DataFrame, train: Column, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; rows where `train` is true teach."""
    profiles = learn(docs.where(train & F.col("doc_id").isNotNull()), size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~train, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles, ["doc_id", "held_out"]).drop("has_letters")
