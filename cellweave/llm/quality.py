"""Quality classifier by positive-unlabelled learning.

A linear model over hashed character trigrams and how often words and lines repeat is
fitted by the non-negative risk: trusted positives and unlabelled text give an unbiased estimate of the classification risk under
the class prior, and where the estimated risk of negatives falls below zero the step goes
the other way. Negative labels are not read. The prior is estimated from positives and
unlabelled text: of a first model's scores on rows that it was not fitted on, the least
ratio of unlabelled to positive rows above a threshold, up to what chance allows.

What is fitted on: at most about `positive_rows` positives and `unlabelled_rows`
documents, taken by hash of their ids (both are parameters). Every document is scored,
over its whole text.

Defined cases: null text counts as empty; a document with labels of both kinds is no
trusted positive; rows with null doc_id are scored but not learned from; without
positives or unlabelled rows every score is 0.5; repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, slices

BUCKETS = 1024
N_FEATURES = BUCKETS + 7


def features(text: str | None, hasher: WordHasher, block: int = 1 << 20) -> np.ndarray:
    """Roots of the shares of hashed byte trigrams of a whole text, then lengths and repetition of its words and lines."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(N_FEATURES, dtype=np.float32)
    if not len(raw):
        return out
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw), block):
        part = np.concatenate([np.full(2 if at == 0 else 0, 32, np.uint8), raw[max(0, at - 2) : at + block]]).astype(np.uint32)
        code = (part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        counts += np.bincount(code >> np.uint32(22), minlength=BUCKETS)
    out[:BUCKETS] = np.sqrt(counts / counts.sum())
    lines = [x for x in text.split("\n") if x.strip()]
    words = hasher(text)
    n = max(1, len(words))
    _, each = np.unique(words, return_counts=True)
    out[BUCKETS:] = (
        np.log1p(len(raw)) / 10, np.log1p(n / max(1, len(lines))) / 5, len(set(lines)) / max(1, len(lines)), len(each) / n,
        each.max(initial=0) / n, np.sqrt((words[1:] == words[:-1]).sum() / n), out[:BUCKETS].sum() / np.sqrt(BUCKETS),
    )
    return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.01, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of both.

    Above any threshold at least that share of the positives' rate must be found among the
    unlabelled; the threshold is taken where the ratio with its error bound is least.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
    ok = above_p >= least
    error = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    bound = (above_u[ok] + error) / above_p[ok]
    k = int(np.argmin(bound))
    return float(np.clip(above_u[ok][k] / above_p[ok][k], least, 1 - least))


class PositiveUnlabelled:
    """A logistic model over standardised features, fitted by the non-negative risk in small batches."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 2000, batch: int = 1024, rate: float = 0.02, ridge: float = 1e-2, seed: int = 3):
        self.prior = prior
        self.weights = None
        if not len(positives) or not len(unlabelled):
            return
        self.mean = unlabelled.mean(axis=0)
        self.scale = unlabelled.std(axis=0) + 1e-3
        positives, unlabelled = self.design(positives), self.design(unlabelled)
        rng = np.random.default_rng(seed)
        w = np.zeros(positives.shape[1], dtype=positives.dtype)
        m, v, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            p, u = (x if len(x) <= batch else x[rng.integers(0, len(x), batch)] for x in (positives, unlabelled))
            zp, zu = p @ w, u @ w
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            toward = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
            g = prior * (p.T @ (sp - 1)) / len(p) + toward if negative >= 0 else -toward
            g = g + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            if t > steps // 2:
                total += w
        self.weights = total / (steps - steps // 2)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))]).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = (self.design(x).astype(np.float64) * self.weights).sum(axis=1)  # row by row, so that equal texts score alike
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fitted(positives: np.ndarray, unlabelled: np.ndarray) -> PositiveUnlabelled:
    """A model under the prior that the rows tell: a first model on even rows gives it from the odd ones."""
    if len(positives) < 2 or len(unlabelled) < 2:
        return PositiveUnlabelled(positives[:0], unlabelled[:0], 0.5)
    first = PositiveUnlabelled(positives[::2], unlabelled[::2], 0.5)
    prior = estimated_prior(first.scores(positives[1::2]), first.scores(unlabelled[1::2]))
    return PositiveUnlabelled(positives, unlabelled, prior)


def by_hash(key: str, share: float) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def learn(docs: DataFrame, labels: DataFrame, positive_rows: int = 8_000, unlabelled_rows: int = 12_000) -> PositiveUnlabelled:
    """A model from labels (doc_id, quality) and docs (doc_id, text), both of learning rows only."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"))
    good = ids.where("low = 1").select("doc_id")
    chosen = good.where(by_hash("doc_id", positive_rows / max(1, good.count()))).select("doc_id", F.lit(True).alias("trusted"))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.join(F.broadcast(chosen), "doc_id", "left")
    rows = rows.withColumn("open", by_hash("doc_id", unlabelled_rows / max(1, docs.count()))).where("trusted or open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches):
            found = [features(t, hasher).astype(np.float16).tobytes() for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), b.column(2), b.column(3), pa.array(found, pa.binary())], names=["doc_id", "trusted", "open", "x"])

    got = rows.select("text", "doc_id", F.coalesce("trusted", F.lit(False)).alias("trusted"), "open").mapInArrow(run, "doc_id long, trusted boolean, open boolean, x binary").toArrow()
    packed = got["x"].combine_chunks()
    x = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.float16).reshape(-1, N_FEATURES)
    order = np.lexsort((x[:, 0], got["doc_id"].to_numpy()))
    trusted, unlabelled = got["trusted"].to_numpy()[order], got["open"].to_numpy()[order]
    x = x[order].astype(np.float32)
    return fitted(x[trusted], x[unlabelled])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels of held-out rows are not learned."""
    model = learn(docs.where(~held_out), labels.where(~held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches):
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                score = model.scores(np.array([features(t, hasher) for t in part.column(2).to_pylist()]).reshape(-1, N_FEATURES))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
