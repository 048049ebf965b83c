"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Documents with equal shingle sets form a class; its smallest doc_id stands for it.
2. Signatures of classes are cut into bands; classes that share a band are candidates.
3. Each candidate of a band is paired with the band's smallest class. Pairs are compared
   signature batch by signature batch and dropped as soon as the posterior probability
   that their similarity reaches the threshold is below the miss probability. Survivors
   are confirmed on full shingle sets.
4. Bands whose classes are still in several components are gone through again, so that no
   link between components is left out: the classes outside a band's largest component are
   compared in the same way, in blocks, with those inside and with each other.

Defined cases: null or blank text has the empty set and links with nothing; fewer words
than a shingle make one shingle; each row is judged by its own text, also where a doc_id
repeats; a row with a null doc_id is passed on unlinked (component_id null, kept); extra
columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, mix, saved, shingle_hashes, slices, unused, WordHasher

FEATURES = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sig binary"


class Scheme:
    """Bands, rows per band and the posterior bounds of the batches.

    percent: similarity threshold in hundredths. miss: the posterior probability of
    reaching the threshold below which a pair is given up after a batch.
    """

    def __init__(self, percent: int = 85, words: int = 3, bands: int = 30, rows: int = 6, batch: int = 36, miss: float = 1e-7, seed: int = 11):
        self.percent, self.words, self.bands, self.rows, self.batch, self.miss = percent, words, bands, rows, batch, miss
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    @functools.cached_property
    def bounds(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest equal ones with which a pair goes on), by batch.

        With a flat prior, P(similarity >= t | m of n equal) is the probability of at
        most m successes in n + 1 trials at t.
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.bands * self.rows + 1, self.batch):
            p, m = 0.0, 0
            for m in range(n + 1):
                p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if p >= self.miss:
                    break
            out.append((n, m))
        return out

    def shingles(self, text: str | None, hasher: WordHasher) -> np.ndarray:
        """Sorted distinct shingle hashes of a whole text."""
        return np.unique(shingle_hashes(hasher(text), self.words))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), 0xFFFFFFFF, dtype=np.uint32)
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for at in range(0, len(h), 2048):
                m = (h[at : at + 2048][None, :] ^ self.xor[:, None]) * self.mul[:, None]
                m ^= m >> np.uint32(15)
                np.minimum(low, (m * np.uint32(0x2C1B3C6D)).min(axis=1), out=low)
        return low

    def band_keys(self, sigs: np.ndarray) -> np.ndarray:
        """64-bit keys, a row per signature and a column per band."""
        part = sigs.reshape(len(sigs), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64) + np.uint64(1), part.shape[:2])
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
        return key

    def survives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of signature rows pass every batch."""
        alive = np.arange(len(a))
        same = np.zeros(len(a), dtype=np.int32)
        done = 0
        for n, fewest in self.bounds:
            same[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1, dtype=np.int32)
            alive, done = alive[same[alive] >= fewest], n
            if not len(alive):
                break
        out = np.zeros(len(a), dtype=bool)
        out[alive] = True
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact test on sorted distinct sets."""
        if not len(a) or not len(b):
            return False
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the signature, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in slices(batches):
            n, fa, fb, sig = [], [], [], []
            for text in b.column(2).to_pylist():
                s = scheme.shingles(text, hasher)
                n.append(len(s))
                fa.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                fb.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
                sig.append(scheme.signature(s).tobytes() if len(s) else b"")
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sig"])

    return keyed(docs).mapInArrow(run, FEATURES)


def band_rows(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, id): a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1)
                keys = scheme.band_keys(sigs).view(np.int64)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), scheme.bands)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(ids, pa.int64())], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def bayes_filter(pairs: DataFrame, classes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of class ids that the sequential test lets through."""
    sigs = classes.select("id", "sig")
    both = pairs.join(sigs.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                a, c = (np.frombuffer(b"".join(part.column(k).to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1) for k in (2, 3))
                keep = pa.array(scheme.survives(a, c))
                yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. texts: (id, text), one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last, last_set = WordHasher(), None, None
        for part in slices(batches):
            a, b, ta, tb = (c.to_pylist() for c in part.columns)
            keep = []
            for k in range(len(a)):
                if a[k] != last:
                    last, last_set = a[k], scheme.shingles(ta[k], hasher)
                keep.append(scheme.linked(last_set, scheme.shingles(tb[k], hasher)))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def compare_block(groups: np.ndarray, parts: np.ndarray, sigs: np.ndarray, texts: list[str], scheme: Scheme, hasher: WordHasher) -> list[tuple[int, int]]:
    """Pairs of groups of a block of classes that a link joins, a spanning set of them.

    Where the block holds two parts, rows of one part do not meet. A row's signature is
    tested against all later rows; where some survive, an inverted index of the block
    gives its exact intersections.
    """
    n = len(groups)
    sets = [scheme.shingles(t, hasher) for t in texts]
    sizes = np.array([len(s) for s in sets])
    codes, starts = None, None
    names, own = np.unique(groups, return_inverse=True)
    parent = list(range(len(names)))
    apart = len(np.unique(parts)) > 1

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for i in range(n - 1):
        meets = own[i + 1 :] != own[i]
        meets &= 100 * np.minimum(sizes[i], sizes[i + 1 :]) >= scheme.percent * np.maximum(sizes[i], sizes[i + 1 :])
        if apart:
            meets &= parts[i + 1 :] != parts[i]
        later = i + 1 + np.flatnonzero(meets)
        if not len(later):
            continue
        later = later[scheme.survives(np.broadcast_to(sigs[i], (len(later), sigs.shape[1])), sigs[later])]
        if not len(later):
            continue
        if codes is None:
            flat = np.concatenate(sets)
            rows = np.repeat(np.arange(n), sizes)
            order = np.argsort(flat, kind="stable")
            flat, rows = flat[order], rows[order]
            codes, at = np.unique(flat, return_index=True)
            starts = np.append(at, len(flat))
        if len(later) <= 4:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in later])
        else:
            k = np.searchsorted(codes, sets[i])
            both = np.bincount(np.concatenate([rows[starts[x] : starts[x + 1]] for x in k]), minlength=n)[later]
        for j in later[100 * both >= scheme.percent * (sizes[i] + sizes[later] - both)]:
            a, b = root(own[i]), root(own[j])
            if a != b:
                parent[a] = b
                links.append((int(groups[i]), int(groups[j])))
    return links


def residual_links(members: DataFrame, classes: DataFrame, texts: DataFrame, scheme: Scheme, block: int = 2048) -> DataFrame:
    """Links (a, b) of components, by links of classes within bands.

    members: (key, id, component). Bands of one component, or with the same members as
    another, have nothing to add. A band of at most `block` classes is one task. Of others, the largest component
    and the rest are dealt into parts of about `block` classes; each part of the rest
    meets every part.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"))
    bands = sizes.groupBy("key").agg(F.count("*").alias("several"), F.sum("n").alias("all"), F.sum("print").alias("print"), F.max(F.struct("n", "component")).alias("top"))
    bands = bands.where("several > 1").groupBy("all", "print").agg(F.min(F.struct("key", "top")).alias("b")).select("all", "b.key", "b.top")
    cut = F.col("all") > block
    rest = F.when(cut, F.ceil((F.col("all") - F.col("top.n")) / block)).otherwise(1).cast("int")
    most = F.when(cut, F.ceil(F.col("top.n") / block)).otherwise(0).cast("int")
    bands = saved(bands.select("key", F.col("top.component").alias("top"), rest.alias("rest"), most.alias("most")), "bands")
    dealt = members.join(bands, "key")
    inside = (F.col("component") == F.col("top")) & (F.col("most") > 0)
    own = F.when(inside, F.col("rest") + F.pmod(F.xxhash64("id"), F.col("most"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    last = F.when(inside, F.col("rest") - 1).otherwise(F.col("rest") + F.col("most") - 1)
    dealt = dealt.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("key", "id", "component", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    full = dealt.join(classes.select("id", "sig"), "id").join(texts, "id")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint32).reshape(group.num_rows, -1)
        links = compare_block(group["component"].to_numpy(), group["part"].to_numpy(), sigs, group["text"].to_pylist(), scheme, WordHasher())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return full.groupBy("key", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for each row of docs (doc_id, text, ...).

    text_key is a hash of the text; with doc_id it names the row's document.
    """
    scheme = scheme or Scheme()
    rows = saved(signatures(docs, scheme), "signatures")
    classes = saved(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "sig")).alias("m"))
        .select(F.col("set_a").alias("id"), "set_b", "m.*"), "classes")
    bands = band_rows(classes, scheme)
    lead = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead")).where("n > 1").drop("n")
    members = saved(bands.join(lead, "key"), "bands")
    pairs = members.where("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    involved = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key")
    texts = saved(keyed(docs).join(involved, ["doc_id", "text_key"]).dropDuplicates(["id"]).select("id", "text"), "texts")
    links = saved(confirm(bayes_filter(pairs, classes, scheme), texts, scheme), "links")
    parts = connected_components(links)
    known = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    more = saved(residual_links(known, classes, texts, scheme), "links")
    known = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "set_b", "doc_id", F.coalesce("component", "id").alias("component"))
    if more.take(1):
        wider = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        known = known.join(wider, "component", "left").withColumn("component", F.coalesce("wider", "component")).drop("wider")
    first = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = known.join(first, "component").select(F.col("id").alias("set_a"), "set_b", "component_id")
    out = rows.select("doc_id", "n_shingles", "set_a", "set_b", "text_key").join(known, ["set_a", "set_b"], "left")
    linked = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", linked.alias("component_id"), "text_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """docs without near-duplicates: the kept rows, and of rows that repeat a document the first by a hash of their columns."""
    judged = saved(near_duplicates(docs, scheme).where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept"), "judged")
    of, key, place = unused(docs, "of", "key", "place")
    match = [F.col("doc_id").cast("long").eqNullSafe(F.col(of)), F.xxhash64("text") == F.col(key)]
    named = judged.select(F.col("doc_id").alias(of), F.col("text_key").alias(key), "kept")
    once = docs.join(named.drop("kept"), match, "left_anti")
    again = docs.join(named.where("kept").drop("kept"), match, "left_semi")
    first = Window.partitionBy(F.col("doc_id").cast("long"), F.xxhash64("text")).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
    return once.unionByName(again.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place))
