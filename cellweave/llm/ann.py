"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample and large clusters are split until the lists are
balanced. Every vector is written to the list of its nearest centroid and, near a border,
to those of further centroids whose distance is within a ratio of the nearest. A query
finds its closest centroids by best-first search in an in-memory neighbour graph, and
searches those lists whose centroid distance is within a ratio of the smallest. The first
lists give the score that a vector must reach to be in the answer; the others are searched
with that bound and hand on only what reaches it.

Equal vectors are one entry that keeps as many of its smallest ids as an answer can need,
so a large group of copies costs no more than one vector. A list with more entries than
`block` is searched in several tasks, each holding a part of it.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length is not the most frequent one; rows with a null id take no
part; repeated rows count once; ties go to the smaller id; with fewer than k candidates
all are returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """About n unit centroids of unit vectors; clusters over twice the mean size are split in two."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for k in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        full = np.flatnonzero(np.linalg.norm(total, axis=1) > 1e-12)
        centres = unit(total[full])
        if k < rounds - 2:
            for c in np.flatnonzero(size[full] > 2 * max(1.0, len(sample) / n)):
                members = sample[own == full[c]]
                centres = np.vstack([centres, members[rng.integers(len(members))][None, :]])
    return centres


class CentroidGraph:
    """Centroids with links to their nearest ones, for best-first search."""

    def __init__(self, centres: np.ndarray, degree: int = 24, beam: int = 48):
        self.centres, self.beam = centres, beam
        n, degree = len(centres), min(degree, len(centres) - 1)
        links: list = [set() for _ in range(n)]
        for at in range(0, n, 1024):
            near = np.argsort(-(centres[at : at + 1024] @ centres.T), axis=1, kind="stable")[:, 1 : degree + 1]
            for k, row in enumerate(near):
                for j in row.tolist():
                    links[at + k].add(j)
                    links[j].add(at + k)
        for k in range(n):
            links[k].update(((k + 1) % n, (k * 7 + 3) % n))
            links[k].discard(k)
        self.links = [sorted(x) for x in links]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, query: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Centroids within reach times the smallest distance to a unit vector, and their distances, nearest first.

        The search goes on while the front holds one of the `beam` nearest found or one within reach.
        """
        known: dict[int, float] = {}
        front: list[tuple[float, int]] = []
        best: list[float] = []
        least = np.inf

        def meet(ids: np.ndarray) -> None:
            nonlocal least
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * (self.centres[ids] @ query))).tolist()
            least = min(least, *apart) if len(apart) else least
            for d, c in zip(apart, ids.tolist()):
                known[c] = d
                if len(best) < self.beam or d < -best[0] or d <= reach * least:
                    heapq.heappush(front, (d, c))
                    heapq.heappush(best, -d)
                    if len(best) > self.beam:
                        heapq.heappop(best)

        meet(self.entries)
        while front:
            d, c = heapq.heappop(front)
            if len(best) >= self.beam and d > -best[0] and d > reach * least:
                break
            meet(np.array([j for j in self.links[c] if j not in known], dtype=np.int64))
        found = sorted((d, c) for c, d in known.items() if d <= reach * least + 1e-12)
        return np.array([c for _, c in found], dtype=np.int64), np.array([d for d, _ in found])


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the distinct rows that take part, components as they are."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (sizes.n if sizes else 0)).withColumnRenamed("embedding", "v")


def cosine(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each pair summed in the same order."""
    return (others * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((others * others).sum(axis=1)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, list_size: int = 256, sample_rows: int = 32_768, border: float = 1.08, replicas: int = 4, first_lists: int = 3, reach: float = 1.3, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where is_query holds.

    list_size: aimed entries of a list. sample_rows: bound of the fitting sample. border,
    replicas: distance ratio and number of lists of a border vector. reach: distance ratio
    of the lists that a query searches; first_lists: how many of them set its bound.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    kept = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = saved(kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v"), "entries")
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample_rows / total)
    sampled = entries.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v")
    sample = sampled.toArrow()["v"].combine_chunks()
    dim = len(entries.first().v)
    sample = unit(rows_of(sample, dim)) if len(sample) else unit(np.array([entries.first().v], dtype=np.float64))
    centres = fit_centroids(sample, max(1, min(-(-total // list_size), len(sample) // 8)))
    graph = CentroidGraph(centres)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * (unit(rows_of(b.column(2), dim)) @ centres.T)))
            near = np.argsort(apart, axis=1, kind="stable")[:, :replicas]
            far = np.take_along_axis(apart, near, axis=1)
            at, nth = np.nonzero(far <= border * far[:, :1] + 1e-12)
            yield pa.record_batch([pa.array(near[at, nth], pa.int64()), *(c.take(pa.array(at)) for c in b.columns)], names=["list", "id", "ids", "v"])

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lists, places = [], [], []
            for n, q in enumerate(unit(rows_of(b.column(1), dim))):
                found, _ = graph.search(q, reach)
                lists += found.tolist()
                at += [n] * len(found)
                places += range(len(found))
            yield pa.record_batch([pa.array(lists, pa.int64()), pa.array(places, pa.int32()), *(c.take(pa.array(at, pa.int64())) for c in b.columns)], names=["list", "place", "query", "v"])

    lists = saved(entries.mapInArrow(post, "list long, id long, ids array<long>, v array<float>"), "lists")
    parts = lists.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asked = saved(rows.where(is_query).select("vec_id", "v").distinct(), "asked")
    asking = asked.groupBy("v").agg(F.min("vec_id").alias("query")).select("query", "v")
    asking = asking.repartition(F.xxhash64("query")).mapInArrow(aim, "list long, place int, query long, v array<float>")
    asking = saved(asking, "asking").join(F.broadcast(parts) if len(centres) <= sample_rows else parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "place", "part", "query", "v")
    dealt = lists.join(F.broadcast(parts) if len(centres) <= sample_rows else parts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "ids", "v")
    found_schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids = right["ids"].to_pylist()
            vectors, queries = rows_of(right["v"].combine_chunks(), dim), rows_of(left["v"].combine_chunks(), dim)
            names, scaled, most = left["query"].to_numpy(), unit(vectors), min(len(ids), k + 1)
            least = left["least"].to_numpy()
            for at in range(0, len(queries), 1024):
                near = unit(queries[at : at + 1024]) @ scaled.T
                last = np.partition(near, len(ids) - most, axis=1)[:, len(ids) - most]
                for n in np.flatnonzero(near.max(axis=1) >= least[at : at + 1024] - 1e-9):
                    choice = np.flatnonzero(near[n] >= max(last[n], least[at + n]) - 1e-9)  # all that may tie with the last place
                    score = cosine(queries[at + n], vectors[choice])
                    flat = heapq.nsmallest(k + 1, ((-s, i) for s, c in zip(score.tolist(), choice.tolist()) for i in ids[c] if s >= least[at + n]))
                    out.append((np.full(len(flat), names[at + n]), np.array([i for _, i in flat], dtype=np.int64), np.array([-s for s, _ in flat], dtype=np.float64)))
        return pa.table([np.concatenate([o[c] for o in out]) if out else [] for c in range(3)], schema=found_schema)

    def search(asking: DataFrame) -> DataFrame:
        return asking.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(compare, "query long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)

    near = saved(best(search(asking.where(F.col("place") < first_lists).withColumn("least", F.lit(-2.0)))), "near")
    bound = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-2.0).alias("least"))
    far = search(asking.where(F.col("place") >= first_lists).join(bound, "query"))
    top = best(near.drop("n").unionByName(far)).drop("n")
    back = asked.join(asking_ids(asked), "v").select("vec_id", "query").withColumnRenamed("vec_id", "query_id")
    out = back.join(top, "query").where("vec_id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def asking_ids(asked: DataFrame) -> DataFrame:
    return asked.groupBy("v").agg(F.min("vec_id").alias("query"))
