"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most `capacity` words; full pieces fill a bin each.
The rest are placed largest first: bins are kept in order of free space and carry a
bitmap of their sources and of their duplicate clusters; from the first bin that is large
enough the search goes to its successors until one shares neither, and opens a new bin if
none does. So a bin holds one piece of a source and one of a duplicate cluster at most.

Rows are dealt by hash over shards of about `shard_rows` rows, which are packed one by
one; a hot source or cluster is dealt over all of them, and so are rows that repeat: they
are counted first and then dealt by their number. What is shuffled is a document's id,
size, source and cluster, not its text.

Defined cases: null and blank texts are pieces of 0 words; a null source conflicts with
nothing; null texts are of one cluster; repeated rows are of one cluster, so they go to
different bins; equal sizes are taken in order of doc_id; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, piece long, start_word long, n_words long, bin_id string, bin_words long"


def best_fit(items: list[tuple], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, piece, start, size, bin) for items (size, source, cluster), in order of placing.

    Bins are numbered as they are opened.
    """
    bins = 0
    rest = []
    for k, (size, _, _) in enumerate(items):
        full = size // capacity
        for piece in range(full):
            yield k, piece, piece * capacity, capacity, bins
            bins += 1
        if size % capacity or not size:
            rest.append((k, full, size % capacity))
    rest.sort(key=lambda r: -r[2])
    codes: dict = {}
    common = Counter(items[k][2] for k, _, _ in rest)
    free: list[tuple[int, int]] = []
    sources: dict[int, int] = {}
    clusters: dict[int, int] = {}
    for k, piece, size in rest:
        _, source, cluster = items[k]
        s = 0 if source is None else 1 << codes.setdefault(("source", source), len(codes))
        c = 0 if common[cluster] < 2 else 1 << codes.setdefault(("cluster", cluster), len(codes))
        at = bisect_left(free, (size, -1))
        while at < len(free) and (sources[free[at][1]] & s or clusters[free[at][1]] & c):
            at += 1
        if at < len(free):
            left, b = free.pop(at)
        else:
            left, b = capacity, bins
            sources[b] = clusters[b] = 0
            bins += 1
        sources[b] |= s
        clusters[b] |= c
        insort(free, (left - size, b))
        yield k, piece, piece * capacity, size, b


def packed(docs: DataFrame, capacity: int = 2048, shard_rows: int = 8192, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start_word, n_words, bin_id, bin_words: where each piece of docs goes.

    cluster names a row's duplicate cluster; without it, texts that are equal in lower
    case are one cluster.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"),
        (F.xxhash64(F.lower("text")) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    step = 1 << 16
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    dealt = counted.withColumn("far", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))))
    dealt = dealt.withColumn("near", F.explode(F.sequence(F.lit(0), F.least(F.lit(step), F.col("n") - F.col("far") * step) - 1)))
    dealt = dealt.select(*rows.columns, F.pmod(F.xxhash64("doc_id", "cluster", "far", "near"), F.lit(shards)).alias("shard"))

    def run(part: pa.Table) -> pa.Table:
        rows = sorted(zip(*(part[c].to_pylist() for c in ("doc_id", "size", "source", "cluster"))), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3]))
        shard = part["shard"][0].as_py()
        placed = list(best_fit([r[1:] for r in rows], capacity))
        filled = Counter()
        for _, _, _, size, b in placed:
            filled[b] += size
        return pa.table({
            "doc_id": pa.array([rows[p[0]][0] for p in placed], pa.int64()), "piece": pa.array([p[1] for p in placed], pa.int64()), "start_word": pa.array([p[2] for p in placed], pa.int64()),
            "n_words": pa.array([p[3] for p in placed], pa.int64()), "bin_id": pa.array([f"{shard}-{p[4]}" for p in placed], pa.string()), "bin_words": pa.array([filled[p[4]] for p in placed], pa.int64()),
        })

    return dealt.groupBy("shard").applyInArrow(run, PIECES)
