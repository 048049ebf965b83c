"""Shared pieces: scratch tables in the shared folder, word hashing, graph components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = 0xFFFFFFFFFFFFFFFF
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/cellweave-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def saved(df: DataFrame, name: str, rows: int | None = None, file_rows: int = 100_000) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    rows: about how many narrow rows there are, if that is known; they are then written by
    as many tasks as have file_rows each, and not by one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(-(-rows // file_rows) or 1)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a saved table that nothing will read again."""
    if path := getattr(df, "_saved_path", None):
        drop_path(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does once the driver has collected their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def bucket_of(col: Column, n: int) -> Column:
    """crc32 of a key's decimal text, modulo n."""
    return F.crc32(col.cast("string")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(29).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHasher:
    """64-bit hashes of the words of a text, in order, without a loop over words.

    Words lie between ASCII white space, with A-Z in lower case. A word's hash is a
    polynomial of its bytes modulo 2^64, from prefix sums over the text, which are then
    shifted to the word's start by the inverse power, and finalised with its length.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers), 1 << 14)
            step = np.full(n, _BASE, dtype=np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def __call__(self, text: str | None, block: int = 1 << 20) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        cuts = np.unique(np.concatenate([np.searchsorted(starts, np.arange(0, len(raw), block)), [len(starts)]]))
        out = [np.empty(0, dtype=np.uint64)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            low, high = starts[i], ends[j - 1]
            self.grow(int(high - low))
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTES[raw[low:high]] * self.powers[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out.append(mix((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64)))
        return np.concatenate(out)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words in order; one for the whole if there are fewer; none for no words."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = mix(words[: len(words) - n + 1] + np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about most_bytes (one row at least)."""
    for b in batches:
        parts = max(1, -(-b.nbytes // most_bytes))
        step = max(1, -(-b.num_rows // parts))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches) of the edges u - v."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        for end in (a, b):
            np.minimum.at(low, end, least)
            np.minimum.at(low, before[end], least)
        low = low[low]  # pointers may jump, since a label is a node
        if (low == before).all():
            return nodes, nodes[low]


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(u, v): the edges of each of some tasks as stars around the smallest node reached there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            nodes, low = least_reached(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
            star = nodes != low
            for at in range(0, int(star.sum()), 1 << 16):
                yield pa.record_batch([pa.array(x[star][at : at + (1 << 16)]) for x in (nodes, low)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, task_edges: int = 1_000_000) -> DataFrame:
    """(node, component): for every node of links (saved) the smallest node that it reaches.

    Tasks of about task_edges edges turn them into stars; that is all if one task does.
    Else large-star and small-star steps follow in turns; each aggregates with map-side
    combining and re-joins on the node, so a hub's edges may be split over tasks. Stops
    when a round leaves the edges as they were.
    """
    edges, n = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")), links.count()
    before, old = None, []
    for _ in range(rounds):
        tasks = -(-n // task_edges) or 1
        edges = saved(contracted(edges, tasks), "star")
        if tasks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "star", n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = saved(small.where("u > v").distinct(), "star", n)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in old:
            release(done)
        old = [large, edges]
        if now == before:
            break
        before, n = now, now.n
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
