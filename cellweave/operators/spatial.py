"""Spatial weights, pruned graphs, gene-set graphs and matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import correlated, row_normalized
from .stats import ratio


def density(x: DataFrame, obs: DataFrame, mode: str = "uniform") -> DataFrame:
    """(cell, density): equal shares, or shares of the total count."""
    if mode == "uniform":
        n = obs.count()
        return obs.select("cell", F.lit(1.0 / max(n, 1)).alias("density"))
    if mode != "rna_count":
        raise ValueError(f"unknown mode {mode!r}")
    own = obs.select("cell").join(x.groupBy("cell").agg(F.sum("value").alias("t")), "cell", "left").na.fill(0)
    return own.join(F.broadcast(own.agg(F.sum("t").alias("all")))).select("cell", ratio(F.col("t"), F.col("all")).alias("density"))


def pruned(edges: DataFrame) -> DataFrame:
    """kNN edges not longer than the mean plus deviation of their source's; weight 1 / distance."""
    own = Window.partitionBy("src")
    kept = edges.withColumn("m", F.avg("distance").over(own) + F.stddev_pop("distance").over(own)).where(F.col("distance") <= F.col("m"))
    return kept.select("src", "dst", (1 / (F.col("distance") + 1e-16)).alias("weight"))


def threshold_edges(edges: DataFrame, least: float) -> DataFrame:
    """Edges longer than a threshold."""
    return edges.where(F.col("distance") > least)


def gene_set_graph(x: DataFrame, sets: DataFrame, n_cells: int, threshold: float, weight: str = "pearson") -> DataFrame:
    """(src, dst, weight): correlated gene pairs that share a set (pathway, gene)."""
    a, b = sets.withColumnRenamed("gene", "src"), sets.withColumnRenamed("gene", "dst")
    pairs = a.join(b, "pathway").where("src < dst").select("src", "dst").distinct()
    found = correlated(x, n_cells, threshold, pairs)
    return found if weight == "pearson" else found.withColumn("weight", F.lit(1.0))


def row_mass(edges: DataFrame, n_cells: int, length: float) -> DataFrame:
    """One row: mean over cells of the sum of exp(-d^2 / 2 l^2) over their edges, the cell itself left out."""
    return edges.where("src <> dst").agg((F.sum(F.exp(-(F.col("distance") ** 2) / (2 * length * length))) / n_cells).alias("p"))


def length_scale(edges: DataFrame, n_cells: int, target: float, low: float = 1e-3, high: float = 1e3, tolerance: float = 1e-3, rounds: int = 60) -> float:
    """The length at which the row mass is the target, by bisection.

    One aggregate gives the number of edges by squared distance, 256 bins to a doubling,
    and in each bin the first three moments about its middle. The mass at a length is the
    series of exp around the middles, within 1e-12 of the sum over edges for each of them.
    """
    square = F.col("distance") * F.col("distance")
    rows = edges.where("src <> dst").select(square.alias("q"), F.floor(F.log2(square) * 256).alias("bin"))
    t = F.col("q") / F.pow(F.lit(2.0), (F.col("bin") + 0.5) / 256) - 1
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(t).alias("s1"), F.sum(t * t).alias("s2"), F.sum(t * t * t).alias("s3")).collect()
    same = sum(r.n for r in sums if r.bin is None)  # log2(0) is null
    parts = sorted(r for r in map(tuple, sums) if r[0] is not None)
    bins, n, s1, s2, s3 = np.array(parts, dtype=np.float64).reshape(-1, 5).T
    middles = np.exp2((bins + 0.5) / 256)
    for _ in range(rounds):
        middle = (low + high) / 2
        x = middles / (2 * middle * middle)
        p = (same + float((np.exp(-x) * (n - x * s1 + x * x * s2 / 2 - x**3 * s3 / 6)).sum())) / n_cells
        if abs(p - target) <= tolerance:
            break
        low, high = (middle, high) if p < target else (low, middle)
    return middle


def neighbour_clusters(edges: DataFrame, labels: DataFrame, target: object, share: float = 0.5) -> DataFrame:
    """(label, links): clusters with more links from the target cluster than a share of its size."""
    inside = labels.where(F.col("label") == target).select(F.col("cell").alias("src"))
    n = inside.count()
    near = edges.join(inside, "src", "left_semi").join(labels.select(F.col("cell").alias("dst"), "label"), "dst")
    return near.where(F.col("label") != target).groupBy("label").agg(F.count("*").alias("links")).where(F.col("links") > share * n)


def augmented(x: DataFrame, edges: DataFrame, weight: float = 0.2) -> DataFrame:
    """Values plus a weight times the weighted mean of the neighbours' values."""
    far = row_normalized(edges).join(x.select(F.col("cell").alias("dst"), "gene", "value"), "dst").select(F.col("src").alias("cell"), "gene", (F.col("value") * F.col("weight") * weight).alias("value"))
    return x.unionByName(far).groupBy("cell", "gene").agg(F.sum("value").alias("value"))


def batch_adjusted(x: DataFrame, obs: DataFrame, batch: str) -> DataFrame:
    """Stored values shifted and scaled so that each gene has its overall mean and deviation in every batch."""
    rows = x.join(obs.select("cell", batch), "cell")
    own = rows.groupBy(batch, "gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    whole = x.groupBy("gene").agg(F.avg("value").alias("am"), F.stddev_pop("value").alias("as"))
    z = F.coalesce(ratio(F.col("value") - F.col("m"), F.col("s")), F.lit(0.0))
    return rows.join(own, [batch, "gene"]).join(whole, "gene").select("cell", "gene", (z * F.col("as") + F.col("am")).alias("value"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost matching (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[of[j0] - 1, free - 1] - u[of[j0]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j0
            j1 = int(free[np.argmin(least[free])])
            d = least[j1]
            u[of[used]] += d
            v[used] -= d
            least[free] -= d
            j0 = j1
            if of[j0] == 0:
                break
        while j0:
            of[j0] = of[way[j0]]
            j0 = way[j0]
    out = np.empty(n, dtype=int)
    out[of[of > 0] - 1] = np.flatnonzero(of > 0) - 1
    return out


def matched(scores: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, a, b): for each batch the one-to-one matching of greatest softmax score.

    scores: (batch, a, b, score), complete within a batch; batches are matched apart.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid = part.pivot_table(index="a", columns="b", values="score", aggfunc="max")
        m = grid.fillna(grid.min().min() - 1).to_numpy()
        m = np.exp(m - m.max(1, keepdims=True))
        m = m / m.sum(1, keepdims=True)
        turned = m.shape[0] > m.shape[1]
        to = assignment(-(m.T if turned else m))
        a, b = (grid.index[to], grid.columns) if turned else (grid.index, grid.columns[to])
        return pd.DataFrame({batch: part[batch].iloc[0], "a": a.to_numpy(), "b": b.to_numpy()})

    return scores.groupBy(batch).applyInPandas(run, f"`{batch}` long, a long, b long")


def random_pairs(labels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(a, b, same): n random pairs of cells with whether their labels agree (must-link or cannot-link)."""
    from .ordering import with_position
    from .sampling import uniform

    size = labels.count()
    rows = labels.sparkSession.range(n).select("id", F.floor(uniform(seed, "id") * size).alias("p"), F.floor(uniform(seed + 1, "id") * size).alias("q"))
    at = with_position(labels, "cell")
    left, right = (at.select(F.col("position").alias(p), F.col("cell").alias(c), F.col("label").alias(f"{c}_label")) for p, c in (("p", "a"), ("q", "b")))
    return rows.where("p <> q").join(left, "p").join(right, "q").select("a", "b", (F.col("a_label") == F.col("b_label")).alias("same"))


def pseudo_spots(x: DataFrame, obs: DataFrame, label: str, n: int = 1000, low: int = 8, high: int = 12, most_types: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((cell, gene, value), (cell, label, share)): sums of cells drawn with repeats from a few types.

    A spot has low..high cells and 1..most_types types, types without repeats; each cell
    is of one of them. All draws are by hash of the spot and the draw.
    """
    from .sampling import uniform

    types = obs.groupBy(label).agg(F.count("*").alias("size"))
    every = types.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("type"), "size"))).alias("types"))
    spots = obs.sparkSession.range(n).select((-1 - F.col("id")).alias("spot")).join(F.broadcast(every))
    spots = spots.withColumn("k", low + F.floor(uniform(seed, "spot") * (high - low + 1))).withColumn("t", 1 + F.floor(uniform(seed + 1, "spot") * F.least(F.lit(most_types), F.size("types"))))
    shuffled = F.array_sort(F.transform("types", lambda v: F.struct(F.xxhash64(F.lit(seed + 2), F.col("spot"), v["type"]).alias("h"), v["type"].alias("type"), v["size"].alias("size"))))
    chosen = spots.select("spot", "k", F.slice(shuffled, F.lit(1), F.col("t").cast("int")).alias("chosen"))
    draws = chosen.select("spot", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("draw"), "chosen")
    which = F.element_at("chosen", (1 + F.floor(uniform(seed + 3, "spot", "draw") * F.size("chosen"))).cast("int"))
    draws = draws.select("spot", "draw", which.alias("w")).select("spot", F.col("w.type").alias(label), (1 + F.floor(uniform(seed + 4, "spot", "draw") * F.col("w.size"))).alias("place"))
    placed = obs.select("cell", label).withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy("cell")))
    picked = draws.join(placed, [label, "place"]).groupBy("spot", "cell", label).agg(F.count("*").alias("times"))
    sums = x.join(picked, "cell").groupBy(F.col("spot").alias("cell"), "gene").agg(F.sum(F.col("value") * F.col("times")).alias("value"))
    share = picked.groupBy("spot", label).agg(F.sum("times").alias("c"))
    share = share.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("spot")))
    return sums, share.select(F.col("spot").alias("cell"), label, "share")
