"""Aggregates over genes and cells that count implicit zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("sum", "mean", "var", "cv", "rv")


def ratio(a: Column, b: Column | float) -> Column:
    return F.try_divide(a, b if isinstance(b, Column) else F.lit(float(b)))


def gene_sums(x: DataFrame, by: str = "gene") -> DataFrame:
    """(gene, total, squares, n_cells, top) of the stored entries; one shuffle, combined map-side."""
    return x.groupBy(by).agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.count_if(F.col("value") > 0).alias("n_positive"), F.max("value").alias("top"), F.count("*").alias("n_stored"))


def gene_moments(x: DataFrame, var: DataFrame, n_cells: int) -> DataFrame:
    """(gene, total, mean, variance, n_positive): population moments over all cells, for every gene of var."""
    s = var.select("gene").join(gene_sums(x), "gene", "left").na.fill(0, ["total", "squares", "n_positive"])
    mean = F.col("total") / n_cells
    return s.select("gene", "total", mean.alias("mean"), F.greatest(F.col("squares") / n_cells - mean * mean, F.lit(0.0)).alias("variance"), "n_positive")


def summary(mode: str, n_cells: int | None = None) -> Column:
    """A gene's summary from its moments; what divides by zero is 0."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    return {
        "sum": F.col("total"), "mean": F.col("mean"), "var": F.col("variance"),
        "cv": F.coalesce(ratio(F.sqrt("variance"), F.col("mean")), F.lit(0.0)),
        "rv": F.coalesce(ratio(F.col("variance"), F.col("mean")), F.lit(0.0)),
    }[mode]


def gene_stats(x: DataFrame, var: DataFrame, n_cells: int, threshold: float = 0.0, pseudo: bool = False) -> DataFrame:
    """Per gene: mu, alpha, mean_all, cov_all, fano_all, max_all, std_all.

    mu averages the entries above the threshold; alpha is their share of cells; the others
    are over all cells, zeros included.
    """
    above = F.col("value") > threshold
    s = x.groupBy("gene").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.max("value").alias("top"), F.count("*").alias("stored"),
        F.avg(F.when(above, F.col("value"))).alias("mu"), F.count_if(above).alias("above"),
    )
    s = var.select("gene").join(s, "gene", "left").na.fill(0, ["total", "squares", "stored", "above"])
    mean = F.col("total") / n_cells
    variance = F.greatest(F.col("squares") / n_cells - mean * mean, F.lit(0.0))
    top = F.when(F.col("stored") < n_cells, F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("top"))
    extra = 1 if pseudo else 0
    return s.select(
        "gene", "mu", ((F.col("above") + extra) / (n_cells + extra)).alias("alpha"), mean.alias("mean_all"),
        ratio(F.sqrt(variance), mean).alias("cov_all"), ratio(variance, mean).alias("fano_all"), top.alias("max_all"), F.sqrt(variance).alias("std_all"),
    )


def padded_percentile(x: DataFrame, by: list[str], value: str, size: Column | int, share: float) -> DataFrame:
    """(by..., q): linear percentile of each group's values padded with zeros to `size` values.

    Works on ranks: of m stored values and size - m zeros, the k-th smallest is found without
    building the zeros. Values must not be negative. size is a literal or a column of x.
    """
    from pyspark.sql import Window

    size = F.lit(size) if isinstance(size, int) else size
    order = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    ranked = x.withColumn("_size", size).withColumn("_m", F.count("*").over(whole))
    ranked = ranked.withColumn("_at", F.col("_size") - F.col("_m") + F.row_number().over(order) - 1)
    low = F.floor((F.col("_size") - 1) * share)
    part = (F.col("_size") - 1) * share - low
    got = ranked.groupBy(*by).agg(F.sum(F.when(F.col("_at") == low, F.col(value) * (1 - part)).when(F.col("_at") == low + 1, F.col(value) * part)).alias("q"))
    return got.select(*by, F.coalesce("q", F.lit(0.0)).alias("q"))


def label_counts(obs: DataFrame, label: str) -> DataFrame:
    return obs.groupBy(label).agg(F.count("*").alias("n"))


def library_size(x: DataFrame) -> DataFrame:
    """Mean and population variance of the log totals of cells; one row."""
    total = x.groupBy("cell").agg(F.log(F.sum("value")).alias("size"))
    return total.agg(F.avg("size").alias("mean"), F.var_pop("size").alias("variance"))


def profile(x: DataFrame, obs: DataFrame, label: str, method: str = "mean") -> DataFrame:
    """(label, gene, value): mean or median of a gene over the cells of a type, zeros counted."""
    sizes = obs.groupBy(label).agg(F.count("*").alias("n"))
    typed = x.join(obs.select("cell", label), "cell")
    if method == "mean":
        sums = typed.groupBy(label, "gene").agg(F.sum("value").alias("s"))
        return sums.join(sizes, label).select(label, "gene", (F.col("s") / F.col("n")).alias("value"))
    if method == "median":
        return padded_percentile(typed.join(sizes, label), [label, "gene"], "value", F.col("n"), 0.5).withColumnRenamed("q", "value")
    raise ValueError(f"unknown method {method!r}")


def detection(x: DataFrame, obs: DataFrame, label: str, threshold: float = 0.0) -> DataFrame:
    """(label, gene, value): share of a type's cells in which a gene is above the threshold."""
    sizes = obs.groupBy(label).agg(F.count("*").alias("n"))
    hits = x.where(F.col("value") > threshold).join(obs.select("cell", label), "cell").groupBy(label, "gene").agg(F.count("*").alias("hits"))
    return hits.join(sizes, label).select(label, "gene", (F.col("hits") / F.col("n")).alias("value"))


def cell_features(x: DataFrame, obs: DataFrame, n_genes: int, batch: str) -> DataFrame:
    """Nine per-cell statistics averaged over each batch, a row per cell."""
    v = F.col("value")
    s = x.where(v != 0).groupBy("cell").agg(
        F.sum("value").alias("s"), F.sum(v * v).alias("ss"), F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.5).alias("q2"), F.percentile("value", 0.75).alias("q3"),
        F.max("value").alias("high"), F.count("*").alias("n"), F.avg("value").alias("nz_mean"), F.stddev_pop("value").alias("nz_std"),
    )
    mean = F.col("s") / n_genes
    own = obs.select("cell", batch).join(s, "cell").select("cell", batch, mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / n_genes - mean * mean, F.lit(0.0))).alias("std"), "q1", "q2", "q3", "high", (F.col("n") / 1000).alias("detected"), "nz_mean", "nz_std")
    names = ["mean", "std", "q1", "q2", "q3", "high", "detected", "nz_mean", "nz_std"]
    means = own.groupBy(batch).agg(*(F.avg(n).alias(n) for n in names))
    return obs.select("cell", batch).join(means, batch).select("cell", *names)


def majority_vote(cells: DataFrame, group: str, label: str, least: float = 0.0) -> DataFrame:
    """(group, label): the most frequent label of each group; `Heterogeneous` below the least share."""
    from .ordering import top_k_by

    counts = cells.groupBy(group, label).agg(F.count("*").alias("n"))
    total = cells.groupBy(group).agg(F.count("*").alias("all"))
    top = top_k_by(counts, 1, [group], F.desc("n"), label).join(total, group)
    return top.select(group, F.when(F.col("n") / F.col("all") >= least, F.col(label)).otherwise("Heterogeneous").alias(label))


def label_frequency(obs: DataFrame, label: str) -> DataFrame:
    """(label, n) in falling order of n, ties by label."""
    return obs.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)
