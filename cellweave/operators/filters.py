"""Filters on genes and cells: thresholds, percentiles, top-k, markers, variability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import average_rank, top_k, top_k_by
from .stats import gene_moments, ratio, summary


def as_count(value: float | int | None, total: int) -> int | None:
    """A count from a count or a ratio of a total."""
    if value is None:
        return None
    if isinstance(value, float):
        if value > 1:
            raise ValueError(f"a ratio is at most 1, not {value}")
        return int(value * total)
    if value > total:
        raise ValueError(f"{value} is more than the total {total}")
    return value


def totals(x: DataFrame, axis: str, names: DataFrame) -> DataFrame:
    """(axis, n_counts, n_entries) for each key of names, zero where nothing is stored."""
    s = x.groupBy(axis).agg(F.sum("value").alias("n_counts"), F.count_if(F.col("value") > 0).alias("n_entries"))
    return names.select(axis).join(s, axis, "left").na.fill(0, ["n_counts", "n_entries"])


def by_thresholds(x: DataFrame, axis: str, names: DataFrame, min_counts: float | None = None, max_counts: float | None = None, min_entries: int | float | None = None, max_entries: int | float | None = None, n_other: int | None = None) -> DataFrame:
    """Keys whose totals lie within inclusive bounds.

    min_counts or max_counts between 0 and 1 is a percentile of the totals; a fractional
    minimum then is the only count bound, else a fractional maximum is. Ratios of entries
    are of n_other.
    """
    s = totals(x, axis, names)
    if n_other is not None:
        min_entries, max_entries = as_count(min_entries, n_other), as_count(max_entries, n_other)
    fraction = lambda v: v is not None and 0 < v < 1
    if fraction(min_counts) or fraction(max_counts):
        low = fraction(min_counts)
        share = min_counts if low else max_counts
        bound = F.broadcast(s.agg(F.percentile("n_counts", share).alias("bound")))
        s = s.join(bound).where(F.col("n_counts") >= F.col("bound") if low else F.col("n_counts") <= F.col("bound")).drop("bound")
        min_counts = max_counts = None
    for column, low, high in (("n_counts", min_counts, max_counts), ("n_entries", min_entries, max_entries)):
        if low is not None:
            s = s.where(F.col(column) >= low)
        if high is not None:
            s = s.where(F.col(column) <= high)
    return s


def in_order(x: DataFrame, axis: str, names: DataFrame, order: Sequence[str], **bounds: float | None) -> DataFrame:
    """Criteria applied one after another; totals of kept keys do not change, so one aggregate serves all."""
    known = ("min_counts", "max_counts", "min_entries", "max_entries")
    s = totals(x, axis, names)
    for name in order:
        if name not in known:
            raise KeyError(f"unknown criterion {name!r}")
        if (v := bounds.get(name)) is not None:
            column = F.col("n_counts" if name.endswith("counts") else "n_entries")
            s = s.where(column >= v if name.startswith("min") else column <= v)
    return s


def common_by_group(x: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Genes with a nonzero absolute total in every group (relational division)."""
    n = groups.select(group).distinct().count()
    live = x.join(groups.select("cell", group), "cell").groupBy("gene", group).agg(F.sum(F.abs("value")).alias("s")).where("s > 0")
    return live.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") == n).select("gene")


def by_name(var: DataFrame, prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), case_sensitive: bool = False, name: str = "gene_name") -> DataFrame:
    """Genes without the given prefixes and suffixes."""
    fold = (lambda c: c) if case_sensitive else F.upper
    text = fold(F.col(name))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | text.startswith(fold(F.lit(p)))
    for s in suffixes:
        hit = hit | text.endswith(fold(F.lit(s)))
    return var.where(~F.coalesce(hit, F.lit(False)))


def gene_summary(x: DataFrame, var: DataFrame, n_cells: int, mode: str) -> DataFrame:
    return gene_moments(x, var, n_cells).select("gene", summary(mode).alias("score"))


def by_percentile(x: DataFrame, var: DataFrame, n_cells: int, low: float = 1, high: float = 99, mode: str = "sum") -> DataFrame:
    """Genes whose summary lies between two percentiles."""
    s = gene_summary(x, var, n_cells, mode)
    bounds = s.agg(F.percentile("score", low / 100).alias("low"), F.percentile("score", high / 100).alias("high"))
    return s.join(F.broadcast(bounds)).where("score between low and high").select("gene", "score")


def by_top_k(x: DataFrame, var: DataFrame, n_cells: int, k: int = 1000, top: bool = True, mode: str = "cv") -> DataFrame:
    """The k genes with the greatest (or smallest) summary; ties go to the smaller gene."""
    s = gene_summary(x, var, n_cells, mode)
    return top_k(s, k, F.desc("score") if top else F.asc("score"), "gene")


def markers(profile: DataFrame, label: str, threshold: float = 1.25, eps: float = 1e-6) -> DataFrame:
    """(label, gene, log_fold): genes above the mean of the other types by a log fold change.

    profile: (label, gene, value), types that lack a gene have 0.
    """
    n = profile.select(label).distinct().count()
    if n < 2:
        raise ValueError("markers need two types at least")
    others = (F.sum("value").over(Window.partitionBy("gene")) - F.col("value")) / (n - 1)
    fold = F.log(F.col("value") + eps) - F.log(others + eps)
    return profile.select(label, "gene", fold.alias("log_fold")).where(F.col("log_fold") > threshold)


def gini_of_two(a: Column, b: Column) -> Column:
    """Gini index of two values: their distance over twice their sum."""
    return F.coalesce(ratio(F.abs(a - b), 2 * (F.abs(a) + F.abs(b))), F.lit(0.0))


def gini_markers(expression: DataFrame, detected: DataFrame, sizes: DataFrame, label: str, least_expression: float = 0.2, least_detection: float = 0.2, rank: int = 5, genes: DataFrame | None = None) -> DataFrame:
    """(label, gene, score, rank): one type against the size-weighted mean of the rest.

    The score is the product of the Gini indices of mean and detection, each times 1 where
    the type is above the rest and 0.1 where not. Kept are the `rank` best of a type and
    those above both thresholds. genes: all genes, if some may have no stored value.
    """
    sizes = sizes.withColumn("all", F.sum("n").over(Window.partitionBy()))
    grid = F.broadcast(sizes).crossJoin((expression if genes is None else genes).select("gene").distinct())
    whole = Window.partitionBy("gene")
    e, d = (df.select(label, "gene", F.col("value").alias(name)) for df, name in ((expression, "e"), (detected, "d")))
    both = grid.join(e, [label, "gene"], "left").join(d, [label, "gene"], "left").na.fill(0.0, ["e", "d"])
    score = F.lit(1.0)
    for name in ("e", "d"):
        own, n = F.col(name), F.col("n")
        both = both.withColumn(f"{name}_rest", (F.sum(own * n).over(whole) - own * n) / (F.col("all") - n))
        score = score * gini_of_two(own, F.col(f"{name}_rest")) * F.when(own > F.col(f"{name}_rest"), 1.0).otherwise(0.1)
    best = Window.partitionBy(label).orderBy(F.desc("score"), "gene")
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(best))
    kept = (F.col("rank") <= rank) | (F.col("e") > least_expression) & (F.col("d") > least_detection)
    return ranked.where(kept).select(label, "gene", "score", "rank")


def regression_scores(x: DataFrame, var: DataFrame, n_cells: int, method: str) -> DataFrame:
    """(gene, score): residual of a gene from the trend of all genes.

    enclasc: log mean on dropout; seurat3: log variance on a quadratic of log mean;
    scmap: log dropout on log mean. Genes outside the method's range get no score.
    """
    m = gene_moments(x, var, n_cells).withColumn("dropout", 1 - F.col("n_positive") / n_cells)
    if method == "scmap":
        m = m.where("dropout > 0 and dropout < 1").select("gene", (F.log(F.col("mean") + 1) / math.log(2)).alias("a"), (F.log(100 * F.col("dropout")) / math.log(2)).alias("b"))
        fit = m.agg(F.regr_slope("b", "a").alias("s"), F.regr_intercept("b", "a").alias("i"))
        return m.join(F.broadcast(fit)).select("gene", (F.col("b") - F.col("s") * F.col("a") - F.col("i")).alias("score"))
    if method == "enclasc":
        m = m.where("dropout > 0 and dropout < 1").select("gene", F.col("dropout").alias("a"), F.log(F.col("mean") + 1).alias("b"))
        fit = m.agg(F.regr_slope("b", "a").alias("s"), F.regr_intercept("b", "a").alias("i"), F.avg("b").alias("m"))
        return m.join(F.broadcast(fit)).select("gene", (2 * F.col("b") - F.col("s") * F.col("a") - F.col("i") - F.col("m")).alias("score"))
    if method == "seurat3":
        m = m.select("gene", F.log(F.col("mean") + 1).alias("a"), F.log(F.col("variance") + 1).alias("b"))
        powers = m.agg(*(F.avg(F.col("a") ** p).alias(f"p{p}") for p in range(1, 5)), *(F.avg(F.col("b") * F.col("a") ** p).alias(f"q{p}") for p in range(3))).first()
        import numpy as np

        grid = np.array([[1, powers.p1, powers.p2], [powers.p1, powers.p2, powers.p3], [powers.p2, powers.p3, powers.p4]])
        c = np.linalg.lstsq(grid, np.array([powers.q0, powers.q1, powers.q2]), rcond=None)[0]
        return m.select("gene", (F.col("b") - float(c[0]) - float(c[1]) * F.col("a") - float(c[2]) * F.col("a") ** 2).alias("score"))
    raise ValueError(f"unknown method {method!r}")


def dispersion(x: DataFrame, var: DataFrame, n_cells: int, n_bins: int = 20, flavor: str = "seurat") -> DataFrame:
    """(gene, mean, dispersion, normalized): z-scores of dispersions within bins of the mean.

    x holds logarithms. seurat: logs of both, equal-width bins, mean and deviation;
    cell_ranger: percentile bins, median and absolute deviation.
    """
    natural = x.withColumn("value", F.expm1("value")) if flavor == "seurat" else x
    m = gene_moments(natural, var, n_cells).withColumn("variance", F.col("variance") * n_cells / (n_cells - 1))
    m = m.select("gene", F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean")).alias("mean"), "variance")
    m = m.withColumn("dispersion", F.col("variance") / F.col("mean"))
    if flavor == "seurat":
        m = m.withColumn("dispersion", F.when(F.col("dispersion") > 0, F.log("dispersion"))).withColumn("mean", F.log1p("mean"))
        bounds = m.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
        m = m.join(F.broadcast(bounds)).withColumn("bin", F.least(F.floor(F.coalesce(ratio((F.col("mean") - F.col("low")) * n_bins, F.col("high") - F.col("low")), F.lit(0.0))), F.lit(n_bins - 1))).drop("low", "high")
        s = m.groupBy("bin").agg(F.avg("dispersion").alias("centre"), F.stddev_samp("dispersion").alias("spread"))
        s = s.select("bin", F.when(F.col("spread").isNull() | (F.col("spread") == 0), 0.0).otherwise(F.col("centre")).alias("centre"), F.when(F.col("spread").isNull() | (F.col("spread") == 0), F.col("centre")).otherwise(F.col("spread")).alias("spread"))
    elif flavor == "cell_ranger":
        cuts = [k / n_bins for k in range(1, n_bins)]
        bounds = m.agg(F.percentile("mean", cuts).alias("cuts"))
        m = m.join(F.broadcast(bounds)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("mean")))).drop("cuts")
        mid = m.groupBy("bin").agg(F.median("dispersion").alias("centre"))
        away = m.join(F.broadcast(mid), "bin").groupBy("bin", "centre").agg(F.median(F.abs(F.col("dispersion") - F.col("centre"))).alias("spread"))
        s = away.select("bin", "centre", F.nullif("spread", F.lit(0.0)).alias("spread"))
    else:
        raise ValueError(f"unknown flavor {flavor!r}")
    return m.join(F.broadcast(s), "bin").select("gene", "mean", "dispersion", ratio(F.col("dispersion") - F.col("centre"), F.col("spread")).alias("normalized"))


def variable_by_cutoffs(d: DataFrame, min_disp: float = 0.5, max_disp: float = float("inf"), min_mean: float = 0.0125, max_mean: float = 3) -> DataFrame:
    n = F.coalesce("normalized", F.lit(0.0))
    return d.where((F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (n > min_disp) & (n < max_disp))


def small_types(obs: DataFrame, label: str, threshold: int = 10) -> DataFrame:
    """Cells of types with more than `threshold` cells."""
    sizes = obs.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") > threshold).drop("_n")
    return obs.join(sizes, label, "left_semi")


def away_from_median(df: DataFrame, column: str, k: float, key: str = "cell") -> DataFrame:
    """(key, outlier): whether a value is more than k median absolute deviations from the median."""
    mid = df.agg(F.median(column).alias("mid"))
    own = df.join(F.broadcast(mid)).select(key, F.abs(F.col(column) - F.col("mid")).alias("away"))
    spread = own.agg(F.median("away").alias("spread"))
    return own.join(F.broadcast(spread)).select(key, (F.col("away") > k * F.col("spread")).alias("outlier"))


# Gene families of the quality control, by name.
FAMILIES = {"mito": "^(MT-|Mt-|mt-)", "ribo": "^(RPS|RPL|Rps|Rpl)", "hb": "^H[Bb][^(Pp)]"}


def cell_quality(x: DataFrame, obs: DataFrame, var: DataFrame, name: str = "gene_name", families: dict[str, str] | None = None, top: int = 20) -> DataFrame:
    """Per cell: totals, genes, their logs, share of the top genes and of gene families."""
    families = families or FAMILIES
    named = x.join(var.select("gene", *(F.col(name).rlike(p).alias(f) for f, p in families.items())), "gene")
    best = top_k_by(x, top, ["cell"], F.desc("value"), "gene").groupBy("cell").agg(F.sum("value").alias("top"))
    s = named.groupBy("cell").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("genes"), *(F.sum(F.when(F.col(f), F.col("value")).otherwise(0.0)).alias(f) for f in families))
    s = obs.select("cell").join(s, "cell", "left").join(best, "cell", "left").na.fill(0)
    share = lambda c: F.coalesce(ratio(100 * F.col(c), F.col("total")), F.lit(0.0)).alias(f"pct_{c}")
    return s.select("cell", "total", "genes", F.log1p("total").alias("log_total"), F.log1p("genes").alias("log_genes"), share("top"), *(share(f) for f in families))


def good_cells(quality: DataFrame, k: float = 5, mito_k: float = 3, mito_most: float = 8) -> DataFrame:
    """Cells that are outliers in no quality measure."""
    bad = None
    for column, times in (("log_total", k), ("log_genes", k), ("pct_top", k), ("pct_mito", mito_k)):
        hit = away_from_median(quality, column, times).where("outlier").select("cell")
        bad = hit if bad is None else bad.unionByName(hit)
    bad = bad.unionByName(quality.where(F.col("pct_mito") > mito_most).select("cell"))
    return quality.join(bad.distinct(), "cell", "left_anti")


def rank_sums(x: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(label, gene, rank_sum, z): Wilcoxon rank sums of each type against the rest.

    The implicit zeros of a gene are one block of ties below its stored (positive) values.
    """
    n = obs.count()
    sizes = obs.groupBy(label).agg(F.count("*").alias("size"))
    stored = x.where("value > 0").join(obs.select("cell", label), "cell")
    gene = stored.groupBy("gene").agg(F.count("*").alias("m"))
    ranked = stored.withColumn("rank", average_rank("value", "gene")).join(gene, "gene").withColumn("rank", F.col("rank") + (n - F.col("m")))
    ties = ranked.groupBy("gene", "value", "m").agg(F.count("*").alias("t")).groupBy("gene", "m").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("t"))
    ties = ties.select("gene", (F.col("t") + (n - F.col("m")) ** 3 - (n - F.col("m"))).alias("ties"), "m")
    own = ranked.groupBy(label, "gene").agg(F.sum("rank").alias("s"), F.count("*").alias("k"))
    full = own.join(F.broadcast(sizes), label).join(ties, "gene")
    rank_sum = F.col("s") + (F.col("size") - F.col("k")) * (n - F.col("m") + 1) / 2
    mean = F.col("size") * (n + 1) / 2
    spread = F.sqrt(F.col("size") * (n - F.col("size")) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return full.select(label, "gene", rank_sum.alias("rank_sum"), ratio(rank_sum - mean, spread).alias("z"))


def top_covarying(x: DataFrame, n_cells: int, batch: Column, k: int = 5) -> DataFrame:
    """(gene, other, cov, rank): for each gene the k genes of other batches that vary most with it."""
    mean = x.groupBy("gene").agg((F.sum("value") / n_cells).alias("mean"))
    a, b = (x.select("cell", F.col("gene").alias(g), F.col("value").alias(v)) for g, v in (("gene", "v"), ("other", "w")))
    cross = a.join(b, "cell").where("gene <> other").groupBy("gene", "other").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    own = mean.select("gene", F.col("mean").alias("m1"), batch.alias("b1"))
    far = mean.select(F.col("gene").alias("other"), F.col("mean").alias("m2"), batch.alias("b2"))
    cov = cross.join(own, "gene").join(far, "other").where("b1 <> b2").select("gene", "other", (F.col("s") / n_cells - F.col("m1") * F.col("m2")).alias("cov"))
    return top_k_by(cov, k, ["gene"], F.desc(F.abs("cov")), "other")
