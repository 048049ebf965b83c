"""Normalisation of long matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import ratio

AXIS_MODES = ("normalize", "standardize", "minmax", "l2")


def _safe(d: Column, eps: float) -> Column:
    """eps -1: a zero denominator becomes 1; else eps is added."""
    return F.when(d == 0, 1.0).otherwise(d) if eps == -1 else d + eps


def filled(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """x with a row for every cell of obs and gene of var; what is not stored is 0. For results that are dense by nature."""
    grid = obs.select("cell").crossJoin(var.select("gene"))
    return grid.join(x, ["cell", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def by_axis(x: DataFrame, mode: str = "normalize", axis: str = "gene", eps: float = -1, group: str | None = None, obs: DataFrame | None = None, var: DataFrame | None = None) -> DataFrame:
    """Entries scaled over all entries that share `axis` (and, for genes, a group of cells in obs).

    normalize and l2 keep zeros and give the stored entries. standardize and minmax shift
    them, so their result is dense: a row for each cell of obs and gene of var.
    """
    if mode not in AXIS_MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {AXIS_MODES}")
    if eps != -1 and eps <= 0:
        raise ValueError(f"eps is positive, or -1 for zero denominators as ones, not {eps}")
    if group and obs is None or mode in ("standardize", "minmax") and (obs is None or var is None):
        raise ValueError(f"{mode} needs the cells and the genes")
    keys = [axis] + ([group] if group else [])
    typed = x if group is None else x.join(obs.select("cell", group), "cell")
    s = typed.groupBy(*keys).agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("*").alias("_m"))
    v = F.col("value")
    if mode in ("normalize", "l2"):
        d = F.col("_s") if mode == "normalize" else F.sqrt("_q")
        return typed.join(s, keys).withColumn("value", v / _safe(d, eps)).select(*x.columns)
    full = filled(x, obs, var) if group is None else filled(x, obs, var).join(obs.select("cell", group), "cell")
    if group is None:
        size = F.lit(float(obs.count() if axis == "gene" else var.count()))
    else:
        full = full.join(F.broadcast(obs.groupBy(group).agg(F.count("*").alias("_n"))), group)
        size = F.col("_n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if mode == "standardize":
        shift = zero(F.col("_s") / size)
        scale = F.sqrt(F.greatest(zero(F.col("_q") / size) - shift * shift, F.lit(0.0)))
    else:
        stored = F.coalesce("_m", F.lit(0)) >= size
        shift = F.when(stored, F.col("_low")).otherwise(F.least(zero(F.col("_low")), F.lit(0.0)))
        scale = F.when(stored, F.col("_high")).otherwise(F.greatest(zero(F.col("_high")), F.lit(0.0))) - shift
    return full.join(s, keys, "left").withColumn("value", (v - shift) / _safe(scale, eps)).select("cell", "gene", "value")


def total(x: DataFrame, target: float | None = None, max_fraction: float = 0.05) -> DataFrame:
    """Cells scaled to a total. Genes above max_fraction of a cell's total in some cell do
    not count for its total; target None is the median of the positive totals."""
    cells = x.groupBy("cell").agg(F.sum("value").alias("_all"))
    if max_fraction < 1:
        high = x.join(cells, "cell").where(F.col("value") > max_fraction * F.col("_all")).select("gene").distinct()
        # what is left out of the totals is a share of the entries only, so it is summed apart
        out = x.join(high, "gene", "left_semi").groupBy("cell").agg(F.sum("value").alias("_out"))
        rest = F.col("_all") - F.coalesce("_out", F.lit(0.0))
        cells = cells.join(out, "cell", "left").select("cell", F.when(F.abs(rest) > 1e-12 * F.abs(F.col("_all")), rest).otherwise(0.0).alias("_t"))
    else:
        cells = cells.select("cell", F.col("_all").alias("_t"))
    if target is None:
        cells = cells.join(F.broadcast(cells.where("_t > 0").agg(F.median("_t").alias("_goal"))))
    else:
        cells = cells.withColumn("_goal", F.lit(float(target)))
    factor = F.when(F.col("_t") > 0, F.col("_t") / F.col("_goal")).otherwise(1.0)
    return x.join(cells, "cell").withColumn("value", F.col("value") / factor).select(*x.columns)


def log1p(x: DataFrame, base: float | None = None) -> DataFrame:
    return x.withColumn("value", F.log1p("value") / (math.log(base) if base else 1.0))


def total_log1p(x: DataFrame, target: float | None = None, max_fraction: float = 0.05, base: float | None = None) -> DataFrame:
    return log1p(total(x, target, max_fraction), base)


def tfidf(x: DataFrame, n_cells: int) -> DataFrame:
    """Entry over its cell's total, times cells over its gene's total."""
    tf = x.groupBy("cell").agg(F.sum("value").alias("_r"))
    idf = x.groupBy("gene").agg(F.sum("value").alias("_c"))
    return x.join(tf, "cell").join(idf, "gene").withColumn("value", ratio(F.col("value"), F.col("_r")) * ratio(F.lit(float(n_cells)), F.col("_c"))).select(*x.columns)


def lsi_input(x: DataFrame, n_cells: int, scale: float = 1e4) -> DataFrame:
    """tf-idf, each cell scaled to sum 1, then log1p of scale times the value."""
    return log1p(by_axis(tfidf(x, n_cells), "normalize", "cell").withColumn("value", F.col("value") * scale))


def size_factors(x: DataFrame) -> DataFrame:
    """(cell, n_counts, size_factor): totals, and totals over their median."""
    cells = x.groupBy("cell").agg(F.sum("value").alias("n_counts"))
    return cells.join(F.broadcast(cells.agg(F.median("n_counts").alias("m")))).select("cell", "n_counts", ratio(F.col("n_counts"), F.col("m")).alias("size_factor"))


def stabilize(x: DataFrame, obs: DataFrame, genes: DataFrame) -> DataFrame:
    """ln(x + 1 / (2 phi)), phi fitted to variance = mean + phi mean^2 over the genes; dense, since zeros shift."""
    from .stats import gene_moments

    m = gene_moments(x, genes, obs.count())
    phi = m.agg(ratio(F.sum(F.col("mean") ** 2 * (F.col("variance") - F.col("mean"))), F.sum(F.col("mean") ** 4)).alias("phi"))
    shift = 1 / (2 * F.col("phi"))
    return filled(x, obs, genes).join(F.broadcast(phi)).select("cell", "gene", F.log(F.col("value") + shift).alias("value"))


def regress_out(dense: DataFrame, covariate: DataFrame) -> DataFrame:
    """Residuals of each gene on a covariate (cell, c); dense: an entry for every cell and gene."""
    full = dense.join(covariate, "cell")
    fit = full.groupBy("gene").agg(F.regr_slope("value", "c").alias("_s"), F.regr_intercept("value", "c").alias("_i"))
    return full.join(fit, "gene").withColumn("value", F.col("value") - F.coalesce(F.col("_s") * F.col("c") + F.col("_i"), F.lit(0.0))).select(*dense.columns)


def pearson_residuals(x: DataFrame, obs: DataFrame, genes: DataFrame, theta: float = 100.0, clip: float | None = None) -> DataFrame:
    """Residuals of counts under a negative binomial whose mean is cell total times gene share.

    Dense: a row for each cell and kept gene; negative residuals are set to 0 and large
    ones to clip (root of the cells, if not given).
    """
    n = obs.count()
    cells = x.groupBy("cell").agg(F.sum("value").alias("_r"))
    share = x.groupBy("gene").agg(F.sum("value").alias("_c")).join(genes.select("gene"), "gene", "left_semi")
    all_counts = x.agg(F.sum("value").alias("_all"))
    grid = cells.withColumn("_g", F.lit(1)).join(F.broadcast(share.join(F.broadcast(all_counts)).withColumn("_g", F.lit(1))), "_g")
    mu = F.col("_r") * F.col("_c") / F.col("_all")
    full = grid.select("cell", "gene", mu.alias("mu")).join(x, ["cell", "gene"], "left").na.fill(0, ["value"])
    z = (F.col("value") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") ** 2 / theta)
    return full.select("cell", "gene", F.greatest(F.lit(0.0), F.least(z, F.lit(clip or math.sqrt(n)))).alias("value"))
