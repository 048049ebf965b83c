"""Scores of predictions, clusterings and imputations; each is one row or a float."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import ratio
from ..registry import register


def pairs(n):
    return n * (n - 1) / 2


@register("metric", "acc")
def accuracy(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Share of right predictions; a cell may have several right labels (an array)."""
    hit = F.array_contains(true, F.col(pred)) if dict(df.dtypes)[true].startswith("array") else F.col(true) == F.col(pred)
    return df.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("acc"))


@register("metric", "ari")
def adjusted_rand(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    cells = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    s = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("all"))
    a = cells.groupBy(true).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    b = cells.groupBy(pred).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    full = s.join(F.broadcast(a)).join(F.broadcast(b))
    chance = ratio(F.col("a") * F.col("b"), pairs(F.col("all")))
    return full.select(F.coalesce(ratio(F.col("both") - chance, (F.col("a") + F.col("b")) / 2 - chance), F.lit(1.0)).alias("ari"))


@register("metric", "nmi")
def mutual_information(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Mutual information over the greater entropy."""
    cells = df.groupBy(true, pred).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    entropy = lambda c, name: cells.groupBy(*c).agg(F.sum("n").alias("n")).join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all"))).alias(name))
    full = entropy([true], "a").join(F.broadcast(entropy([pred], "b"))).join(F.broadcast(entropy([true, pred], "ab")))
    return full.select(F.coalesce(ratio(F.col("a") + F.col("b") - F.col("ab"), F.greatest("a", "b")), F.lit(1.0)).alias("nmi"))


@register("metric", "mse")
def mean_squared(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(true) - F.col(pred)) ** 2).alias("mse"))


@register("metric", "mape")
def mean_absolute_share(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(true) - F.col(pred)) / F.greatest(F.abs(F.col(true)), F.lit(sys.float_info.epsilon))).alias("mape"))


@register("metric", "imputation")
def imputation(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """RMSE, Pearson correlation and mean relative error of held-out entries."""
    gap = F.col(true) - F.col(pred)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.corr(true, pred).alias("pcc"), F.avg(F.abs(gap) / F.greatest(F.abs(F.col(true)), F.lit(1e-10))).alias("mre"))


def labeled_clustering(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """NMI and ARI, rounded to 3 places."""
    n, a = mutual_information(df, true, pred), adjusted_rand(df, true, pred)
    return n.join(F.broadcast(a)).select(F.round("nmi", 3).alias("nmi"), F.round("ari", 3).alias("ari"))
