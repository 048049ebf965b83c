"""Mining of tuning results: frequent choices, upserts of best scores, similarity weights."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(runs: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """Missing scores as 0 if higher is better, else as something worse than the maximum."""
    bad = F.col(metric).isNull() | F.isnan(metric)
    if higher:
        return runs.withColumn(metric, F.when(bad, 0.0).otherwise(F.col(metric)))
    worst = runs.where(~bad).agg((F.max(metric) * 1.1).alias("_worst"))
    return runs.join(F.broadcast(worst)).withColumn(metric, F.when(bad, F.col("_worst")).otherwise(F.col(metric))).drop("_worst")


def frequent_choices(runs: DataFrame, items: str, metric: str, share: float = 0.1, support: float = 0.1, higher: bool = True) -> DataFrame:
    """(items, freq): combinations of choices that are frequent among the best share of runs."""
    cut = runs.agg(F.percentile(metric, 1 - share if higher else share).alias("cut"))
    best = runs.join(F.broadcast(cut)).where(F.col(metric) >= F.col("cut") if higher else F.col(metric) <= F.col("cut"))
    return FPGrowth(itemsCol="_items", minSupport=support).fit(best.select(F.array_distinct(items).alias("_items"))).freqItemsets


def upserted(old: DataFrame, new: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows of both by key; a new row replaces an old one only if its score is higher."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), "_new")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def best_runs(runs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The best run of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *[c for c in runs.columns if c not in (*keys, score)])
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def matching_runs(runs: DataFrame, config: dict) -> DataFrame:
    """Runs whose columns equal a config; missing values match missing ones."""
    for key, value in config.items():
        runs = runs.where(F.col(f"`{key}`").eqNullSafe(F.lit(value)))
    return runs


def weighted_choice(pairs: DataFrame, weight: float) -> DataFrame:
    """(query, atlas, score): for each query the atlas set of best weighted similarity.

    pairs: (query, atlas, feature, metadata); missing similarities are 0.
    """
    score = weight * F.coalesce("feature", F.lit(0.0)) + (1 - weight) * F.coalesce("metadata", F.lit(0.0))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "atlas")
    return pairs.select("query", "atlas", score.alias("score")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def rank_cost(choice: DataFrame, ranks: DataFrame, bottom: int = 10_000) -> DataFrame:
    """One row: sum over chosen sets and methods of the best rank that the query gives the method's choice.

    ranks: (query, atlas, method, rank); a method without a rank counts as bottom.
    """
    methods = ranks.select("query", "method").distinct()
    own = choice.select("query", "atlas").join(methods, "query")
    found = ranks.groupBy("query", "atlas", "method").agg(F.min("rank").alias("rank"))
    return own.join(found, ["query", "atlas", "method"], "left").agg(F.sum(F.coalesce("rank", F.lit(bottom))).alias("cost"))


def agreement(a: DataFrame, b: DataFrame, key: str = "step", value: str = "target") -> DataFrame:
    """One row: share of steps at which two pipelines choose the same target."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    return both.agg(F.avg(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("double")).alias("share"))
