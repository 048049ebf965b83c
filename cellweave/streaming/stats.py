"""Incremental per-key statistics over event streams (an extension: the batch engine has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, time: str, keys: list[str], value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, keys..., n, total, squares): mergeable sums per window; also for static tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) ** 2).alias("squares"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total", "squares")


def merged(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, mean, std) from windowed sums."""
    s = stats.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean = F.col("total") / F.col("n")
    return s.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
