"""Positions, ranks and top-k with fixed tie order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the folder named in spark.checkpoint.dir; as it is where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """df with `position`, 0, 1, ... in an order, without a single-task sort.

    Rows are sorted over range partitions, numbered inside each, and shifted by the sizes
    of the partitions before (a table with one row per partition). The numbered rows are
    written, where a checkpoint folder is set, so that both uses see the same bounds.
    """
    parted = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    numbered = written(parted.withColumn("_at", F.row_number().over(inside) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return numbered.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_first") + F.col("_at")).alias("position"))


def running_total(df: DataFrame, value: str, *order: str) -> DataFrame:
    """df with `before`, the sum of a column over all rows before in an order, without a single-task sort.

    The sums inside range partitions are written with their partition, so that both uses
    of the partitioning see the same bounds.
    """
    parted = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = written(parted.withColumn("_at", F.coalesce(F.sum(value).over(inside), F.lit(0))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return numbered.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_first") + F.col("_at")).alias("before"))


def average_rank(value: str, *group: str) -> Column:
    """Rank of a value within a group, tied values sharing the mean of their ranks."""
    order = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; the order must break ties."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, k: int, group: list[str], *order: Column | str) -> DataFrame:
    """The first k rows of each group, with their place in `rank`."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
