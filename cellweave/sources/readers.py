"""Sources and sinks of annotated matrices, and the cache of prepared ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import AnnotatedFrame


def from_events(facts: DataFrame, cell: str | Column, gene: str | Column, value: str | Column, obs: DataFrame, var: DataFrame) -> AnnotatedFrame:
    """A frame whose entries are sums of a fact table's values by cell and gene."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    x = facts.groupBy(col(cell).alias("cell"), col(gene).alias("gene")).agg(F.sum(col(value)).cast("double").alias("value"))
    return AnnotatedFrame(x, obs, var)


def wide_csv(spark: SparkSession, path: str, key: str, by_gene: bool = True) -> DataFrame:
    """(cell, gene, value) from a CSV file with a key column and a column per cell (or gene)."""
    wide = spark.read.csv(path, header=True)
    names = [c for c in wide.columns if c != key]
    long = wide.unpivot([key], names, "other", "value").select(F.col(key).alias("a"), F.col("other").alias("b"), F.col("value").cast("double").alias("value"))
    a, b = ("gene", "cell") if by_gene else ("cell", "gene")
    return long.select(F.col("b" if by_gene else "a").alias("cell"), F.col("a" if by_gene else "b").alias("gene"), "value").where("value <> 0")


def aligned(x: DataFrame, genes: DataFrame) -> DataFrame:
    """Entries of the reference genes only; missing ones are the implicit zeros."""
    return x.join(genes.select("gene"), "gene", "left_semi")


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, gene) from a gene-set file: name, note and genes between tabs."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("pathway"), F.explode(F.slice("p", 3, F.size("p"))).alias("gene")).where("gene <> ''")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A symmetric, row-normalised graph with loops from a file of pairs (and weights)."""
    from ..operators.graphs import loaded

    raw = spark.read.text(path).select(F.split(F.trim("value"), r"[\s,]+").alias("p")).where(F.size("p") > 1)
    return loaded(raw.select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)).alias("weight")))


def spatial(x: DataFrame, positions: DataFrame) -> AnnotatedFrame:
    """Spots inside the tissue with their coordinates: positions (cell, captured, px, py, ...)."""
    obs = positions.where("captured = 1").drop("captured")
    return AnnotatedFrame(x.join(obs.select("cell"), "cell", "left_semi"), obs, x.select("gene").distinct())


def common_types(reference: DataFrame, truth: DataFrame, label: str) -> DataFrame:
    """Reference cells whose type is among the truth's types."""
    return reference.join(truth.select(label).distinct(), label, "left_semi")


def write_frame(frame: AnnotatedFrame, path: str) -> None:
    """Every table of a frame as Parquet below a path."""
    named = {"x": frame.x, "obs": frame.obs, "var": frame.var, "raw": frame.raw, "splits": frame.splits}
    for kind in ("layers", "obsm", "varm", "obsp", "varp"):
        named |= {f"{kind}/{k}": v for k, v in getattr(frame, kind).items()}
    for name, df in named.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = frame.x.sparkSession
    spark.createDataFrame([(json.dumps({"tables": sorted(k for k, v in named.items() if v is not None), "config": dict(frame.config)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_frame(spark: SparkSession, path: str) -> AnnotatedFrame:
    info = json.loads(spark.read.text(f"{path}/manifest").first().value)
    load = lambda name: spark.read.parquet(f"{path}/{name}")
    parts = {n: load(n) for n in info["tables"] if "/" not in n}
    for name in info["tables"]:
        if "/" in name:
            kind, key = name.split("/", 1)
            parts.setdefault(kind, {})[key] = load(name)
    return AnnotatedFrame(**parts, config=info["config"])


def cache_key(name: str, transform: object) -> str:
    """A key of a source and of all parameters of the transform applied to it."""
    return hashlib.sha256(json.dumps([name, transform], sort_keys=True, default=repr).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, name: str, load: Callable[[], AnnotatedFrame], pipeline: dict | None = None, redo: bool = False) -> AnnotatedFrame:
    """A source with a pipeline config applied, kept as Parquet under the key of both."""
    from ..plans.pipeline import Pipeline

    path = f"{folder}/{cache_key(name, pipeline)}"
    if not redo:
        try:
            return read_frame(spark, path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    frame = load()
    write_frame(Pipeline(pipeline)(frame) if pipeline else frame, path)
    return read_frame(spark, path)
