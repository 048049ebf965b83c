"""Corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next one; all but the
last return the columns of documents. A stage judges every row that its predecessor kept.
Stages mix learned profiles, hashing and sequential packing, which SQL does not express;
tests/llm checks run() against a plain version.

Defined cases, for every stage: no rows give no rows with the same columns; columns beside
those of documents are kept by all stages but the last, whatever their names and types;
equal rows are judged alike, and near_dedup keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import saved, table, unused
from cellweave.llm.decontam import contaminated
from cellweave.llm.langid import identify, learn
from cellweave.llm.minhash import Scheme, one_of_each
from cellweave.llm.packing import packed
from cellweave.llm.secrets import redacted

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in some language: null texts and texts without a letter are rejected.

    Profiles are learned from all rows with a lang; where there are none, every text with
    a letter stays, since nothing tells it from a known language.
    """
    names = unused(docs, "lang_pred", "score", "has_letters")
    return identify(docs, learn(docs), docs.columns, tuple(names)).where(F.col(names[2])).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, at 5-word shingles and 0.8: the one with the smallest doc_id.

    Rows with a null doc_id and blank texts all stay.
    """
    return one_of_each(docs, Scheme(percent=80, words=5, bands=36, rows=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; rows with one doc_id go together, those without one stay."""
    (hit,) = unused(docs, "hit")
    hits = saved(contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(hit)).distinct(), "hits")
    return docs.join(hits, F.col("doc_id") == F.col(hit), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; null and clean texts as they are."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining texts goes; blank texts are pieces of 0 words."""
    return packed(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
