"""The queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import bucket_of, table
from .decontam import contaminated
from .html import main_texts
from .langid import language_id
from .minhash import near_duplicates
from .packing import packed
from .quality import quality_scores
from .secrets import secret_spans
from .substring import repeated_passages
from .warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived_pages(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_balanced_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), bucket_of(F.col("doc_id"), 4) != 2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket_of(F.col("doc_id"), 5) == 0)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_best_fit_packing, op3_warc, op4_secret_scans, op5_html_extraction, op6_minhash_near_dedup, op7_balanced_posting_ann, op8_language_id, op9_substring_dedup, op10_quality_classifier)}


SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, CAST(STRLEN(COALESCE(html, '')) AS BIGINT) AS n, SHA1(COALESCE(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN MAX(page_id) OVER (PARTITION BY d) ELSE page_id END AS r FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM m""",
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN LEN(w) = 0 THEN [] WHEN LEN(w) < 3 THEN [ARRAY_TO_STRING(w, ' ')] ELSE LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LEN(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(LEN(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, UNNEST(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT n.doc_id, n AS n_shingles, c.c AS component_id, n.doc_id = c.c AS kept FROM n JOIN (SELECT doc_id, MIN(c) AS c FROM r GROUP BY 1) c ON c.doc_id = n.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
