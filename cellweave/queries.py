"""One query per operator over the benchmark tables, each with its SQL.

The matrix is customers by parts (sparse) or customers by brands (dense): summed
quantities. Customers' market segment is the cell type, their nation the batch.
Embeddings give dense vectors, and their first two numbers coordinates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import AnnotatedFrame
from .functions import metrics
from .operators import features, filters, graphs, models, normalize, ordering, sampling, selection, similarity, spatial, stats, transforms
from .plans import results
from .plans.pipeline import Pipeline
from .sources.readers import from_events
from .streaming.stats import merged, windowed_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

X = "x AS (SELECT o_custkey AS cell, l_partkey AS gene, CAST(SUM(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
B = "x AS (SELECT o_custkey AS cell, p_brand AS gene, CAST(SUM(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
CELLS = "cells AS (SELECT c_custkey AS cell, c_mktsegment AS cell_type, c_nationkey AS batch FROM customer), n AS (SELECT COUNT(*) AS n FROM customer)"
GENES = "genes AS (SELECT p_partkey AS gene, p_name AS gene_name FROM part)"
BRANDS = "genes AS (SELECT DISTINCT p_brand AS gene FROM part)"
MOMENTS = "m AS (SELECT g.gene, COALESCE(SUM(value), 0) AS total, COALESCE(SUM(value), 0) / (SELECT n FROM n) AS mean, GREATEST(COALESCE(SUM(value * value), 0) / (SELECT n FROM n) - POWER(COALESCE(SUM(value), 0) / (SELECT n FROM n), 2), 0) AS variance, COUNT(*) FILTER (value > 0) AS n_positive FROM genes g LEFT JOIN x ON x.gene = g.gene GROUP BY g.gene)"
EMB = "e AS (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{d}/{n}.parquet") for n in names]


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def parts(spark: SparkSession, d: str) -> AnnotatedFrame:
    """Customers by parts."""
    lines, orders, customer, part = read(spark, d, "lineitem", "orders", "customer", "part")
    facts = lines.select("l_orderkey", "l_partkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    obs = customer.select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("cell_type"), F.col("c_nationkey").alias("batch"))
    var = part.select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("gene_name"))
    return from_events(facts, "o_custkey", "l_partkey", "l_quantity", obs, var)


def brands(spark: SparkSession, d: str) -> AnnotatedFrame:
    """Customers by brands."""
    f = parts(spark, d)
    brand = read(spark, d, "part")[0].select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("brand"))
    x = f.x.join(brand, "gene").groupBy("cell", F.col("brand").alias("gene")).agg(F.sum("value").alias("value"))
    return f.replace(x=x, var=brand.select(F.col("brand").alias("gene")).distinct())


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings")[0].select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def points(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("cell", F.col("vec")[0].alias("px"), F.col("vec")[1].alias("py"), "label")


# Filters ---------------------------------------------------------------------


@query(f"WITH {X} SELECT c_custkey AS cell, COALESCE(SUM(value), 0) AS n_counts, COUNT(value) AS n_entries FROM customer LEFT JOIN x ON cell = c_custkey GROUP BY 1")
def cell_totals(spark, d):
    f = parts(spark, d)
    return filters.totals(f.x, "cell", f.obs)


@query(f"WITH {X} SELECT p_partkey AS gene, COALESCE(SUM(value), 0) AS n_counts, COUNT(value) AS n_entries FROM part LEFT JOIN x ON gene = p_partkey GROUP BY 1")
def gene_totals(spark, d):
    f = parts(spark, d)
    return filters.totals(f.x, "gene", f.var)


@query(f"WITH {X} SELECT cell, SUM(value) AS n_counts, COUNT(*) AS n_entries FROM x GROUP BY 1 HAVING SUM(value) BETWEEN 500 AND 2000 AND COUNT(*) >= 20")
def filter_cells_minmax(spark, d):
    f = parts(spark, d)
    return filters.by_thresholds(f.x, "cell", f.obs, min_counts=500, max_counts=2000, min_entries=20)


@query(f"WITH {X} SELECT gene, SUM(value) AS n_counts, COUNT(*) AS n_entries FROM x GROUP BY 1 HAVING COUNT(*) BETWEEN 20 AND 35 AND SUM(value) <= 900")
def filter_genes_minmax(spark, d):
    f = parts(spark, d)
    return filters.by_thresholds(f.x, "gene", f.var, max_counts=900, min_entries=20, max_entries=35)


@query(f"WITH {X}, t AS (SELECT gene, SUM(value) AS n_counts, COUNT(*) AS n_entries FROM x GROUP BY 1) SELECT * FROM t WHERE n_entries >= 20 AND n_counts >= 600 AND n_counts <= 900")
def filter_genes_ordered(spark, d):
    f = parts(spark, d)
    return filters.in_order(f.x, "gene", f.var, ["min_entries", "min_counts", "max_counts"], min_entries=20, min_counts=600, max_counts=900)


@query(f"WITH {X}, t AS (SELECT p_partkey AS gene, COALESCE(SUM(value), 0) AS n_counts, COUNT(value) AS n_entries FROM part LEFT JOIN x ON gene = p_partkey GROUP BY 1) SELECT * FROM t WHERE n_counts >= (SELECT QUANTILE_CONT(n_counts, 0.2) FROM t)")
def filter_ratio_percentile(spark, d):
    f = parts(spark, d)
    return filters.by_thresholds(f.x, "gene", f.var, min_counts=0.2)


def _percentile_sql(score: str) -> str:
    return f"WITH {X}, {CELLS}, {GENES}, {MOMENTS}, s AS (SELECT gene, {score} AS score FROM m) SELECT gene, ROUND(score, 6) AS score FROM s WHERE score BETWEEN (SELECT QUANTILE_CONT(score, 0.1) FROM s) AND (SELECT QUANTILE_CONT(score, 0.9) FROM s)"


def _percentile(mode: str) -> Callable:
    def run(spark, d):
        f = parts(spark, d)
        return filters.by_percentile(f.x, f.var, f.num_cells, 10, 90, mode).select("gene", *r6("score"))

    run.__name__ = f"genes_percentile_{mode}"
    return run


for _mode, _score in {"sum": "total", "var": "variance", "cv": "COALESCE(SQRT(variance) / NULLIF(mean, 0), 0)", "rv": "COALESCE(variance / NULLIF(mean, 0), 0)"}.items():
    query(_percentile_sql(_score))(_percentile(_mode))


@query(f"WITH {X}, {CELLS}, {GENES}, {MOMENTS} SELECT gene, ROUND(COALESCE(SQRT(variance) / NULLIF(mean, 0), 0), 6) AS score FROM m ORDER BY COALESCE(SQRT(variance) / NULLIF(mean, 0), 0) DESC, gene LIMIT 100")
def genes_topk_cv(spark, d):
    f = parts(spark, d)
    return filters.by_top_k(f.x, f.var, f.num_cells, 100).select("gene", *r6("score"))


@query(f"WITH {X}, {CELLS} SELECT gene FROM x JOIN cells USING (cell) GROUP BY gene HAVING COUNT(DISTINCT cell_type) FILTER (value <> 0) = (SELECT COUNT(DISTINCT cell_type) FROM cells)")
def genes_common_by_batch(spark, d):
    f = parts(spark, d)
    return filters.common_by_group(f.x, f.obs, "cell_type")


@query("SELECT DISTINCT o_custkey AS cell FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def cells_common_mod(spark, d):
    f, orders = parts(spark, d), read(spark, d, "orders")[0]
    side = lambda s: f.keep_cells(orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("cell")).distinct())
    both = f.replace(mod={"rna": side("F"), "protein": side("O")})
    return transforms.filter_cells_common(both, "rna", "protein").mod["protein"].obs.select("cell")


@query("SELECT p_partkey AS gene, p_name AS gene_name FROM part WHERE NOT (UPPER(p_name) LIKE 'A%' OR UPPER(p_name) LIKE '%E')")
def genes_match_prefix(spark, d):
    return filters.by_name(parts(spark, d).var, ["a"], ["e"])


PROFILE = "sizes AS (SELECT cell_type, COUNT(*) AS k FROM cells GROUP BY 1), p AS (SELECT cell_type, gene, SUM(value) / MAX(k) AS value FROM x JOIN cells USING (cell) JOIN sizes USING (cell_type) GROUP BY 1, 2)"


@query(f"WITH {X}, {CELLS}, {PROFILE}, t AS (SELECT cell_type, gene, LN(value + 1e-6) - LN((SUM(value) OVER (PARTITION BY gene) - value) / (SELECT COUNT(DISTINCT cell_type) - 1 FROM p) + 1e-6) AS f FROM p) SELECT cell_type, gene, ROUND(f, 6) AS log_fold FROM t WHERE f > 0.5")
def marker_genes_logfc(spark, d):
    f = parts(spark, d)
    return filters.markers(stats.profile(f.x, f.obs, "cell_type"), "cell_type", 0.5).select("cell_type", "gene", *r6("log_fold"))


GINI = """q AS (SELECT cell_type, gene, COUNT(*) / MAX(k) AS value FROM x JOIN cells USING (cell) JOIN sizes USING (cell_type) WHERE value > 0 GROUP BY 1, 2),
f AS (SELECT cell_type, gene, k, COALESCE(p.value, 0) AS e, COALESCE(q.value, 0) AS d FROM sizes CROSS JOIN genes LEFT JOIN p USING (cell_type, gene) LEFT JOIN q USING (cell_type, gene)),
o AS (SELECT *, (SUM(e * k) OVER w - e * k) / ((SELECT n FROM n) - k) AS er, (SUM(d * k) OVER w - d * k) / ((SELECT n FROM n) - k) AS dr FROM f WINDOW w AS (PARTITION BY gene)),
s AS (SELECT *, COALESCE(ABS(e - er) / NULLIF(2 * (ABS(e) + ABS(er)), 0), 0) * COALESCE(ABS(d - dr) / NULLIF(2 * (ABS(d) + ABS(dr)), 0), 0) * CASE WHEN e > er THEN 1.0 ELSE 0.1 END * CASE WHEN d > dr THEN 1.0 ELSE 0.1 END AS score FROM o),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_type ORDER BY score DESC, gene) AS rank FROM s)"""


@query(f"WITH {X}, {CELLS}, {GENES}, {PROFILE}, {GINI} SELECT cell_type, gene, ROUND(score, 9) AS score FROM r WHERE rank <= 5 OR e > 0.2 AND d > 0.03")
def marker_gini(spark, d):
    f = parts(spark, d)
    got = filters.gini_markers(stats.profile(f.x, f.obs, "cell_type"), stats.detection(f.x, f.obs, "cell_type"), stats.label_counts(f.obs, "cell_type"), "cell_type", least_detection=0.03, genes=f.var)
    return got.select("cell_type", "gene", F.round("score", 9).alias("score"))


def _regression(method: str, k: int = 50, places: int | None = None) -> Callable:
    def run(spark, d):
        f = parts(spark, d)
        scores = filters.regression_scores(f.x, f.var, f.num_cells, method)
        if places is not None:
            scores = scores.withColumn("score", F.round("score", places))
        return ordering.top_k(scores, k, F.desc("score"), "gene").select("gene", *r6("score"))

    run.__name__ = f"regression_{method}"
    return run


query(f"WITH {X}, {CELLS}, {GENES}, {MOMENTS}, t AS (SELECT gene, LN(mean + 1) / LN(2) AS a, LN(100 * (1 - n_positive / (SELECT n FROM n))) / LN(2) AS b FROM m WHERE n_positive > 0 AND n_positive < (SELECT n FROM n)), f AS (SELECT REGR_SLOPE(b, a) AS s, REGR_INTERCEPT(b, a) AS i FROM t) SELECT gene, ROUND(b - s * a - i, 6) AS score FROM t, f ORDER BY b - s * a - i DESC, gene LIMIT 50")(_regression("scmap"))
query(f"WITH {X}, {CELLS}, {GENES}, {MOMENTS}, t AS (SELECT gene, 1 - n_positive / (SELECT n FROM n) AS a, LN(mean + 1) AS b FROM m WHERE n_positive > 0 AND n_positive < (SELECT n FROM n)), f AS (SELECT REGR_SLOPE(b, a) AS s, REGR_INTERCEPT(b, a) AS i, AVG(b) AS c FROM t) SELECT gene, ROUND(2 * b - s * a - i - c, 6) AS score FROM t, f ORDER BY 2 * b - s * a - i - c DESC, gene LIMIT 50")(_regression("enclasc"))
# a quadratic by normal equations, solved by determinants
query(f"""WITH {X}, {CELLS}, {GENES}, {MOMENTS}, t AS (SELECT gene, LN(mean + 1) AS a, LN(variance + 1) AS b FROM m), p AS (SELECT AVG(a) AS p1, AVG(a * a) AS p2, AVG(a * a * a) AS p3, AVG(a * a * a * a) AS p4, AVG(b) AS q0, AVG(a * b) AS q1, AVG(a * a * b) AS q2 FROM t),
d AS (SELECT *, (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p2 * p3) + p2 * (p1 * p3 - p2 * p2) AS det FROM p),
c AS (SELECT (q0 * (p2 * p4 - p3 * p3) - p1 * (q1 * p4 - p3 * q2) + p2 * (q1 * p3 - p2 * q2)) / det AS c0, ((q1 * p4 - p3 * q2) - q0 * (p1 * p4 - p3 * p2) + p2 * (p1 * q2 - q1 * p2)) / det AS c1, ((p2 * q2 - q1 * p3) - p1 * (p1 * q2 - q1 * p2) + q0 * (p1 * p3 - p2 * p2)) / det AS c2 FROM d)
SELECT gene, ROUND(b - c0 - c1 * a - c2 * a * a, 4) AS score FROM t, c ORDER BY ROUND(b - c0 - c1 * a - c2 * a * a, 4) DESC, gene LIMIT 50""")(_regression("seurat3", 50, 4))


@query(f"""WITH {B}, {CELLS}, {BRANDS}, l AS (SELECT cell, gene, LN(1 + value) AS v FROM x), y AS (SELECT cell, gene, EXP(v) - 1 AS value FROM l),
m AS (SELECT g.gene, GREATEST(COALESCE(SUM(value), 0) / (SELECT n FROM n), 0) AS mean, GREATEST(COALESCE(SUM(value * value), 0) / (SELECT n FROM n) - POWER(COALESCE(SUM(value), 0) / (SELECT n FROM n), 2), 0) * (SELECT n FROM n) / ((SELECT n FROM n) - 1) AS variance FROM genes g LEFT JOIN y USING (gene) GROUP BY g.gene),
t AS (SELECT gene, LN(1 + mean) AS mean, LN(variance / mean) AS dispersion FROM m),
b AS (SELECT *, LEAST(FLOOR((mean - MIN(mean) OVER ()) * 5 / (MAX(mean) OVER () - MIN(mean) OVER ())), 4) AS bin FROM t),
s AS (SELECT bin, AVG(dispersion) AS c, STDDEV_SAMP(dispersion) AS d FROM b GROUP BY bin)
SELECT gene, ROUND(mean, 6) AS mean, ROUND(dispersion, 6) AS dispersion, ROUND((dispersion - CASE WHEN COALESCE(d, 0) = 0 THEN 0 ELSE c END) / (CASE WHEN COALESCE(d, 0) = 0 THEN c ELSE d END), 4) AS normalized FROM b JOIN s USING (bin)""")
def hvg_dispersion(spark, d):
    f = brands(spark, d)
    return filters.dispersion(normalize.log1p(f.x), f.var, f.num_cells, 5).select("gene", *r6("mean", "dispersion"), F.round("normalized", 4).alias("normalized"))


@query(f"""WITH {X}, {CELLS}, {GENES}, {MOMENTS}, t AS (SELECT gene, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS mean, variance * (SELECT n FROM n) / ((SELECT n FROM n) - 1) / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS dispersion FROM m),
b AS (SELECT t.*, LEN(LIST_FILTER((SELECT QUANTILE_CONT(mean, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) FROM t), lambda v: v < mean)) AS bin FROM t), o AS (SELECT *, MEDIAN(dispersion) OVER (PARTITION BY bin) AS mid FROM b), a AS (SELECT *, MEDIAN(ABS(dispersion - mid)) OVER (PARTITION BY bin) AS mad FROM o)
SELECT gene, ROUND(mean, 6) AS mean, ROUND(dispersion, 6) AS dispersion, ROUND((dispersion - mid) / NULLIF(mad, 0), 4) AS normalized FROM a""")
def hvg_cell_ranger(spark, d):
    f = parts(spark, d)
    return filters.dispersion(f.x, f.var, f.num_cells, 20, "cell_ranger").select("gene", *r6("mean", "dispersion"), F.round("normalized", 4).alias("normalized"))


@query(f"WITH {X}, {CELLS}, t AS (SELECT c.cell, LN(1 + COALESCE(SUM(value), 0)) AS v FROM cells c LEFT JOIN x USING (cell) GROUP BY 1), a AS (SELECT cell, ABS(v - (SELECT MEDIAN(v) FROM t)) AS away FROM t) SELECT cell, away > 3 * (SELECT MEDIAN(away) FROM a) AS outlier FROM a")
def qc_mad_outliers(spark, d):
    f = parts(spark, d)
    s = filters.totals(f.x, "cell", f.obs).select("cell", F.log1p("n_counts").alias("log_total"))
    return filters.away_from_median(s, "log_total", 3)


@query(f"""WITH {X}, {CELLS}, {GENES}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS i FROM x), q AS (SELECT cells.cell, COALESCE(SUM(value), 0) AS t, COUNT(value) AS g, COALESCE(SUM(value) FILTER (i <= 20), 0) AS top, COALESCE(SUM(value) FILTER (REGEXP_MATCHES(gene_name, '^(MT-|Mt-|mt-)')), 0) AS mito FROM cells LEFT JOIN o USING (cell) LEFT JOIN genes USING (gene) GROUP BY 1),
r AS (SELECT cell, LN(1 + t) AS log_total, LN(1 + g) AS log_genes, COALESCE(100 * top / NULLIF(t, 0), 0) AS pct_top, COALESCE(100 * mito / NULLIF(t, 0), 0) AS pct_mito FROM q),
a AS (SELECT *, ABS(log_total - (SELECT MEDIAN(log_total) FROM r)) AS a1, ABS(log_genes - (SELECT MEDIAN(log_genes) FROM r)) AS a2, ABS(pct_top - (SELECT MEDIAN(pct_top) FROM r)) AS a3, ABS(pct_mito - (SELECT MEDIAN(pct_mito) FROM r)) AS a4 FROM r)
SELECT cell, ROUND(log_total, 6) AS log_total, ROUND(log_genes, 6) AS log_genes, ROUND(pct_top, 6) AS pct_top FROM a WHERE a1 <= 5 * (SELECT MEDIAN(a1) FROM a) AND a2 <= 5 * (SELECT MEDIAN(a2) FROM a) AND a3 <= 5 * (SELECT MEDIAN(a3) FROM a) AND a4 <= 3 * (SELECT MEDIAN(a4) FROM a) AND pct_mito <= 8""")
def qc_good_cells(spark, d):
    f = parts(spark, d)
    return filters.good_cells(filters.cell_quality(f.x, f.obs, f.var)).select("cell", *r6("log_total", "log_genes", "pct_top"))


@query("SELECT c_custkey AS cell, c_mktsegment AS cell_type, c_nationkey AS batch FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING COUNT(*) > 50)")
def cell_type_min_count(spark, d):
    return filters.small_types(parts(spark, d).obs, "batch", 50).select("cell", "cell_type", "batch")


# Normalisation ---------------------------------------------------------------


def _axis(mode: str) -> Callable:
    def run(spark, d):
        f = brands(spark, d)
        out = normalize.by_axis(f.x, mode, "gene", obs=f.obs, var=f.var)
        return out.select("cell", "gene", *r6("value"))

    run.__name__ = f"column_sum_normalize_{mode}"
    return run


_AXIS = f"WITH {B}, {CELLS}, s AS (SELECT gene, SUM(value) AS s, SUM(value * value) AS q, MIN(value) AS lo, MAX(value) AS hi, COUNT(*) AS m FROM x GROUP BY 1) SELECT cell, gene, ROUND({{}}, 6) AS value FROM x JOIN s USING (gene), n"
query(_AXIS.format("value / s"))(_axis("normalize"))
query(_AXIS.format("value / SQRT(q)"))(_axis("l2"))
_DENSE = _AXIS.replace("FROM x JOIN s USING (gene), n", "FROM (SELECT cell, gene, COALESCE(value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN x USING (cell, gene)) JOIN s USING (gene), n").replace(", s AS", f", {BRANDS}, s AS", 1)
query(_DENSE.format("(value - s / n) / SQRT(q / n - (s / n) * (s / n))"))(_axis("standardize"))
query(_DENSE.format("(value - CASE WHEN m < n THEN 0 ELSE lo END) / (hi - CASE WHEN m < n THEN 0 ELSE lo END)"))(_axis("minmax"))

_TOTAL = "t AS (SELECT cell, SUM(value) AS t FROM x GROUP BY 1)"


@query(f"WITH {X}, {_TOTAL} SELECT cell, gene, ROUND(value / (t / 10000.0), 6) AS value FROM x JOIN t USING (cell)")
def normalize_total(spark, d):
    return normalize.total(parts(spark, d).x, 1e4, 1.0).select("cell", "gene", *r6("value"))


@query(f"WITH {X}, {_TOTAL}, h AS (SELECT DISTINCT gene FROM x JOIN t USING (cell) WHERE value > 0.2 * t), k AS (SELECT cell, COALESCE(SUM(value) FILTER (gene NOT IN (SELECT gene FROM h)), 0) AS k FROM x GROUP BY 1), g AS (SELECT MEDIAN(k) AS goal FROM k WHERE k > 0) SELECT cell, gene, FLOOR((CASE WHEN k > 0 THEN value / (k / goal) ELSE value END) * 1e6 + 0.5) / 1e6 AS value FROM x JOIN k USING (cell), g")
def normalize_total_excl(spark, d):
    return normalize.total(parts(spark, d).x, None, 0.2).select("cell", "gene", (F.floor(F.col("value") * 1e6 + 0.5) / 1e6).alias("value"))


@query(f"WITH {X} SELECT cell, gene, ROUND(LN(1 + value) / LN(2), 6) AS value FROM x")
def log1p_base2(spark, d):
    return normalize.log1p(parts(spark, d).x, 2).select("cell", "gene", *r6("value"))


@query(f"WITH {X}, {_TOTAL} SELECT cell, gene, ROUND(LN(1 + value / (t / 10000.0)), 6) AS value FROM x JOIN t USING (cell)")
def norm_log_chain(spark, d):
    return normalize.total_log1p(parts(spark, d).x, 1e4, 1.0).select("cell", "gene", *r6("value"))


@query(f"WITH {X}, {CELLS}, {_TOTAL}, c AS (SELECT gene, SUM(value) AS c FROM x GROUP BY 1) SELECT cell, gene, ROUND(value / t * (n / c), 6) AS value FROM x JOIN t USING (cell) JOIN c USING (gene), n")
def tfidf(spark, d):
    f = parts(spark, d)
    return normalize.tfidf(f.x, f.num_cells).select("cell", "gene", *r6("value"))


@query(f"WITH {X}, {_TOTAL} SELECT cell, t AS n_counts, ROUND(t / (SELECT MEDIAN(t) FROM t), 6) AS size_factor FROM t")
def size_factors(spark, d):
    return normalize.size_factors(parts(spark, d).x).select("cell", "n_counts", *r6("size_factor"))


@query(f"WITH {X}, {_TOTAL} SELECT ROUND(AVG(LN(t)), 6) AS mean, ROUND(VAR_POP(LN(t)), 6) AS variance FROM t")
def log_library_size(spark, d):
    return stats.library_size(parts(spark, d).x).select(*r6("mean", "variance"))


@query(f"WITH {B}, {CELLS}, {_TOTAL}, c AS (SELECT gene, SUM(value) AS c FROM x GROUP BY 1), a AS (SELECT SUM(c) AS a FROM c), f AS (SELECT t.cell, c.gene, t * c / a AS mu, COALESCE(value, 0) AS value FROM t CROSS JOIN c CROSS JOIN a LEFT JOIN x ON x.cell = t.cell AND x.gene = c.gene) SELECT cell, gene, ROUND(GREATEST(0, LEAST((value - mu) / SQRT(mu + mu * mu / 100), SQRT((SELECT n FROM n)))), 6) AS value FROM f")
def pearson_residuals(spark, d):
    f = brands(spark, d)
    return normalize.pearson_residuals(f.x, f.obs, f.var).select("cell", "gene", *r6("value"))


# Statistics ------------------------------------------------------------------


@query(f"WITH {X}, {CELLS}, {GENES}, s AS (SELECT g.gene, AVG(value) FILTER (value > 0) AS mu, COUNT(*) FILTER (value > 0) / (SELECT n FROM n) AS alpha, COALESCE(SUM(value), 0) / (SELECT n FROM n) AS mean, GREATEST(COALESCE(SUM(value * value), 0) / (SELECT n FROM n) - POWER(COALESCE(SUM(value), 0) / (SELECT n FROM n), 2), 0) AS v, COALESCE(MAX(value), 0) AS top FROM genes g LEFT JOIN x ON x.gene = g.gene GROUP BY 1) SELECT gene, ROUND(mu, 6) AS mu, ROUND(alpha, 6) AS alpha, ROUND(mean, 6) AS mean_all, ROUND(SQRT(v) / NULLIF(mean, 0), 6) AS cov_all, ROUND(v / NULLIF(mean, 0), 6) AS fano_all, top AS max_all, ROUND(SQRT(v), 6) AS std_all FROM s")
def gene_stats(spark, d):
    f = parts(spark, d)
    return stats.gene_stats(f.x, f.var, f.num_cells).select("gene", *r6("mu", "alpha", "mean_all", "cov_all", "fano_all"), "max_all", *r6("std_all"))


@query(f"WITH {X}, {CELLS}, {PROFILE} SELECT cell_type, gene, ROUND(value, 6) AS value FROM p")
def ct_profile_mean(spark, d):
    f = parts(spark, d)
    return stats.profile(f.x, f.obs, "cell_type").select("cell_type", "gene", *r6("value"))


@query(f"WITH {B}, {CELLS}, {BRANDS}, f AS (SELECT cell_type, gene, COALESCE(value, 0) AS value FROM cells CROSS JOIN genes LEFT JOIN x USING (cell, gene)) SELECT cell_type, gene, ROUND(MEDIAN(value), 6) AS value FROM f GROUP BY 1, 2")
def ct_profile_median(spark, d):
    f = brands(spark, d)
    return stats.profile(f.x, f.obs, "cell_type", "median").select("cell_type", "gene", *r6("value"))


@query(f"WITH {X}, {CELLS}, s AS (SELECT cell_type, COUNT(*) AS k FROM cells GROUP BY 1) SELECT cell_type, gene, ROUND(COUNT(*) / MAX(k), 6) AS value FROM x JOIN cells USING (cell) JOIN s USING (cell_type) WHERE value > 30 GROUP BY 1, 2")
def ct_detection(spark, d):
    f = parts(spark, d)
    return stats.detection(f.x, f.obs, "cell_type", 30).select("cell_type", "gene", *r6("value"))


@query(f"WITH {B}, {CELLS}, {BRANDS}, s AS (SELECT cell, SUM(value) / (SELECT COUNT(*) FROM genes) AS mean, SQRT(SUM(value * value) / (SELECT COUNT(*) FROM genes) - POWER(SUM(value) / (SELECT COUNT(*) FROM genes), 2)) AS std, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS q2, QUANTILE_CONT(value, 0.75) AS q3, MAX(value) AS high, COUNT(*) / 1000 AS detected, AVG(value) AS nz_mean, STDDEV_POP(value) AS nz_std FROM x GROUP BY 1), b AS (SELECT batch, AVG(mean) AS mean, AVG(std) AS std, AVG(q1) AS q1, AVG(q2) AS q2, AVG(q3) AS q3, AVG(high) AS high, AVG(detected) AS detected, AVG(nz_mean) AS nz_mean, AVG(nz_std) AS nz_std FROM s JOIN cells USING (cell) GROUP BY 1) SELECT cell, ROUND(mean, 5) AS mean, ROUND(std, 5) AS std, ROUND(q1, 5) AS q1, ROUND(q2, 5) AS q2, ROUND(q3, 5) AS q3, ROUND(high, 5) AS high, ROUND(detected, 5) AS detected, ROUND(nz_mean, 5) AS nz_mean, ROUND(nz_std, 5) AS nz_std FROM cells JOIN b USING (batch)")
def cell_features_batch(spark, d):
    f = brands(spark, d)
    out = stats.cell_features(f.x, f.obs, f.num_genes, "batch")
    return out.select("cell", *(F.round(c, 5).alias(c) for c in out.columns[1:]))


@query("WITH e AS (SELECT vec_id, label, vec_id % 17 AS grp FROM embeddings), c AS (SELECT grp, label, COUNT(*) AS k FROM e GROUP BY 1, 2), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY k DESC, label) AS i, SUM(k) OVER (PARTITION BY grp) AS a FROM c) SELECT grp, CASE WHEN k / a >= 0.15 THEN CAST(label AS VARCHAR) ELSE 'Heterogeneous' END AS label FROM r WHERE i = 1")
def majority_vote(spark, d):
    cells = vectors(spark, d).select((F.col("cell") % 17).alias("grp"), F.col("label").cast("string").alias("label"))
    return stats.majority_vote(cells, "grp", "label", 0.15)


@query("SELECT c_custkey AS cell, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0::DOUBLE ELSE 0.0 END AS {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")) + " FROM customer")
def onehot_labels(spark, d):
    out = sampling.one_hot(parts(spark, d).obs, "cell_type", ["AUTOMOBILE", "BUILDING", "MACHINERY"])
    return out.select("cell", *(F.col(c).alias(c.lower()) for c in out.columns[1:]))


@query("SELECT label, COUNT(*) AS n FROM embeddings GROUP BY 1")
def label_counts(spark, d):
    return stats.label_counts(vectors(spark, d), "label")


@query("SELECT c_custkey AS cell, DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_encoding(spark, d):
    return features.encoded(parts(spark, d).obs, "cell_type").select("cell", F.col("code").cast("long").alias("code"))


# Graphs ----------------------------------------------------------------------

_KNN = f"{EMB}, p AS (SELECT a.cell AS src, b.cell AS dst, LIST_DISTANCE(a.vec, b.vec) AS distance FROM e a, e b WHERE a.cell <> b.cell), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p QUALIFY rank <= 10)"


@query(f"WITH {_KNN} SELECT src, dst, ROUND(distance, 6) AS distance, rank FROM k")
def knn_graph(spark, d):
    return graphs.nearest(vectors(spark, d).drop("label"), 10).select("src", "dst", *r6("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KNN} SELECT a.src, a.dst FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_nn(spark, d):
    return graphs.mutual(graphs.nearest(vectors(spark, d).drop("label"), 10)).select("src", "dst")


_RADIUS = "q AS (SELECT vec_id AS cell, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py, label FROM embeddings), r AS (SELECT a.cell AS src, b.cell AS dst, SQRT(POWER(a.px - b.px, 2) + POWER(a.py - b.py, 2)) AS distance FROM q a, q b WHERE SQRT(POWER(a.px - b.px, 2) + POWER(a.py - b.py, 2)) <= 0.05)"


@query(f"WITH {_RADIUS} SELECT src, dst, ROUND(distance, 6) AS distance FROM r")
def radius_graph(spark, d):
    return graphs.within_radius(points(spark, d), 0.05).select("src", "dst", *r6("distance"))


@query(f"WITH {B}, {CELLS}, m AS (SELECT gene, SUM(value) / (SELECT n FROM n) AS m, SQRT(SUM(value * value) / (SELECT n FROM n) - POWER(SUM(value) / (SELECT n FROM n), 2)) AS s FROM x GROUP BY 1), c AS (SELECT a.gene AS src, b.gene AS dst, SUM(a.value * b.value) / (SELECT n FROM n) AS p FROM x a JOIN x b USING (cell) WHERE a.gene < b.gene GROUP BY 1, 2) SELECT src, dst, ROUND((p - u.m * v.m) / (u.s * v.s), 6) AS weight FROM c JOIN m u ON u.gene = src JOIN m v ON v.gene = dst WHERE ABS((p - u.m * v.m) / (u.s * v.s)) >= 0.02")
def feature_corr_graph(spark, d):
    f = brands(spark, d)
    return graphs.correlated(f.x, f.num_cells, 0.02).select("src", "dst", *r6("weight"))


@query(f"WITH {X}, c AS (SELECT cell, SUM(value) AS s, COUNT(*) AS k FROM x GROUP BY 1), g AS (SELECT gene, SUM(value) AS s, COUNT(*) AS k FROM x GROUP BY 1) SELECT 'c:' || cell AS src, 'g:' || gene AS dst, ROUND(k * value / s, 6) AS weight FROM x JOIN g USING (gene) UNION ALL SELECT 'g:' || gene, 'c:' || cell, ROUND(k * value / s, 6) FROM x JOIN c USING (cell)")
def bipartite_edges_norm(spark, d):
    return graphs.bipartite(parts(spark, d).x).select("src", "dst", *r6("weight"))


@query(f"WITH {_RADIUS}, g AS (SELECT src, COUNT(*) AS d FROM r GROUP BY 1) SELECT r.src, r.dst, ROUND(1 / SQRT(a.d * b.d), 6) AS weight FROM r JOIN g a ON a.src = r.src JOIN g b ON b.src = r.dst")
def adj_sym_norm(spark, d):
    return graphs.symmetric_norm(graphs.within_radius(points(spark, d), 0.05).withColumn("weight", F.lit(1.0))).select("src", "dst", *r6("weight"))


def _spatial(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    v = vectors(spark, d)
    x = v.select("cell", F.posexplode("vec").alias("gene", "value"))
    return x, graphs.nearest(v.drop("label"), 5).select("src", "dst", F.lit(1.0).alias("weight")), v.count()


_AUTO = f"WITH {EMB}, p AS (SELECT a.cell AS src, b.cell AS dst, LIST_DISTANCE(a.vec, b.vec) AS distance FROM e a, e b WHERE a.cell <> b.cell), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM p QUALIFY rank <= 5), v AS (SELECT cell, UNNEST(RANGE(64)) AS gene, UNNEST(vec) AS value FROM e), n AS (SELECT COUNT(*) AS n, COUNT(*) * 5.0 AS w FROM e), m AS (SELECT gene, AVG(value) AS m, SUM(value * value) - COUNT(*) * AVG(value) * AVG(value) AS q FROM v GROUP BY 1), t AS (SELECT a.gene, SUM((a.value - m) * (b.value - m)) AS i, SUM((a.value - b.value) * (a.value - b.value)) AS c FROM k JOIN v a ON a.cell = src JOIN v b ON b.cell = dst AND a.gene = b.gene JOIN m ON m.gene = a.gene GROUP BY 1) "


@query(_AUTO + "SELECT gene, ROUND(n * i / (q * w), 5) AS moran FROM t JOIN m USING (gene), n")
def moran_i(spark, d):
    return graphs.moran(*_spatial(spark, d)).select(F.col("gene").cast("long").alias("gene"), F.round("moran", 5).alias("moran"))


@query(_AUTO + "SELECT gene, ROUND((n - 1) * c / (2 * q * w), 5) AS geary FROM t JOIN m USING (gene), n")
def geary_c(spark, d):
    return graphs.moran(*_spatial(spark, d)).select(F.col("gene").cast("long").alias("gene"), F.round("geary", 5).alias("geary"))


@query(f"WITH {_KNN}, l AS (SELECT src, label, COUNT(*) AS c FROM k JOIN e ON cell = dst WHERE rank <= 6 GROUP BY 1, 2), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY c DESC, label) AS i, SUM(c) OVER (PARTITION BY src) AS a FROM l) SELECT e.cell, CASE WHEN COALESCE(o.c, 0) < b.a / 2 AND b.c > b.a / 2 THEN b.label ELSE e.label END AS label FROM e LEFT JOIN b ON b.src = e.cell AND i = 1 LEFT JOIN l o ON o.src = e.cell AND o.label = e.label")
def spatial_refine(spark, d):
    v = vectors(spark, d)
    return graphs.refined(v.select("cell", "label"), graphs.nearest(v.drop("label"), 6))


@query(f"WITH {_KNN}, v AS (SELECT cell, UNNEST(RANGE(64)) AS gene, UNNEST(vec) AS value FROM e) SELECT a.cell, a.gene, ROUND(0.5 * ANY_VALUE(a.value) + 0.5 * AVG(b.value), 6) AS value FROM v a JOIN k ON a.cell = src AND rank <= 5 JOIN v b ON b.cell = dst AND b.gene = a.gene GROUP BY 1, 2")
def sme_smooth(spark, d):
    x, edges, _ = _spatial(spark, d)
    return graphs.smoothed(x, edges).select("cell", F.col("gene").cast("long").alias("gene"), *r6("value"))


@query(f"WITH {_KNN}, u AS (SELECT a.src, a.dst FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst), t AS (SELECT COUNT(*) AS m FROM u), z AS (SELECT x.label AS a, y.label AS b FROM u JOIN e x ON x.cell = src JOIN e y ON y.cell = dst), g AS (SELECT label, COUNT(*) AS deg FROM (SELECT a AS label FROM z UNION ALL SELECT b FROM z) GROUP BY 1), i AS (SELECT a AS label, COUNT(*) AS own FROM z WHERE a = b GROUP BY 1) SELECT ROUND(SUM(COALESCE(own, 0) / m - POWER(deg / (2 * m), 2)), 6) AS modularity FROM g LEFT JOIN i USING (label), t")
def modularity(spark, d):
    v = vectors(spark, d)
    edges = graphs.mutual(graphs.nearest(v.drop("label"), 10)).select("src", "dst", F.lit(1.0).alias("weight"))
    return graphs.modularity(edges, v.select("cell", "label")).select(*r6("modularity"))


@query()
def louvain_labels(spark, d):
    edges = graphs.mutual(graphs.nearest(vectors(spark, d).drop("label"), 10)).select("src", "dst", F.lit(1.0).alias("weight"))
    return graphs.louvain(edges, 4)


@query(f"""WITH {_KNN}, m AS (SELECT src, GREATEST(distance, 1e-12) AS mid FROM k WHERE rank = 5), d AS (SELECT k.src, dst, distance / mid AS d FROM k JOIN m ON m.src = k.src), b AS (SELECT src, dst, EXP(-POWER(SUM(d), 2)) AS w FROM (SELECT src, dst, d FROM d UNION ALL SELECT dst, src, d FROM d) GROUP BY 1, 2),
l AS (SELECT src, dst, w FROM b UNION ALL SELECT DISTINCT src, src, 1.0 FROM b), u AS (SELECT src, dst, w / SUM(w) OVER (PARTITION BY src) AS w FROM l), v AS (SELECT cell, UNNEST(RANGE(64)) AS gene, UNNEST(vec) AS value FROM e),
o AS (SELECT src AS cell, gene, SUM(w * value) AS value FROM u JOIN v ON v.cell = dst GROUP BY 1, 2) SELECT src AS cell, gene, ROUND(SUM(w * value), 6) AS value FROM u JOIN o ON o.cell = dst GROUP BY 1, 2""")
def diffusion_imputation(spark, d):
    v = vectors(spark, d)
    x = v.select("cell", F.posexplode("vec").alias("gene", "value"))
    return models.diffused(x, graphs.nearest(v.drop("label"), 10), 2).select("cell", F.col("gene").cast("long").alias("gene"), *r6("value"))


@query(f"WITH {B}, {CELLS}, p AS (SELECT x.cell, gene, value, cell_type FROM x JOIN cells USING (cell) WHERE value > 0), f AS (SELECT *, RANK() OVER (PARTITION BY gene ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rk, COUNT(*) OVER (PARTITION BY gene) AS m FROM p), k AS (SELECT cell_type, COUNT(*) AS size FROM cells GROUP BY 1), s AS (SELECT cell_type, gene, SUM(rk + (SELECT n FROM n) - m) AS s, COUNT(*) AS c, MAX(m) AS m FROM f GROUP BY 1, 2) SELECT cell_type, gene, ROUND(s + (size - c) * ((SELECT n FROM n) - m + 1) / 2, 6) AS rank_sum FROM s JOIN k USING (cell_type)")
def rank_sum_markers(spark, d):
    f = brands(spark, d)
    return filters.rank_sums(f.x, f.obs, "cell_type").select("cell_type", "gene", *r6("rank_sum"))


@query(f"WITH {B}, {CELLS}, a AS (SELECT gene, SUM(value) / (SELECT n FROM n) AS m, CAST(SUBSTR(gene, LENGTH(gene), 1) AS INT) % 2 AS b FROM x GROUP BY 1), c AS (SELECT u.gene, v.gene AS other, SUM(u.value * v.value) / (SELECT n FROM n) AS p FROM x u JOIN x v USING (cell) WHERE u.gene <> v.gene GROUP BY 1, 2), t AS (SELECT c.gene, other, p - u.m * v.m AS cov FROM c JOIN a u ON u.gene = c.gene JOIN a v ON v.gene = other WHERE u.b <> v.b), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY gene ORDER BY ABS(cov) DESC, other) AS rank FROM t) SELECT gene, other, ROUND(cov, 5) AS cov, rank FROM r WHERE rank <= 5")
def holdout_predictors(spark, d):
    f = brands(spark, d)
    got = filters.top_covarying(f.x, f.num_cells, F.substring("gene", -1, 1).cast("int") % 2)
    return got.select("gene", "other", F.round("cov", 5).alias("cov"), F.col("rank").cast("long").alias("rank"))


# Features --------------------------------------------------------------------


@query()
def pca_scores(spark, d):
    return features.projected(vectors(spark, d), 8)


@query()
def svd_scores(spark, d):
    return features.projected(vectors(spark, d), 8, centre=False)


@query(None)
def svd_spectrum(spark, d):
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(features.spectrum(vectors(spark, d), False))], "i int, value double")


@query()
def random_projection(spark, d):
    return features.random_projection(brands(spark, d).x, 8)


@query(f"WITH {B}, {CELLS}, k AS (SELECT cell_type, COUNT(*) AS k FROM cells GROUP BY 1), g AS (SELECT gene, SUM(value) / (SELECT n FROM n) AS t, SUM(value * value) / (SELECT n FROM n) AS q FROM x GROUP BY 1), o AS (SELECT cell_type, gene, SUM(value) / (SELECT n FROM n) AS s FROM x JOIN cells USING (cell) GROUP BY 1, 2) SELECT cell_type, gene, ROUND((s - t * k / n) / SQRT((q - t * t) * (k / n) * (1 - k / n)), 6) AS r FROM o JOIN k USING (cell_type) JOIN g USING (gene), n")
def type_association(spark, d):
    f = brands(spark, d)
    return features.signed_association(f.x, f.obs, "cell_type").select("cell_type", "gene", *r6("r"))


@query()
def scn_pairs(spark, d):
    f = brands(spark, d)
    return features.gene_pairs(f.x, f.obs, "cell_type").select("cell_type", "a", "b", *r6("r"))


@query(f"WITH {B}, {_TOTAL}, w AS (SELECT gene, CAST(SUBSTR(gene, LENGTH(gene), 1) AS DOUBLE) AS weight FROM x GROUP BY 1) SELECT cell, ROUND(SUM(value * weight) / MAX(t), 6) AS value FROM x JOIN w USING (gene) JOIN t USING (cell) GROUP BY 1")
def weighted_features(spark, d):
    f = brands(spark, d)
    w = f.var.select("gene", F.lit(0).alias("dim"), F.substring("gene", -1, 1).cast("double").alias("weight"))
    return features.weighted_features(f.x, w).select("cell", *r6("value"))


# Splits, samples, models -----------------------------------------------------


@query("SELECT cell, CASE WHEN p < n // 2 THEN 'train' WHEN p < n // 2 + n // 10 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey AS cell, ROW_NUMBER() OVER (ORDER BY c_custkey) - 1 AS p, COUNT(*) OVER () AS n FROM customer)")
def split_data(spark, d):
    f = parts(spark, d)
    n = f.num_cells
    return f.with_split_sizes(n // 2, n // 10).splits.select("cell", "split")


@query(f"WITH {X} SELECT c_custkey AS cell, CASE WHEN c_nationkey < 10 THEN 0 ELSE 1 END AS batch, COALESCE(SUM(value), 0) AS total, COUNT(value) AS entries FROM customer LEFT JOIN x ON cell = c_custkey GROUP BY c_custkey, c_nationkey")
def append_batches(spark, d):
    f = parts(spark, d)
    low = f.keep_cells(f.obs.where("batch < 10"))
    high = f.keep_cells(f.obs.where("batch >= 10"))
    drop = lambda g: g.replace(obs=g.obs.drop("batch"))
    both = drop(low).append(drop(high), label_batch=True)
    rows = both.x.groupBy("cell").agg(F.sum("value").alias("total"), F.count("*").alias("entries"))
    return both.obs.join(rows, "cell", "left").select("cell", "batch", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("entries", F.lit(0)).alias("entries"))


@query()
def mask_cellwise(spark, d):
    return sampling.mask_cellwise(parts(spark, d).x, 0.1, "exp", 1, valid_share=0.1)


@query()
def pseudo_mixture(spark, d):
    f = parts(spark, d)
    return sampling.pseudo_mixture(f.x, f.obs, "cell_type", 200)[0]


@query()
def kmeans_labels(spark, d):
    return models.Clusterer(10).fit_predict(vectors(spark, d))


@query()
def logreg_pred(spark, d):
    v = vectors(spark, d)
    return models.Classifier("logistic", maxIter=20).fit_predict(v.drop("label"), v.select("cell", "label"))


@query()
def nnls_deconvolution(spark, d):
    f = transforms.dense(brands(spark, d))
    obs = parts(spark, d).obs
    profile = f.join(obs, "cell").select("cell_type", F.posexplode("vec").alias("i", "v")).groupBy("cell_type", "i").agg(F.avg("v").alias("v"))
    profile = profile.groupBy("cell_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("vec"))
    return models.deconvolved(f, profile, "cell_type").select("cell", "cell_type", *r6("share"))


# Metrics ---------------------------------------------------------------------


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in prediction: the label, wrong for every seventh vector."""
    return vectors(spark, d).select(F.col("label").alias("true"), F.when(F.col("cell") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("pred"))


_PRED = "p AS (SELECT label AS t, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS q FROM embeddings)"


@query(f"WITH {_PRED} SELECT ROUND(AVG(CASE WHEN t = q THEN 1.0 ELSE 0.0 END), 6) AS acc FROM p")
def accuracy(spark, d):
    return metrics.accuracy(_predicted(spark, d)).select(*r6("acc"))


@query(f"WITH {_PRED}, c AS (SELECT t, q, COUNT(*) AS k FROM p GROUP BY 1, 2), a AS (SELECT SUM(k * (k - 1) / 2) AS a FROM (SELECT SUM(k) AS k FROM c GROUP BY t)), b AS (SELECT SUM(k * (k - 1) / 2) AS b FROM (SELECT SUM(k) AS k FROM c GROUP BY q)), s AS (SELECT SUM(k * (k - 1) / 2) AS s, SUM(k) * (SUM(k) - 1) / 2 AS al FROM c) SELECT ROUND((s - a * b / al) / ((a + b) / 2 - a * b / al), 6) AS ari FROM a, b, s")
def ari(spark, d):
    return metrics.adjusted_rand(_predicted(spark, d)).select(*r6("ari"))


@query(f"WITH {_PRED}, n AS (SELECT COUNT(*) AS n FROM p), a AS (SELECT SUM(-k / n * LN(k / n)) AS a FROM (SELECT COUNT(*) AS k FROM p GROUP BY t), n), b AS (SELECT SUM(-k / n * LN(k / n)) AS b FROM (SELECT COUNT(*) AS k FROM p GROUP BY q), n), c AS (SELECT SUM(-k / n * LN(k / n)) AS c FROM (SELECT COUNT(*) AS k FROM p GROUP BY t, q), n) SELECT ROUND((a + b - c) / GREATEST(a, b), 6) AS nmi FROM a, b, c")
def nmi(spark, d):
    return metrics.mutual_information(_predicted(spark, d)).select(*r6("nmi"))


@query("SELECT ROUND(AVG(POWER(l_extendedprice - l_quantity * 1500, 2)), 2) AS mse FROM lineitem")
def mse(spark, d):
    rows = read(spark, d, "lineitem")[0].select(F.col("l_extendedprice").alias("true"), (F.col("l_quantity") * 1500).alias("pred"))
    return metrics.mean_squared(rows).select(F.round("mse", 2).alias("mse"))


@query("SELECT ROUND(AVG(ABS(l_extendedprice - l_quantity * 1500) / GREATEST(ABS(l_extendedprice), 2.220446049250313e-16)), 6) AS mape FROM lineitem")
def mape(spark, d):
    rows = read(spark, d, "lineitem")[0].select(F.col("l_extendedprice").alias("true"), (F.col("l_quantity") * 1500).alias("pred"))
    return metrics.mean_absolute_share(rows).select(*r6("mape"))


@query("WITH g AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem) SELECT ROUND(SQRT(AVG((t - p) * (t - p))), 3) AS rmse, ROUND(CORR(t, p), 6) AS pcc, ROUND(AVG(ABS(t - p) / GREATEST(ABS(t), 1e-10)), 6) AS mre FROM g")
def imputation_scores(spark, d):
    rows = read(spark, d, "lineitem")[0].select(F.col("l_extendedprice").alias("true"), (F.col("l_quantity") * 1500).alias("pred"))
    return metrics.imputation(rows).select(F.round("rmse", 3).alias("rmse"), *r6("pcc", "mre"))


# Similarity ------------------------------------------------------------------


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, d).drop("label")
    return v.where("cell % 2 = 0"), v.where("cell % 2 = 1")


_PAIRS = f"{EMB}, a AS (SELECT vec FROM e WHERE cell % 2 = 0), b AS (SELECT vec FROM e WHERE cell % 2 = 1)"


@query(f"WITH {_PAIRS} SELECT ROUND(AVG(LIST_COSINE_SIMILARITY(a.vec, b.vec)), 6) AS similarity FROM a, b")
def sim_cosine(spark, d):
    return similarity.mean_cosine(*_halves(spark, d)).select(*r6("similarity"))


@query(f"WITH {_PAIRS}, c AS (SELECT LIST_TRANSFORM(vec, lambda v: v - LIST_AVG(vec)) AS u FROM a), g AS (SELECT LIST_TRANSFORM(vec, lambda v: v - LIST_AVG(vec)) AS u FROM b) SELECT ROUND(AVG(LIST_COSINE_SIMILARITY(c.u, g.u)), 6) AS similarity FROM c, g")
def sim_pearson(spark, d):
    return similarity.mean_cosine(*_halves(spark, d), centred=True).select(*r6("similarity"))


def _scalar(f: Callable) -> Callable:
    def run(spark, d):
        return spark.createDataFrame([(round(float(f(*_halves(spark, d))), 6),)], "similarity double")

    return run



@query(f"WITH {_PAIRS} SELECT ROUND(1 / (1 + GREATEST(0, 2 * (SELECT AVG(LIST_DISTANCE(a.vec, b.vec)) FROM a, b) - (SELECT AVG(LIST_DISTANCE(a.vec, c.vec)) FROM a, a c) - (SELECT AVG(LIST_DISTANCE(b.vec, c.vec)) FROM b, b c))), 6) AS similarity")
def sim_energy(spark, d):
    return _scalar(similarity.energy)(spark, d)


@query(f"WITH {_PAIRS}, s AS (SELECT (SELECT AVG(EXP(-POWER(LIST_DISTANCE(a.vec, b.vec), 2))) FROM a, b) AS ab, (SELECT (SUM(EXP(-POWER(LIST_DISTANCE(a.vec, c.vec), 2))) - SQRT(COUNT(*))) / (COUNT(*) - SQRT(COUNT(*))) FROM a, a c) AS aa, (SELECT (SUM(EXP(-POWER(LIST_DISTANCE(b.vec, c.vec), 2))) - SQRT(COUNT(*))) / (COUNT(*) - SQRT(COUNT(*))) FROM b, b c) AS bb) SELECT ROUND(1 / (1 + SQRT(GREATEST(0, aa + bb - 2 * ab))), 4) AS similarity FROM s")
def sim_mmd(spark, d):
    return _scalar(similarity.discrepancy)(spark, d).select(F.round("similarity", 4).alias("similarity"))


@query(f"WITH {_PAIRS}, x AS (SELECT MIN(LIST_DISTANCE(a.vec, b.vec)) AS m FROM a, b GROUP BY a.vec), y AS (SELECT MIN(LIST_DISTANCE(a.vec, b.vec)) AS m FROM a, b GROUP BY b.vec) SELECT ROUND(1 - ((SELECT AVG(m) FROM x) + (SELECT AVG(m) FROM y)) / SQRT(64), 6) AS similarity")
def sim_chamfer(spark, d):
    return _scalar(lambda a, b: similarity.chamfer(a, b, 64))(spark, d)


@query(f"WITH {_PAIRS}, x AS (SELECT MIN(LIST_DISTANCE(a.vec, b.vec)) AS m FROM a, b GROUP BY a.vec), y AS (SELECT MIN(LIST_DISTANCE(a.vec, b.vec)) AS m FROM a, b GROUP BY b.vec) SELECT ROUND(1 - GREATEST((SELECT MAX(m) FROM x), (SELECT MAX(m) FROM y)) / SQRT(64), 6) AS similarity")
def sim_hausdorff(spark, d):
    return _scalar(lambda a, b: similarity.hausdorff(a, b, 64))(spark, d)


@query()
def sim_spectral(spark, d):
    return _scalar(similarity.spectral)(spark, d)


@query()
def sim_bures(spark, d):
    return _scalar(similarity.bures)(spark, d)


@query("SELECT COUNT(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def sim_common_genes(spark, d):
    lines = read(spark, d, "lineitem")[0]
    side = lambda s: lines.where(F.col("l_returnflag") == s).select(F.col("l_partkey").alias("gene")).distinct()
    return similarity.common_genes(side("A"), side("R"))


@query(f"WITH {_PAIRS} SELECT 'cosine' AS method, ROUND(AVG(LIST_COSINE_SIMILARITY(a.vec, b.vec)), 6) AS similarity FROM a, b UNION ALL SELECT 'energy', ROUND(1 / (1 + GREATEST(0, 2 * (SELECT AVG(LIST_DISTANCE(a.vec, b.vec)) FROM a, b) - (SELECT AVG(LIST_DISTANCE(a.vec, c.vec)) FROM a, a c) - (SELECT AVG(LIST_DISTANCE(b.vec, c.vec)) FROM b, b c))), 6)")
def sim_runs(spark, d):
    found = similarity.similarities(*_halves(spark, d), ["cosine", "energy"], 64, n_runs=2)
    return spark.createDataFrame([(m, round(v, 6)) for m, v in found.items()], "method string, similarity double")


# Pipelines and streams -------------------------------------------------------


@query(f"WITH {X}, g AS (SELECT gene FROM x GROUP BY 1 HAVING COUNT(*) >= 25), y AS (SELECT x.* FROM x JOIN g USING (gene)), t AS (SELECT cell, SUM(value) AS t FROM y GROUP BY 1) SELECT cell, gene, ROUND(LN(1 + value / (t / 10000.0)), 6) AS value FROM y JOIN t USING (cell)")
def pipeline_chain(spark, d):
    config = {"type": "preprocessor", "pipeline": [
        {"type": "filter.gene", "target": "FilterGenesScanpy", "params": {"min_cells": 25}},
        {"type": "normalize", "target": "NormalizeTotal", "params": {"target_sum": 1e4, "max_fraction": 1.0}},
        {"type": "normalize", "target": "Log1P"},
    ]}
    return Pipeline(config)(parts(spark, d)).x.select("cell", "gene", *r6("value"))


@query("SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_stats(spark, d):
    s = windowed_stats(read(spark, d, "events")[0], "ts", ["event_type"], "value")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 5) AS std FROM events GROUP BY 1")
def merged_event_stats(spark, d):
    s = merged(windowed_stats(read(spark, d, "events")[0], "ts", ["event_type"], "value"), ["event_type"])
    return s.select("event_type", "n", *r6("mean"), F.round("std", 5).alias("std"))


# Spatial weights, matching, selection ----------------------------------------


@query(f"WITH {X}, t AS (SELECT c_custkey AS cell, COALESCE(SUM(value), 0) AS t FROM customer LEFT JOIN x ON cell = c_custkey GROUP BY 1) SELECT cell, ROUND(t / SUM(t) OVER (), 9) AS density FROM t")
def tangram_density(spark, d):
    f = parts(spark, d)
    return spatial.density(f.x, f.obs, "rna_count").select("cell", F.round("density", 9).alias("density"))


@query(f"WITH {_KNN}, m AS (SELECT *, AVG(distance) OVER w + STDDEV_POP(distance) OVER w AS m FROM k WINDOW w AS (PARTITION BY src)) SELECT src, dst, ROUND(1 / (distance + 1e-16), 5) AS weight FROM m WHERE distance <= m")
def pruned_knn(spark, d):
    return spatial.pruned(graphs.nearest(vectors(spark, d).drop("label"), 10)).select("src", "dst", F.round("weight", 5).alias("weight"))


@query(f"WITH {_RADIUS} SELECT ROUND(SUM(EXP(-POWER(distance, 2) / (2 * 0.02 * 0.02))) / (SELECT COUNT(*) FROM q), 6) AS p FROM r WHERE src <> dst")
def spatial_row_mass(spark, d):
    p = points(spark, d)
    return spatial.row_mass(graphs.within_radius(p, 0.05), p.count(), 0.02).select(*r6("p"))


@query()
def spatial_length_scale(spark, d):
    p = points(spark, d)
    found = spatial.length_scale(graphs.within_radius(p, 0.05), p.count(), 0.5, high=1.0)
    return spark.createDataFrame([(float(found),)], "length double")


@query(f"WITH {_RADIUS}, s AS (SELECT COUNT(*) AS n FROM q WHERE label = 3) SELECT b.label, COUNT(*) AS links FROM r JOIN q a ON a.cell = src AND a.label = 3 JOIN q b ON b.cell = dst WHERE b.label <> 3 GROUP BY 1 HAVING COUNT(*) > 0.5 * (SELECT n FROM s)")
def neighbour_clusters(spark, d):
    p = points(spark, d)
    return spatial.neighbour_clusters(graphs.within_radius(p, 0.05), p.select("cell", "label"), 3)


@query(f"WITH {_KNN}, v AS (SELECT cell, UNNEST(RANGE(64)) AS gene, UNNEST(vec) AS value FROM e) SELECT a.cell, a.gene, ROUND(ANY_VALUE(a.value) + 0.2 * AVG(b.value), 6) AS value FROM v a JOIN k ON a.cell = src AND rank <= 5 JOIN v b ON b.cell = dst AND b.gene = a.gene GROUP BY 1, 2")
def spatial_augment(spark, d):
    x, edges, _ = _spatial(spark, d)
    return spatial.augmented(x, edges).select("cell", F.col("gene").cast("long").alias("gene"), *r6("value"))


@query(f"WITH {B}, {CELLS}, o AS (SELECT batch, gene, AVG(value) AS m, STDDEV_POP(value) AS s FROM x JOIN cells USING (cell) GROUP BY 1, 2), w AS (SELECT gene, AVG(value) AS am, STDDEV_POP(value) AS sd FROM x GROUP BY 1) SELECT cell, gene, ROUND(COALESCE((value - m) / NULLIF(s, 0), 0) * sd + am, 4) AS value FROM x JOIN cells USING (cell) JOIN o USING (batch, gene) JOIN w USING (gene)")
def batch_adjust(spark, d):
    f = brands(spark, d)
    return spatial.batch_adjusted(f.x, f.obs, "batch").select("cell", "gene", F.round("value", 4).alias("value"))


@query(f"WITH {B}, {CELLS}, m AS (SELECT gene, SUM(value) / (SELECT n FROM n) AS m, SQRT(SUM(value * value) / (SELECT n FROM n) - POWER(SUM(value) / (SELECT n FROM n), 2)) AS s FROM x GROUP BY 1), g AS (SELECT DISTINCT SUBSTR(p_brand, 1, LENGTH(p_brand) - 1) AS pathway, p_brand AS gene FROM part), c AS (SELECT a.gene AS src, b.gene AS dst, SUM(a.value * b.value) / (SELECT n FROM n) AS p FROM x a JOIN x b USING (cell) JOIN g u ON u.gene = a.gene JOIN g v ON v.gene = b.gene AND u.pathway = v.pathway WHERE a.gene < b.gene GROUP BY 1, 2) SELECT src, dst, ROUND((p - u.m * v.m) / (u.s * v.s), 6) AS weight FROM c JOIN m u ON u.gene = src JOIN m v ON v.gene = dst WHERE ABS((p - u.m * v.m) / (u.s * v.s)) >= 0.1")
def gene_set_graph(spark, d):
    f = brands(spark, d)
    sets = f.var.select(F.expr("substring(gene, 1, length(gene) - 1)").alias("pathway"), "gene")
    return spatial.gene_set_graph(f.x, sets, f.num_cells, 0.1).select("src", "dst", *r6("weight"))


@query()
def modality_matching(spark, d):
    v = vectors(spark, d)
    side = lambda k, c: v.where(F.col("cell") % 2 == k).select((F.col("cell") % 100).alias("h"), F.col("cell").alias(c), F.col("vec").alias(f"{c}_vec"))
    pairs = side(0, "a").withColumn("batch", F.floor(F.col("h") / 2)).join(side(1, "b").withColumn("batch", F.floor(F.col("h") / 2)).drop("h"), "batch")
    return spatial.matched(pairs.select("batch", "a", "b", graphs.dot("a_vec", "b_vec").alias("score")))


@query()
def link_pairs(spark, d):
    return spatial.random_pairs(vectors(spark, d).select("cell", "label"), 500)


@query(f"WITH {X}, {CELLS}, s AS (SELECT gene, AVG(LOG2(value)) AS m, 1 - COUNT(*) / (SELECT n FROM n) AS z FROM x GROUP BY 1 HAVING COUNT(*) >= 10), o AS (SELECT gene, m + LN(z - 0.02) / 1.5 AS v FROM s WHERE z > 0.02) SELECT gene, ROUND(v, 6) AS value FROM o ORDER BY v DESC, gene LIMIT 100")
def genes_by_dropout(spark, d):
    f = parts(spark, d)
    return selection.by_dropout(f.x, f.num_cells, 100).select("gene", F.round("offset", 6).alias("value"))


@query()
def hvg_clipped_variance(spark, d):
    f = parts(spark, d)
    return selection.clipped_variances(f.x, f.var, f.num_cells).select("gene", *r6("score"))


@query()
def marker_tests(spark, d):
    f = brands(spark, d)
    return selection.marker_tests(f.x, f.obs, "cell_type", least_fold=-1.0, inside=0.1, outside=1.1, level=1.1)


@query()
def doublet_scores(spark, d):
    f = brands(spark, d)
    made = lambda rows: features.projected(ordering.written(transforms.normalized_rows(rows, f.num_genes, 1e4)), 8)
    return selection.doublet_scores(transforms.entries(f), made)


@query("WITH r AS (SELECT c_mktsegment AS g, RANK() OVER (ORDER BY c_acctbal) + (COUNT(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS rk FROM customer), s AS (SELECT SUM(s * s / k) AS h, SUM(k) AS n FROM (SELECT SUM(rk) AS s, COUNT(*) AS k FROM r GROUP BY g)), t AS (SELECT SUM(POWER(t, 3) - t) AS t FROM (SELECT COUNT(*) AS t FROM customer GROUP BY c_acctbal)) SELECT ROUND((12 * h / (n * (n + 1)) - 3 * (n + 1)) / (1 - t / (POWER(n, 3) - n)), 5) AS h FROM s, t")
def kruskal_wallis(spark, d):
    rows = read(spark, d, "customer")[0]
    return selection.kruskal(rows, "c_mktsegment", "c_acctbal").select(F.round("h", 5).alias("h"))


_DIST = f"{EMB}, c AS (SELECT cell, vec, LIST_TRANSFORM(vec, lambda v: v - LIST_AVG(vec)) AS u, LIST_TRANSFORM(vec, lambda v: LEN(LIST_FILTER(vec, lambda w: w < v)) + (LEN(LIST_FILTER(vec, lambda w: w = v)) + 1) / 2.0) AS r FROM e), d AS (SELECT cell, vec, u, LIST_TRANSFORM(r, lambda v: v - LIST_AVG(r)) AS t FROM c)"


@query(f"WITH {EMB} SELECT a.cell AS src, b.cell AS dst, ROUND(LIST_DISTANCE(a.vec, b.vec), 6) AS distance FROM e a, e b")
def pair_distances(spark, d):
    return graphs.pair_distances(vectors(spark, d), digits=6)


@query(f"WITH {_DIST} SELECT a.cell AS src, b.cell AS dst, ROUND(1 - LIST_COSINE_SIMILARITY(a.u, b.u), 6) + 0.0 AS distance FROM d a, d b")
def pair_distances_pearson(spark, d):
    return graphs.pair_distances(vectors(spark, d), "pearson", digits=6)


@query(f"WITH {_DIST} SELECT a.cell AS src, b.cell AS dst, ROUND(1 - LIST_COSINE_SIMILARITY(a.t, b.t), 6) + 0.0 AS distance FROM d a, d b")
def pair_distances_spearman(spark, d):
    return graphs.pair_distances(vectors(spark, d), "spearman", digits=6)


@query(f"""WITH {EMB}, p AS (SELECT cell, vec[1] AS px, vec[2] AS py, vec[3] AS r, vec[4] AS g, vec[5] AS b FROM e), v AS (SELECT VAR_POP(r) AS r, VAR_POP(g) AS g, VAR_POP(b) AS b, GREATEST(STDDEV_POP(px), STDDEV_POP(py)) AS s FROM p),
z AS (SELECT cell, px, py, (p.r * v.r + p.g * v.g + p.b * v.b) / (v.r + v.g + v.b) AS z FROM p, v), q AS (SELECT cell, px, py, (z - AVG(z) OVER ()) / STDDEV_POP(z) OVER () * (SELECT s FROM v) * 0.5 AS z FROM z)
SELECT a.cell AS src, b.cell AS dst, ROUND(SQRT(POWER(a.px - b.px, 2) + POWER(a.py - b.py, 2) + POWER(a.z - b.z, 2)), 6) AS distance FROM q a, q b""")
def spagcn_distances(spark, d):
    obs = vectors(spark, d).select("cell", *(F.col("vec")[k].alias(c) for k, c in enumerate(("px", "py", "r", "g", "b"))))
    frame = transforms.colour_distance_graph(AnnotatedFrame(None, obs, None), ("r", "g", "b"), 0.5, digits=6)
    return frame.obsp["SpaGCNGraph"]


@query(f"""WITH {EMB}, p AS (SELECT cell, vec[1] AS px, vec[2] AS py, vec[1:32] AS m, vec[33:64] AS g FROM e), c AS (SELECT cell, px, py, m, LIST_TRANSFORM(g, lambda v: v - LIST_AVG(g)) AS g FROM p)
SELECT a.cell AS src, b.cell AS dst, ROUND(GREATEST(0, LIST_COSINE_SIMILARITY(a.m, b.m)) * LIST_COSINE_SIMILARITY(a.g, b.g), 6) + 0.0 AS weight FROM c a, c b WHERE SQRT(POWER(a.px - b.px, 2) + POWER(a.py - b.py, 2)) < 0.05""")
def morphology_weights(spark, d):
    v, half = vectors(spark, d), lambda a: F.slice("vec", a, 32).alias("vec")
    return graphs.morphology_weights(points(spark, d), 0.05, v.select("cell", half(1)), v.select("cell", half(33)), digits=6)


@query(f"WITH {_KNN.replace(' WHERE a.cell <> b.cell', '').replace('rank <= 10', 'rank <= 6')} SELECT src, dst, rank FROM k")
def heteronet_graph(spark, d):
    frame = AnnotatedFrame(None, vectors(spark, d).select("cell"), None, obsm={"CellPCA": vectors(spark, d)})
    return transforms.heteronet_graph(frame, 5).obsp["HeteronetGraph"].select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {X}, c AS (SELECT cell, SUM(value) AS s, COUNT(*) AS k FROM x GROUP BY 1), g AS (SELECT gene, SUM(value) AS s, COUNT(*) AS k FROM x GROUP BY 1) SELECT 'c:' || cell AS src, 'g:' || gene AS dst, ROUND(k * value / s, 6) AS weight FROM x JOIN g USING (gene) UNION ALL SELECT 'g:' || gene, 'c:' || cell, ROUND(k * value / s, 6) FROM x JOIN c USING (cell) UNION ALL SELECT 'c:' || cell, 'c:' || cell, 1.0 FROM c UNION ALL SELECT 'g:' || gene, 'g:' || gene, 1.0 FROM g")
def cell_feature_graph(spark, d):
    return transforms.cell_feature_graph(parts(spark, d)).uns["CellFeatureGraph"].select("src", "dst", *r6("weight"))


@query(f"WITH {_RADIUS}, e AS (SELECT src, dst, 1 / GREATEST(distance, 1e-12) AS w FROM r WHERE src <> dst), a AS (SELECT src, dst, w FROM e UNION ALL SELECT DISTINCT src, src, 1.0 FROM e), g AS (SELECT src, SUM(w) AS d FROM a GROUP BY 1) SELECT a.src, a.dst, ROUND(w / SQRT(u.d * v.d), 6) AS weight FROM a JOIN g u ON u.src = a.src JOIN g v ON v.src = a.dst")
def spatial_links_soft(spark, d):
    frame = AnnotatedFrame(None, points(spark, d), None)
    return transforms.spatial_links(frame, 0.05, "soft").obsp["stdgcnGraph"].select("src", "dst", *r6("weight"))


@query("SELECT c_mktsegment AS cell_type, COUNT(*) AS n FROM customer GROUP BY 1")
def label_frequency(spark, d):
    return stats.label_frequency(parts(spark, d).obs, "cell_type")


@query(f"WITH {X}, {CELLS}, t AS (SELECT cell, SUM(value) AS t FROM x GROUP BY 1), o AS (SELECT cell_type, COUNT(*) AS k FROM cells GROUP BY 1), s AS (SELECT c_custkey AS cell, c_mktsegment AS cell_type, COALESCE(t, 0) AS n_counts, (SELECT COUNT(*) FROM x WHERE x.cell = c_custkey) AS n_genes, DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM customer LEFT JOIN t ON cell = c_custkey) SELECT cell, cell_type, n_counts, n_genes, idx FROM s")
def annotated_cells(spark, d):
    config = {"type": "preprocessor", "pipeline": [{"type": "filter.cell", "target": "FilterCellsPlaceHolder"}, {"type": "misc", "target": "CelltypeTransform", "params": {"ct_key": "cell_type", "out": "idx"}}]}
    return Pipeline(config)(parts(spark, d)).obs.select("cell", "cell_type", "n_counts", "n_genes", F.col("idx").cast("long").alias("idx"))


@query()
def hvg_raw_batches(spark, d):
    f = brands(spark, d)
    return selection.by_raw_counts(f.x, f.obs, f.var, 10, batch="cell_type")


@query(f"""WITH {B}, {CELLS}, {BRANDS}, y AS (SELECT cell_type, gene, value FROM x JOIN cells USING (cell)), k AS (SELECT cell_type, COUNT(*) AS n FROM cells GROUP BY 1),
m AS (SELECT k.cell_type, g.gene, MAX(k.n) AS n, COALESCE(SUM(value), 0) / MAX(k.n) AS mean, COALESCE(SUM(value * value), 0) / MAX(k.n) AS q FROM k CROSS JOIN genes g LEFT JOIN y ON y.cell_type = k.cell_type AND y.gene = g.gene GROUP BY 1, 2),
t AS (SELECT cell_type, gene, mean, (q - mean * mean) * n / (n - 1) / mean AS dispersion FROM m),
b AS (SELECT t.*, LEN(LIST_FILTER(c.cuts, lambda v: v < mean)) AS bin FROM t JOIN (SELECT cell_type, QUANTILE_CONT(mean, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM t GROUP BY 1) c USING (cell_type)),
o AS (SELECT *, MEDIAN(dispersion) OVER (PARTITION BY cell_type, bin) AS mid FROM b), a AS (SELECT *, MEDIAN(ABS(dispersion - mid)) OVER (PARTITION BY cell_type, bin) AS mad FROM o),
z AS (SELECT *, (dispersion - mid) / NULLIF(mad, 0) AS normalized FROM a), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_type ORDER BY normalized DESC NULLS LAST, gene) AS place FROM z)
SELECT gene, ROUND(AVG(mean), 6) AS mean, ROUND(AVG(dispersion), 6) AS dispersion, ROUND(AVG(COALESCE(normalized, 0)), 4) AS normalized, SUM(CASE WHEN place <= 5 AND normalized IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS batches FROM r GROUP BY 1""")
def hvg_dispersion_batches(spark, d):
    f = brands(spark, d)
    got = selection.batch_dispersions(f.x, f.obs, f.var, 5, 5, "cell_ranger", "cell_type")
    return got.select("gene", *r6("mean", "dispersion"), F.round("normalized", 4).alias("normalized"), F.col("batches").cast("long").alias("batches"))


@query()
def weighted_feature_pca(spark, d):
    return transforms.weighted_pca(brands(spark, d), 8).obsm["WeightedFeaturePCA"]


@query()
def weighted_feature_svd(spark, d):
    return transforms.weighted_svd(brands(spark, d), 0.9).obsm["WeightedFeatureSVD"]


@query()
def pseudo_spots(spark, d):
    f = parts(spark, d)
    return spatial.pseudo_spots(f.x, f.obs, "cell_type", 300)[1]


@query(f"""WITH {B}, {CELLS}, {BRANDS}, {MOMENTS}, h AS (SELECT SUM(mean * mean * (variance - mean)) / SUM(POWER(mean, 4)) AS phi FROM m), f AS (SELECT cell, gene, LN(COALESCE(value, 0) + 1 / (2 * phi)) AS value FROM cells CROSS JOIN genes CROSS JOIN h LEFT JOIN x USING (cell, gene)),
t AS (SELECT cells.cell, COALESCE(LN(SUM(value)), 0) AS c FROM cells LEFT JOIN x USING (cell) GROUP BY 1), g AS (SELECT gene, REGR_SLOPE(value, c) AS s, REGR_INTERCEPT(value, c) AS i FROM f JOIN t USING (cell) GROUP BY 1)
SELECT cell, gene, ROUND(value - s * c - i, 5) AS value FROM f JOIN t USING (cell) JOIN g USING (gene)""")
def stabilized_residuals(spark, d):
    return transforms.stabilized_residuals(brands(spark, d)).layers["SpatialIDEFeature"].select("cell", "gene", F.round("value", 5).alias("value"))


# Mining of results: customers stand for runs, their balance for the score -----


@query("""WITH r AS (SELECT 'segment=' || c_mktsegment AS a, 'nation=' || c_nationkey AS b FROM customer WHERE c_acctbal >= (SELECT QUANTILE_CONT(c_acctbal, 0.8) FROM customer)), i AS (SELECT a AS items FROM r UNION ALL SELECT b FROM r UNION ALL SELECT LEAST(a, b) || ',' || GREATEST(a, b) FROM r)
SELECT items, COUNT(*) AS freq FROM i GROUP BY 1 HAVING COUNT(*) >= CEIL(0.05 * (SELECT COUNT(*) FROM r))""")
def frequent_choices(spark, d):
    runs = read(spark, d, "customer")[0].select(F.array(F.concat(F.lit("segment="), "c_mktsegment"), F.concat(F.lit("nation="), F.col("c_nationkey").cast("string"))).alias("items"), "c_acctbal")
    return results.frequent_choices(runs, "items", "c_acctbal", 0.2, 0.05).select(F.array_join(F.sort_array("items"), ",").alias("items"), "freq")


@query("WITH r AS (SELECT c_nationkey AS data, c_mktsegment AS method, c_acctbal AS score, c_custkey % 2 AS fresh FROM customer), o AS (SELECT data, method, MAX(score) AS score FROM r WHERE fresh = 0 GROUP BY 1, 2), n AS (SELECT data, method, MAX(score) AS score FROM r WHERE fresh = 1 GROUP BY 1, 2) SELECT data, method, GREATEST(o.score, n.score) AS score FROM o FULL JOIN n USING (data, method)")
def result_upsert(spark, d):
    runs = read(spark, d, "customer")[0].select(F.col("c_nationkey").alias("data"), F.col("c_mktsegment").alias("method"), F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("key"))
    half = lambda k: results.best_runs(runs.where(F.col("key") % 2 == k), ["data", "method"], "score").drop("key")
    return results.upserted(half(0), half(1), ["data", "method"], "score")


@query("WITH p AS (SELECT c_nationkey AS query, c_mktsegment AS atlas, AVG(c_acctbal) AS f, COUNT(*) AS k FROM customer GROUP BY 1, 2), s AS (SELECT query, atlas, 0.7 * f + 0.3 * k AS score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY 0.7 * f + 0.3 * k DESC, atlas) AS i FROM p) SELECT query, atlas, ROUND(score, 5) AS score FROM s WHERE i = 1")
def similarity_weight_choice(spark, d):
    pairs = read(spark, d, "customer")[0].groupBy(F.col("c_nationkey").alias("query"), F.col("c_mktsegment").alias("atlas")).agg(F.avg("c_acctbal").alias("feature"), F.count("*").cast("double").alias("metadata"))
    return results.weighted_choice(pairs, 0.7).select("query", "atlas", F.round("score", 5).alias("score"))
