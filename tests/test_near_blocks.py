"""Exact neighbours from near blocks only, and doublet scores from one row a cell."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.frame import AnnotatedFrame
from cellweave.operators import graphs, normalize, selection, transforms


def test_far_blocks_do_not_meet(spark):
    g = np.random.default_rng(5)
    x = g.normal(size=(1200, 3)) + 100 * (np.arange(1200) % 4)[:, None]
    x[900:] = x[:300]  # equal vectors: ties go to the smaller cell
    x[7, 1] = np.nan
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell long, vec array<double>")
    out = graphs.nearest(v, 5, block=64)
    plan = out._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    sides = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.children().apply(k)).count() for k in (0, 1)]
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan).count() < 0.5 * sides[0] * sides[1]
    far = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    far[np.isnan(far)] = np.inf
    want = {(i, n + 1): (int(j), far[i, j]) for i in range(1200) if i != 7 for n, j in enumerate(np.lexsort((np.arange(1200), far[i]))[:5])}
    assert {(r.src, r.rank): (r.dst, r.distance) for r in out.collect()} == want


def test_rows_normalise_as_entries_do(spark):
    x = spark.createDataFrame([(0, "a", 3.0), (0, "c", 1.0), (1, "b", 2.0), (3, "c", 5.0), (3, "a", None)], "cell long, gene string, value double")
    f = AnnotatedFrame(x, spark.range(4).withColumnRenamed("id", "cell"), spark.createDataFrame([(c,) for c in "abc"], "gene string"))
    entries = transforms.entries(f)
    both = entries.unionByName(entries.where("cell = 0").select(F.lit(9).cast("long").alias("cell"), F.concat("i", "i").alias("i"), F.concat("v", "v").alias("v")))
    for target in (100.0, None):
        plain = f.replace(x=normalize.total_log1p(x.where("value is not null"), 100.0 if target else 4.0, 1.0))
        want = {r.cell: r.vec for r in transforms.dense(plain).collect()}
        got = {r.cell: r.vec for r in transforms.normalized_rows(entries, 3, target).collect()}
        assert set(got) == set(want) and all(np.allclose(got[c], want[c], rtol=1e-14) for c in want) and got[2] == [0.0] * 3
    twice = {r.cell: r.vec for r in transforms.normalized_rows(both, 3, 100.0).collect()}
    assert np.allclose(twice[9], twice[0], rtol=1e-14)


def test_doublets_are_sums_of_rows(spark):
    g = np.random.default_rng(2)
    counts = g.poisson(4, (30, 6)).astype(float)
    counts[4] = 0.0
    x = spark.createDataFrame([(c, k, float(counts[c, k])) for c in range(30) for k in range(6) if counts[c, k]], "cell long, gene long, value double")
    f = AnnotatedFrame(x, spark.range(30).withColumnRenamed("id", "cell"), spark.range(6).withColumnRenamed("id", "gene"))
    seen = {}

    def made(rows):
        seen["rows"] = {r.cell: (r.i or [], r.v or []) for r in rows.collect()}
        return transforms.normalized_rows(rows, 6, 1e4)

    scores = {r.cell: r.score for r in selection.doublet_scores(transforms.entries(f), made, k=3).collect()}
    dense = {c: np.bincount(np.array(i, int), v, minlength=6) for c, (i, v) in seen["rows"].items()}
    assert set(dense) == set(range(-60, 30)) and all((dense[c] == counts[c]).all() for c in range(30))
    sums = {tuple(counts[p] + counts[q]) for p in range(30) for q in range(30)}
    assert all(tuple(dense[-1 - t]) in sums for t in range(60))
    ids = np.array(sorted(dense))
    vec = np.array([np.log1p(dense[c] / (dense[c].sum() / 1e4 or 1.0)) for c in ids])
    for c in range(30):
        far = np.sqrt(((vec - vec[ids == c]) ** 2).sum(1))
        far[ids == c] = np.inf
        q = ((ids[np.lexsort((ids, far))[:9]] < 0).sum() + 1) / 11
        assert abs(scores[c] - q * 0.06 / 2 / (1 - 0.06 - q * (1 - 0.06 - 0.03))) < 1e-12
