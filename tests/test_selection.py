import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import graphs, selection, similarity, spatial
from cellweave.plans import results


def test_assignment_is_least_cost():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6)):
        for _ in range(20):
            c = rng.random((n, m))
            best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
            got = spatial.assignment(c)
            assert len(set(got)) == n and math.isclose(sum(c[i, j] for i, j in enumerate(got)), best)


def test_matching_by_batch(spark):
    rows = [(0, 1, 11, 5.0), (0, 1, 12, 4.9), (0, 2, 11, 5.0), (0, 2, 12, 0.0), (1, 3, 13, 1.0)]
    got = spatial.matched(spark.createDataFrame(rows, "batch long, a long, b long, score double"))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 12), (2, 11), (3, 13)}


def test_upsert_keeps_the_higher_score(spark):
    old = spark.createDataFrame([("d1", "m", 0.5, "u1"), ("d2", "m", 0.9, "u2"), ("d3", "m", None, "u3")], "data string, method string, score double, url string")
    new = spark.createDataFrame([("d1", "m", 0.7, "n1"), ("d2", "m", 0.8, "n2"), ("d3", "m", 0.1, "n3"), ("d4", "m", 0.2, "n4")], old.schema)
    got = {r.data: r.url for r in results.upserted(old, new, ["data", "method"], "score").collect()}
    assert got == {"d1": "n1", "d2": "u2", "d3": "n3", "d4": "n4"}


def test_missing_scores(spark):
    runs = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "m double")
    assert sorted(r.m for r in results.filled(runs, "m").collect()) == [0, 0, 1, 3]
    assert max(r.m for r in results.filled(runs, "m", higher=False).collect()) > 3
    assert results.matching_runs(runs, {"m": None}).count() == 1


def test_weights_and_costs(spark):
    pairs = spark.createDataFrame([("q", "a", 0.9, None), ("q", "b", 0.5, 1.0)], "query string, atlas string, feature double, metadata double")
    assert results.weighted_choice(pairs, 1.0).first().atlas == "a" and results.weighted_choice(pairs, 0.5).first().atlas == "b"
    ranks = spark.createDataFrame([("q", "a", "m1", 3), ("q", "b", "m1", 1), ("q", "b", "m2", 2)], "query string, atlas string, method string, rank int")
    assert results.rank_cost(results.weighted_choice(pairs, 1.0), ranks, 100).first().cost == 103


def test_dropout_offsets(spark):
    rows = [(c, g, float(2 ** (g + 1))) for g in range(4) for c in range(12 + g)]
    x = spark.createDataFrame(rows, "cell long, gene long, value double")
    got = {r.gene: r.offset for r in selection.dropout_offsets(x, 30).collect()}
    for g in range(4):
        z, m = 1 - (12 + g) / 30, g + 1
        assert math.isclose(got[g], m + math.log(z - 0.02) / 1.5)
        assert (z > math.exp(-1.5 * (m - 1.0)) + 0.02) == (got[g] > 1.0)


def test_clipped_variance_without_trend(spark):
    rng = np.random.default_rng(3)
    m = rng.poisson(3, (60, 30)).astype(float)
    x = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(30) if m[i, j]], "cell long, gene long, value double")
    got = {r.gene: r.score for r in selection.clipped_variances(x, spark.range(30).withColumnRenamed("id", "gene"), 60, 1.0).collect()}
    mean, var = m.mean(0), m.var(0, ddof=1)
    trend = np.sqrt(10 ** selection.loess(np.log10(mean), np.log10(var), 1.0))
    z = np.minimum((m - mean) / trend, math.sqrt(60))
    assert all(math.isclose(got[g], z[:, g].var(ddof=1), rel_tol=1e-6) for g in range(30))


def test_tail_and_kruskal(spark):
    z = spark.createDataFrame([(0.0,), (1.0,), (1.96,), (3.0,)], "z double").select(selection.two_sided(F.col("z")).alias("p"))
    assert all(abs(r.p - math.erfc(v / math.sqrt(2))) < 2e-7 for r, v in zip(z.collect(), (0, 1, 1.96, 3)))
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double")
    assert math.isclose(selection.kruskal(rows, "g", "v").first().h, 2.4)


def test_length_scale(spark):
    pts = spark.createDataFrame([(k, float(k % 10), float(k // 10)) for k in range(100)], "cell long, px double, py double")
    edges = graphs.within_radius(pts, 5.0)
    found = spatial.length_scale(edges, 100, 2.0, high=10.0)
    assert abs(spatial.row_mass(edges, 100, found).first().p - 2.0) < 1e-2


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(9)
    a, b = rng.random((12, 4)), rng.random((9, 4))
    make = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "cell long, vec array<double>")
    return a, b, make(a), make(b)


def test_similarities(two):
    a, b, da, db = two
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    cos = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert math.isclose(similarity.mean_cosine(da, db).first().similarity, cos.mean())
    assert math.isclose(similarity.mean_pairs(da, db, "distance"), d.mean())
    assert math.isclose(similarity.chamfer(da, db, 4), 1 - (d.min(1).mean() + d.min(0).mean()) / 2)
    assert math.isclose(similarity.hausdorff(da, db, 4), 1 - max(d.min(1).max(), d.min(0).max()) / 2)
    pearson = np.corrcoef(np.vstack([a, b]))[:12, 12:]
    assert math.isclose(similarity.mean_cosine(da, db, centred=True).first().similarity, pearson.mean())
    for f in (similarity.energy, similarity.discrepancy, similarity.spectral, similarity.sinkhorn):
        assert 0 < f(da, db) <= 1 and f(da, da) > f(da, db) - 1e-9
    assert abs(similarity.bures(da, da)) < 1e-3 and 0 <= similarity.mean_pairs(da, db, "js") <= 1 and 0 <= similarity.mean_pairs(da, db, "jaccard") <= 1
    assert similarity.metadata_similarity({"t": {"x"}, "n": 4}, {"t": {"x", "y"}, "n": 2}) == 0.5


def test_length_scale_equals_plain_bisection(spark):
    xy = np.concatenate([np.random.default_rng(3).random((300, 2)), np.full((20, 2), 0.5)])
    d = np.sqrt(((xy[:, None] - xy[None, :]) ** 2).sum(2))
    own = d[(d <= 0.3) & ~np.eye(len(xy), dtype=bool)]
    low, high = 1e-3, 1e3
    for _ in range(60):
        middle = (low + high) / 2
        p = np.exp(-(own**2) / (2 * middle**2)).sum() / len(xy)
        if abs(p - 3.0) <= 1e-3:
            break
        low, high = (middle, high) if p < 3.0 else (low, middle)
    pts = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(xy)], "cell long, px double, py double")
    edges = graphs.within_radius(pts, 0.3)
    assert edges._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    assert spatial.length_scale(edges, len(xy), 3.0) == middle
