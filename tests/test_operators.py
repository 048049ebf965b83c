# Inputs and answers written out in these tests are fixed values.
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import features, filters, graphs, models, normalize, ordering, sampling, stats
from cellweave.functions import metrics


def long(spark, m):
    rows = [(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v]
    return spark.createDataFrame(rows, "cell long, gene long, value double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.cell, r.gene] = r.value
    return out


def axis(spark, n, name):
    return spark.range(n).withColumnRenamed("id", name)


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(123)
    return np.where(rng.random((20, 12)) < 0.4, 0, rng.integers(1, 9, (20, 12))).astype(float)


def test_normalize_total(spark):
    x = long(spark, [[1, 1, 1], [1, 1, 1], [3, 0, 0]])
    assert np.allclose(dense(normalize.total(x, 30, 0.99), (3, 3)), [[15, 15, 15], [15, 15, 15], [3, 0, 0]])
    assert np.allclose(dense(normalize.total(x, 30, 1.0), (3, 3)), [[10, 10, 10], [10, 10, 10], [30, 0, 0]])


def test_axis_modes(spark):
    x = long(spark, [[1, 1], [4, 4]])
    obs, var = x.select("cell").distinct(), x.select("gene").distinct()
    got = lambda mode, axis: dense(normalize.by_axis(x, mode, axis, obs=obs, var=var), (2, 2))
    assert np.allclose(got("normalize", "gene"), [[0.2, 0.2], [0.8, 0.8]])
    assert np.allclose(got("normalize", "cell"), 0.5)
    assert np.allclose(got("standardize", "gene"), [[-1, -1], [1, 1]]) and np.allclose(got("standardize", "cell"), 0)
    assert np.allclose(got("minmax", "gene"), [[0, 0], [1, 1]]) and np.allclose(got("minmax", "cell"), 0)
    with pytest.raises(ValueError):
        normalize.by_axis(x, "other")
    with pytest.raises(ValueError):
        normalize.by_axis(x, eps=-2)
    with pytest.raises(ValueError):
        normalize.by_axis(x, "minmax")


def test_shifted_zeros_are_entries(spark, counts):
    x, obs, var = long(spark, counts), axis(spark, 20, "cell"), axis(spark, 13, "gene")
    full = np.hstack([counts, np.zeros((20, 1))])
    spread = full.std(0)
    assert np.allclose(dense(normalize.by_axis(x, "standardize", obs=obs, var=var), full.shape), (full - full.mean(0)) / np.where(spread == 0, 1, spread))
    wide = full.max(1, keepdims=True) - full.min(1, keepdims=True)
    assert np.allclose(dense(normalize.by_axis(x, "minmax", "cell", obs=obs, var=var), full.shape), (full - full.min(1, keepdims=True)) / np.where(wide == 0, 1, wide))
    halves = obs.withColumn("half", (F.col("cell") % 2).cast("long"))
    want = np.zeros_like(full)
    for k in (0, 1):
        part = full[k::2]
        want[k::2] = (part - part.mean(0)) / np.where(part.std(0) == 0, 1, part.std(0))
    assert np.allclose(dense(normalize.by_axis(x, "standardize", group="half", obs=halves, var=var), full.shape), want)
    assert normalize.by_axis(x, "standardize", obs=obs, var=var).count() == full.size
    assert np.allclose(dense(normalize.total(x, 30, 0.4), counts.shape), excluded(counts, 30, 0.4))


def excluded(m, target, share):
    high = (m > share * m.sum(1, keepdims=True)).any(0)
    t = m[:, ~high].sum(1, keepdims=True)
    return m / np.where(t > 0, t / target, 1)


def test_gini_markers_keep_best_or_above_thresholds(spark):
    rng = np.random.default_rng(5)
    e, d, n = rng.random((3, 30)) * (rng.random((3, 30)) > 0.3), rng.random((3, 30)), [5, 9, 2]
    e[:, 29] = d[:, 29] = 0
    rows = lambda m: spark.createDataFrame([(t, g, float(m[t, g])) for t in range(3) for g in range(30) if m[t, g]], "type long, gene long, value double")
    got = {(r.type, r.gene): (r.score, r["rank"]) for r in filters.gini_markers(rows(e), rows(d), spark.createDataFrame(list(enumerate(n)), "type long, n long"), "type", genes=axis(spark, 30, "gene")).collect()}
    want = {}
    for t in range(3):
        others = [j for j in range(3) if j != t]
        score = np.ones(30)
        for m in (e, d):
            rest = sum(m[j] * n[j] for j in others) / sum(n[j] for j in others)
            score *= np.divide(np.abs(m[t] - rest), 2 * (m[t] + rest), out=np.zeros(30), where=m[t] + rest > 0) * np.where(m[t] > rest, 1, 0.1)
        order = sorted(range(30), key=lambda g: (-round(score[g], 12), g))
        for k, g in enumerate(order):
            if k < 5 or e[t, g] > 0.2 and d[t, g] > 0.2:
                want[t, g] = (score[g], k + 1)
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_log_and_tfidf(spark, counts):
    x = long(spark, counts)
    assert np.allclose(dense(normalize.log1p(x, 2), counts.shape), np.log2(1 + counts))
    want = counts / counts.sum(1, keepdims=True) * (len(counts) / counts.sum(0))
    assert np.allclose(dense(normalize.tfidf(x, 20), counts.shape), want)


def test_gene_stats(spark, counts):
    got = {r.gene: r for r in stats.gene_stats(long(spark, counts), axis(spark, 13, "gene"), 20).collect()}
    for g in range(12):
        v = counts[:, g]
        assert math.isclose(got[g].mu, v[v > 0].mean()) and math.isclose(got[g].alpha, (v > 0).mean())
        assert math.isclose(got[g].std_all, v.std()) and math.isclose(got[g].fano_all, v.var() / v.mean(), rel_tol=1e-9)
    assert got[12].mu is None and got[12].max_all == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.9, 1.0])
def test_padded_percentile(spark, counts, share):
    got = {r.gene: r.q for r in stats.padded_percentile(long(spark, counts), ["gene"], "value", 20, share).collect()}
    assert all(math.isclose(got[g], np.percentile(counts[:, g], share * 100), abs_tol=1e-9) for g in got)


def test_threshold_filters(spark, counts):
    x, genes = long(spark, counts), axis(spark, 12, "gene")
    want = {g for g in range(12) if counts[:, g].sum() >= 50 and (counts[:, g] > 0).sum() <= 14}
    assert {r.gene for r in filters.by_thresholds(x, "gene", genes, min_counts=50, max_entries=14).collect()} == want
    assert {r.gene for r in filters.in_order(x, "gene", genes, ["max_entries", "min_counts"], min_counts=50, max_entries=14).collect()} == want
    with pytest.raises(KeyError):
        filters.in_order(x, "gene", genes, ["other"])
    with pytest.raises(ValueError):
        filters.as_count(1.5, 10)


def test_common_genes(spark):
    x = spark.createDataFrame([("b", "y", 1.0), ("d", "x", 1.0), ("e", "y", 1.0)], "cell string, gene string, value double")
    obs = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 1), ("e", 1)], "cell string, batch int")
    assert [r.gene for r in filters.common_by_group(x, obs, "batch").collect()] == ["y"]


def test_names(spark):
    var = spark.createDataFrame([("MT-a",), ("mt-b",), ("c",), (None,)], "gene_name string")
    kept = lambda **kw: [r.gene_name for r in filters.by_name(var, ["MT-"], **kw).collect()]
    assert kept() == ["c", None] and kept(case_sensitive=True) == ["mt-b", "c", None]


def test_rank_sums(spark, counts):
    obs = axis(spark, 20, "cell").withColumn("label", (F.col("cell") % 2).cast("int"))
    got = {(r.label, r.gene): r.rank_sum for r in filters.rank_sums(long(spark, counts), obs, "label").collect()}
    for (label, g), s in got.items():
        v = counts[:, g]
        ranks = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        assert math.isclose(s, ranks[np.arange(20) % 2 == label].sum())


def test_nearest_and_radius(spark):
    rng = np.random.default_rng(1)
    m = rng.random((40, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "cell long, vec array<double>")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)) + np.eye(40) * 9
    got = {}
    for r in graphs.nearest(v, 4, block=16).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    assert all([x for _, x in sorted(got[i])] == list(np.argsort(d[i], kind="stable")[:4]) for i in range(40))
    p = spark.createDataFrame([(i, float(r[0]), float(r[1])) for i, r in enumerate(m)], "cell long, px double, py double")
    flat = np.sqrt(((m[:, None, :2] - m[None, :, :2]) ** 2).sum(2))
    assert {(r.src, r.dst) for r in graphs.within_radius(p, 0.2).collect()} == {(i, j) for i in range(40) for j in range(40) if flat[i, j] <= 0.2}


def test_moran(spark):
    rng = np.random.default_rng(3)
    m = rng.random((12, 2))
    e = [(i, (i + k) % 12, 1.0) for i in range(12) for k in (1, 3)]
    edges = spark.createDataFrame(e, "src long, dst long, weight double")
    got = {r.gene: r for r in graphs.moran(long(spark, m), edges, 12).collect()}
    for g in range(2):
        z = m[:, g] - m[:, g].mean()
        assert math.isclose(got[g].moran, 12 * sum(z[i] * z[j] for i, j, _ in e) / ((z * z).sum() * len(e)), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[g].geary, 11 * sum((z[i] - z[j]) ** 2 for i, j, _ in e) / (2 * (z * z).sum() * len(e)), rel_tol=1e-9)


def test_mask_is_a_partition(spark, counts):
    x = long(spark, counts)
    a = sampling.mask_cellwise(x, 0.3, seed=2, valid_share=0.1)
    assert a.count() == x.count() and sorted(map(tuple, a.collect())) == sorted(map(tuple, sampling.mask_cellwise(x, 0.3, seed=2, valid_share=0.1).collect()))
    for r in a.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("mask") != "train").alias("m"), F.count_if(F.col("mask") == "valid").alias("v")).collect():
        assert r.m == (math.floor(r.n * 0.3) if r.n > 5 else 0) and r.v == (1 if r.m else 0)


def test_pseudo_mixture(spark, counts):
    x = long(spark, counts)
    obs = axis(spark, 20, "cell").withColumn("label", (F.col("cell") % 3).cast("string"))
    sums, share = sampling.pseudo_mixture(x, obs, "label", 30, 2, 4, 1)
    assert all(math.isclose(r.s, 1) for r in share.groupBy("cell").agg(F.sum("share").alias("s")).collect()) and share.select("cell").distinct().count() == 30


def test_positions(spark):
    df = spark.range(50).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1000)))
    rows = ordering.with_position(df, "v", "id").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(50)) and [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_pca(spark, counts):
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(counts)], "cell long, vec array<double>")
    z = counts - counts.mean(0)
    s = np.linalg.svd(z, compute_uv=False)
    assert np.allclose(features.spectrum(v), s)
    got = np.array([r.vec for r in features.projected(v, 3).orderBy("cell").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3])


def test_metrics(spark):
    df = spark.createDataFrame([([0, 1], 1), ([2], 1), ([1], 1), ([0], 0)], "true array<int>, pred int")
    assert metrics.accuracy(df).first().acc == 0.75
    same = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(12)], "true int, pred int")
    assert metrics.adjusted_rand(same).first().ari == 1 and math.isclose(metrics.mutual_information(same).first().nmi, 1)
    one = spark.createDataFrame([(0, 0), (0, 0)], "true int, pred int")
    assert metrics.adjusted_rand(one).first().ari == 1


def test_nonnegative_weights():
    rng = np.random.default_rng(0)
    p, w = rng.random((30, 4)), np.array([0.5, 0.0, 2.0, 0.0])
    assert np.allclose(models.nonnegative_weights(p, p @ w), w, atol=1e-6)


def test_louvain_finds_two_cliques(spark):
    e = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(5) for b in range(a + 1, 5)] + [(4, 10, 1.0)]
    labels = {r.cell: r.label for r in graphs.louvain(spark.createDataFrame(e, "src long, dst long, weight double"), 6).collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(10, 15)}) == 1


def test_similarity_runs(spark, counts):
    from cellweave.frame import AnnotatedFrame
    from cellweave.operators import similarity, transforms

    f = AnnotatedFrame(long(spark, counts), axis(spark, 20, "cell"), axis(spark, 12, "gene"))
    halves = [f.keep_cells(f.obs.where(f"cell % 2 = {k}")) for k in (0, 1)]
    a, b = similarity.prepared(*halves, n_top_genes=8, min_counts=1)
    genes = sorted(r.gene for r in a.var.select("gene").collect())
    assert genes == sorted(r.gene for r in b.var.select("gene").collect()) and 0 < len(genes) <= 8
    x, y = transforms.dense(a), transforms.dense(b)
    got = similarity.similarities(x, y, ["cosine", "chamfer"], len(genes), n_runs=2, sample_size=6)
    runs = [[similarity.VECTOR_METHODS[m](similarity.sampled(x, 6, k), similarity.sampled(y, 6, k), len(genes)) for k in (0, 1)] for m in ("cosine", "chamfer")]
    assert np.allclose([got["cosine"], got["chamfer"]], np.mean(runs, axis=1))
    with pytest.raises(ValueError):
        similarity.similarities(x, y, ["other"], 3)


def test_distance_tables_are_not_dealt_out(spark):
    v = spark.range(300).select(F.col("id").alias("cell"), F.array(*(F.sin(F.col("id") * (k + 1)) for k in range(12))).alias("vec"))
    x = np.array([r.vec for r in v.orderBy("cell").collect()])
    out = graphs.pair_distances(v, block=64, digits=6)
    meet = out._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")
    assert len(meet) > 1 and "cogroup" not in meet[0].lower() and "Exchange" not in meet[0]
    got = {(r.src, r.dst): r.distance for r in out.collect()}
    far = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
    assert len(got) == 300 * 300 and max(abs(got[i, j] - far[i, j]) for i in range(300) for j in range(300)) < 5.1e-7


def test_close_and_equal_vectors_far_from_the_origin(spark):
    rows = [(k, [1e6 + k * 1e-4] * 12) for k in range(4)] + [(4, [1e6] * 12)]
    got = {(r.src, r.dst): r.distance for r in graphs.pair_distances(spark.createDataFrame(rows, "cell long, vec array<double>")).collect()}
    assert got[0, 4] == 0.0 and abs(got[0, 3] - 3e-4 * 12**0.5) < 1e-8


def test_morphology_of_null_and_constant_vectors(spark):
    p = spark.createDataFrame([(k, 0.0, 0.1 * k) for k in range(4)] + [(4, None, 0.0)], "cell long, px double, py double")
    m = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0, None]), (4, [1.0, 0.0])], "cell long, vec array<double>")
    g = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "cell long, vec array<double>")
    out = graphs.morphology_weights(p, 0.25, m, g)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.src, r.dst): r.weight for r in out.collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(4) if abs(i - j) < 3}
    assert abs(got[0, 1] - 0.5**0.5) < 1e-12 and got[0, 2] == 0.0 and got[3, 2] == 0.0 and abs(got[1, 1] - 1) < 1e-12


def test_many_points_at_one_place_come_in_blocks(spark):
    p = spark.range(1500).select(F.col("id").alias("cell"), F.lit(0.5).alias("px"), F.when(F.col("id") < 1400, 0.5).otherwise(F.col("id") * 1.0).alias("py"))
    out = graphs.within_radius(p, 0.25)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1400 * 1400 + 100 and graphs.within_radius(p, 0.25, itself=False).count() == 1400 * 1399


def test_nearest_hands_on_no_rows_of_single_blocks(spark):
    x = np.concatenate([np.random.default_rng(4).integers(0, 3, (700, 3)).astype(float), np.ones((200, 3))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell long, vec array<double>")
    out = graphs.nearest(v, 6, block=16)
    top = out._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[0]
    assert "Exchange" not in top and "CoGroup" not in top
    far = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    want = {(i, n + 1): (int(j), far[i, j]) for i in range(900) for n, j in enumerate(np.lexsort((np.arange(900), far[i]))[:6])}
    for block in (16, 8192):
        assert {(r.src, r.rank): (r.dst, r.distance) for r in graphs.nearest(v, 6, block=block).collect()} == want
