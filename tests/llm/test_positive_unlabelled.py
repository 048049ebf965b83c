"""The class prior and the non-negative risk against plain versions; odd texts."""

import math

import numpy as np
from cellweave.llm import common, quality
from pyspark.sql import functions as F


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        u = np.concatenate([rng.normal(2, 1, int(6000 * share)), rng.normal(-2, 1, 6000 - int(6000 * share))])
        assert abs(quality.estimated_prior(p, u) - share) < 0.06


def test_prior_equals_plain():
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, 60).round(1), rng.normal(0, 1, 80).round(1)
    error = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(60) + 1 / math.sqrt(80))
    best = min((((u >= c).mean() + error) / (p >= c).mean(), c) for c in sorted({*p, *u}) if (p >= c).mean() >= 0.01)
    assert math.isclose(quality.estimated_prior(p, u), min(0.99, (u >= best[1]).mean() / (p >= best[1]).mean()))


def risk(w, model, p, u):
    zp, zu = model.design(p) @ w, model.design(u) @ w
    loss = lambda z: np.logaddexp(0, -z).mean()
    return model.prior * loss(zp) + max(0.0, np.logaddexp(0, zu).mean() - model.prior * np.logaddexp(0, zp).mean())


def test_fit_is_near_the_least_risk_of_random_models():
    rng = np.random.default_rng(6)
    p, u = rng.normal(1.5, 1, (400, 2)).astype(np.float32), np.vstack([rng.normal(1.5, 1, (600, 2)), rng.normal(-1.5, 1, (400, 2))]).astype(np.float32)
    m = quality.PositiveUnlabelled(p, u, 0.6, ridge=0.0)
    least = min(risk(rng.normal(0, 3, 3), m, p, u) for _ in range(3000))
    assert risk(m.weights, m, p, u) <= least + 0.03


def test_negative_labels_are_not_read_and_rows_may_repeat(spark):
    rng = np.random.default_rng(7)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
    bad = lambda: " ".join("".join(rng.choice(list("#$%&0123"), 5)) for _ in range(40))
    rows = [(k, good() if k % 3 else bad()) for k in range(300)] + [(400, "x" * 2_000_000), (401, None), (402, "")]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300, 2)], "doc_id long, quality int")
    held = common.bucket_of(F.col("doc_id"), 5) == 0
    score = lambda labels: sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, labels, held).collect())
    got = score(labels)
    assert got == score(labels.where("quality = 1")) and len(got) == 323
    by = dict(got)
    assert all(got.count((k, by[k])) == 2 for k in range(20)) and by[401] == by[402]
    assert np.mean([(by[k] >= 0.3) == (k % 3 > 0) for k in range(300)]) > 0.95
