"""Passages that a leader's other passages, stray phrases or edits used to hide."""

import random

import numpy as np
import pyarrow as pa

from cellweave.llm import substring


def run(spark, texts):
    """Rows by node order: which text leads is given by a hash of doc_id and text."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return substring.repeated_passages(docs).collect(), {r.doc_id: r.node for r in substring.keyed(docs).select("doc_id", "node").collect()}


def covers(rows, doc, start, end):
    return any(r.doc_id == doc and r.start_word <= start and r.end_word >= end for r in rows)


def make(seed):
    rng = random.Random(seed)
    return lambda n: ["u%d" % rng.randrange(100_000) for _ in range(n)]


def lead_first(spark, build, count=60):
    """The first trial whose text 0 leads, so that it is the leader of what it shares."""
    for seed in range(count):
        texts = build(make(seed))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        nodes = {r.doc_id: r.node for r in substring.keyed(docs).select("doc_id", "node").collect()}
        if nodes[0] == min(nodes.values()):
            return texts
    raise AssertionError("no trial")


def test_every_window_of_the_leader(spark):
    def build(text):
        p = text(80)
        return [" ".join(x) for x in (text(60) + p[20:64] + text(120) + p + text(60), text(70) + p + text(40))]

    texts = lead_first(spark, build)
    rows, _ = run(spark, texts)
    assert covers(rows, 1, 70, 150) and any(r.doc_id == 0 and r.start_word >= 200 for r in rows)


def test_settled_by_passage_not_by_pair(spark):
    text, texts = make(4), []
    for _ in range(80):
        licence, q = text(70), text(54)
        texts += [" ".join(x) for x in (text(60) + licence + text(60) + q[2:48] + text(60), text(60) + licence + text(50) + q + text(30), text(40) + licence + text(70) + q + text(60))]
    rows, _ = run(spark, texts)
    found = sum(covers(rows, k + 1, 182, 232) and covers(rows, k + 2, 182, 232) for k in range(0, len(texts), 3))
    print("second passages found", found, "of", len(texts) // 3)
    assert found >= 0.95 * len(texts) / 3


def test_edited_passages_against_brute_force(spark):
    text, rng, texts = make(5), random.Random(6), []
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for _ in range(400):
        p = text(50)
        q = list(p)
        q[rng.randrange(5, 45)] = text(1)[0]
        x, y = shingles(p), shingles(q)
        assert 100 * len(x & y) >= 80 * len(x | y)
        texts += [" ".join(text(50) + p + text(50)), " ".join(text(50) + q + text(50))]
    rows, _ = run(spark, texts)
    found = {(min(r.doc_id, r.class_id), max(r.doc_id, r.class_id)) for r in rows if r.doc_id != r.class_id}
    pairs = sum((k, k + 1) in found for k in range(0, len(texts), 2))
    print("pairs found", pairs, "of", len(texts) // 2)
    assert pairs >= 0.95 * len(texts) / 2


def test_bound_drops_unlike_pairs_and_no_passage():
    rng, pairs = np.random.default_rng(7), []
    for k in range(400):
        a = rng.integers(-(2**31), 2**31, int(rng.integers(0, 150)), dtype=np.int32)
        b = rng.integers(-(2**31), 2**31, int(rng.integers(0, 150)), dtype=np.int32)
        if k % 2:  # a stretch in common with misses, and in every other such pair repeats
            part = rng.integers(0, 12 if k % 4 == 1 else 1 << 30, int(rng.integers(30, 90)), dtype=np.int32)
            other = np.where(rng.random(len(part)) < rng.choice([0.0, 0.05, 0.15, 0.3]), -5, part).astype(np.int32)
            a, b = np.concatenate([a[:60], part, a[60:]]), np.concatenate([b[:30], other, b[30:]])
        pairs.append((a, b))
    flat = [substring.flat(pa.array([p[k] for p in pairs], pa.list_(pa.int32()))) for k in (0, 1)]
    kept = set(substring.possible(*flat[0], *flat[1], 46, 80).tolist())
    real = {k for k, (a, b) in enumerate(pairs) if substring.passages(a, b, 46, 80)}
    assert real <= kept and len(real) > 40 and not any(k % 2 == 0 for k in kept)
