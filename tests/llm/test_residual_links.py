"""The second pass over open bands, against all pairs, with blocks of a few classes."""

import itertools
import random

from cellweave.llm import common, minhash


def groups(texts, percent=85, n=3):
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in split]
    own = list(range(len(texts)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            own[b] = a
    return [root(k) for k in range(len(texts))]


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Copies with edits from a small vocabulary: most share bands, some link only by way of others."""
    rng = random.Random(4)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            words[rng.randrange(120)] = f"e{rng.randrange(12)}"
        texts.append(" ".join(words))
    plain = minhash.residual_links
    for block in (8, 4096):
        monkeypatch.setattr(minhash, "residual_links", lambda *a, block=block: plain(*a, block=block))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
        assert [got[k] for k in range(len(texts))] == groups(texts)


def test_one_of_each_with_clashing_names_and_maps(spark):
    rows = [(1, "a b c d", "x", {"k": 1}), (1, "a b c d", "x", {"k": 1}), (2, "a b c d", "y", None), (3, "q r s t", "z", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of string, place map<string, int>")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_by_many_tasks(spark):
    """Paths, stars and loops, with tasks of a few edges and with one task."""
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1001 + k) for k in range(30)] + [(5000, 5000)] + [(rng.randrange(6000, 6060), rng.randrange(6000, 6060)) for _ in range(40)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for size in (7, 1000):
        got = {r.node: r.component for r in common.connected_components(links, task_edges=size).collect()}
        assert got == {k: v for k, v in low.items() if k != 5000}
