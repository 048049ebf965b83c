"""The pipeline's near_dedup stage against brute force at 5 words and 0.8."""

import itertools
import random

import corpus_pipeline


def kept_by_brute_force(texts):
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in split]
    own = list(range(len(texts)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((root(a), root(b)))
            own[b] = a
    return [k for k in range(len(texts)) if root(k) == k]


def test_near_dedup_stage_equals_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "v%d" % rng.randrange(4000)
    texts = []
    for k in range(40):
        base = [word() for _ in range(104)]
        texts.append(base)
        texts.append(base + [word() for _ in range(16 + k % 12)])  # 0.79 to 0.86 at 5 words, below 0.85 at 3 for most
        texts.append([word() if i in (20, 40, 60, 80)[: 1 + k % 4] else w for i, w in enumerate(base)])  # scattered edits count more at 5 words
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == kept_by_brute_force(texts)
