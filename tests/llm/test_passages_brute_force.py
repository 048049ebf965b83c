"""The passage operator as a whole against all pairs of windows, and its hard shapes."""

import random
import time

import numpy as np
from cellweave.llm import substring


def shingles(words):
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def boxes(a, b, least=46):
    """How many shingles `least` places in a row of a and of b have in common, at most (distinct within a text).

    Places count whose first and last shingle in a are among the common ones.
    """
    place = {x: k for k, x in enumerate(b)}
    m = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for k, x in enumerate(a):
        if x in place:
            m[k + 1, place[x] + 1] = 1
    m = m.cumsum(0).cumsum(1)
    full = m[least:, least:] - m[:-least, least:] - m[least:, :-least] + m[:-least, :-least]
    at = np.array([place.get(x, -1) for x in a])
    apart = at[: len(full), None] - np.arange(full.shape[1])[None, :], at[least - 1 :, None] - np.arange(full.shape[1])[None, :]
    for d in apart:
        full = np.where((d >= 0) & (d < least), full, 0)
    return full.max()


def make(seed=12, n=90):
    rng = random.Random(seed)
    text = lambda n: ["p%d" % rng.randrange(50_000) for _ in range(n)]
    passages = [text(60 + 7 * k) for k in range(5)]
    licence = text(32)
    docs = []
    for k in range(n):
        body = text(rng.randrange(60, 140))
        if k % 3 == 0:
            p = list(passages[k % 5])
            for _ in range(k % 4):
                p[rng.randrange(len(p))] = text(1)[0]
            body[30:30] = p
        if k % 4 == 1:
            body[20:20] = licence  # shorter than a passage
        docs.append(body)
    docs += [docs[0], docs[3]]
    return docs


def test_documents_found_equal_brute_force(spark):
    docs = make()
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    rows = substring.repeated_passages(table).collect()
    sets = [shingles(w) for w in docs]
    want = set()
    for a in range(len(docs)):
        for b in range(len(docs)):
            if a != b and 100 * (n := int(boxes(sets[a], sets[b]))) >= 80 * (92 - n):
                want |= {a, b}
    assert want <= {r.doc_id for r in rows}
    for r in rows:
        x, y = set(shingles(docs[r.doc_id][r.start_word : r.end_word])), set(shingles(docs[r.class_id][r.class_start : r.class_end]))
        assert r.end_word - r.start_word >= 50 and (r.doc_id == r.class_id or 100 * len(x & y) >= 75 * len(x | y))
    assert not {r.doc_id for r in rows} & {k for k in range(90) if k % 3}


def test_repetitive_and_very_long_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**9)}" for _ in range(300_000)]
    line = [f"l{k}" for k in range(12)]
    texts = [" ".join(long), "a " * 100_000, "a " * 90_000, " ".join(line * 5000), " ".join(line * 4000), " ".join(long[150_000:150_080] + long[:10]), "", None, "short text"]
    began = time.time()
    rows = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert time.time() - began < 120
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5}
    assert any(r.doc_id in (0, 5) and r.end_word - r.start_word >= 80 for r in rows)


def test_windows_and_stretches_of_equal_hashes_are_linear():
    for n in (50_000, 200_000):
        began = time.time()
        assert len(substring.compact_windows(np.zeros(n, dtype=np.uint64), 46)) == n - 45
        periodic = np.tile(np.arange(40, dtype=np.uint64), n // 40)
        substring.compact_windows(periodic, 46)
        same = np.zeros(n, dtype=bool)
        same[::60] = True
        assert len(list(substring.dense(same, 0.2))) == len(range(0, n, 60))
        assert time.time() - began < 6


def test_bundles_hold_every_window():
    keys = np.array([5, 5, 5, 9], dtype=np.uint64)
    w = np.array([[0, 3, 900], [4, 10, 900], [11, 880, 900], [0, 7, 60]], dtype=np.int32)
    got_keys, got = substring.bundled(keys, w, 512)
    assert got_keys.tolist() == [5, 5, 9] and got.tolist() == [[0, 3, 10, 900], [11, 880, 880, 900], [0, 7, 7, 60]]
