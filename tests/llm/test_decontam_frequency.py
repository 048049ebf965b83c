"""Benchmark items are found however many documents hold them."""

import random

from cellweave.llm import decontam


def test_frequent_items_are_found(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    item = [f"q{k}" for k in range(15)]
    runs = [item[:5], item[6:8], item[9:11], item[12:14]]  # 3 trigrams intact, 11 of 15 words
    edited = " odd ".join(" ".join(r) for r in runs)
    short = "kq zx yv"
    texts = [f"{text(40)} {edited if k % 3 == 0 else text(3)} {text(10)} {short if k % 5 == 0 else 'kq zx'} {text(20)}" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(k, 1) for k in range(0, 60, 3)} | {(k, 2) for k in range(0, 60, 5)}
    assert all(s == 1 if i == 2 else 0.5 <= s < 0.7 for (_, i), s in got.items())


def test_long_items_and_texts_and_long_grams(spark):
    rng = random.Random(5)
    item = [f"q{rng.randrange(10**6)}" for _ in range(6000)]
    text = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    text[90_000:90_000] = item[:5500]
    docs = spark.createDataFrame([(0, " ".join(text)), (1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[20:32]))], "item_id long, text string")
    for n in (3, 7):
        got = {r.item_id: r for r in decontam.contaminated(docs, bench, n=n).collect()}
        assert set(got) == {1, 2} and got[2].score == 1
        assert (got[1].start_word, got[1].end_word) == (90_000, 95_500) and abs(got[1].score - 5500 / 6000) < 1e-9
