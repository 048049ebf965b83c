"""The corpus pipeline against a plain version of its stages."""

import random

import corpus_pipeline
from cellweave.llm import secrets
from pyspark.sql import functions as F


def make(spark, folder):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["abc", "bcd", "cde", "dea", "eab"]) + str(rng.randrange(50)).translate(str.maketrans("0123456789", "fghijklmno")) for _ in range(n))
    items = [text(30) for _ in range(3)]
    rows = []
    for k in range(60):
        rows.append([k, text(120), "en" if k % 2 else None, f"s{k % 4}", 0])
    rows[5][1] = rows[4][1]
    rows[7][1] = rows[6][1] + " tail"
    rows[8][1] = text(40) + " " + items[1] + " " + text(20)
    rows[9][1] += " password = abcdefgh1234"
    rows[10][1], rows[11][1], rows[12][1] = None, "123 456", ""
    rows += [list(rows[20])]
    df = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    assert ids("language_id") == sorted([k for k in range(60) if k not in (10, 11, 12)] + [20])
    assert ids("near_dedup") == [k for k in range(60) if k not in (5, 7, 10, 11, 12)]
    assert ids("decontamination") == [k for k in range(60) if k not in (5, 7, 8, 10, 11, 12)]
    clean = {r.doc_id: r for r in seen["secret_scan"].collect()}
    assert all(r.text == secrets.redact_text(rows[k][1]) and r.n_chars == len(r.text) for k, r in clean.items()) and "[SECRET]" in clean[9].text
    packed = {r.doc_id: r.n for r in seen["packing"].groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert packed == {k: len(r.text.split()) for k, r in clean.items()}
    order = ["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_words"]
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select(*order).collect()) == sorted(seen["packing"].select(*order).collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through_stages(spark, docs, folder):
    """The columns and rows after each stage but the last, and the last stage's rows."""
    spark.createDataFrame([(0, "what holds the sky above the hills of the north")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(folder))
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        out.append(docs)
    return out


def test_stages_on_an_empty_table(spark, tmp_path):
    *first, last = through_stages(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and d.count() == 0 for d in first)
    assert last.count() == 0


def test_a_corpus_without_languages_is_kept(spark, tmp_path):
    rows = [(k, f"plain words number {'abcdefghij'[k]} of a small corpus", None, None, 9) for k in range(8)] + [(8, "12 34", None, None, 5), (None, "one without a name", None, None, 1)]
    *first, last = through_stages(spark, spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert sorted((r.doc_id is None, r.doc_id) for r in first[0].collect()) == [(False, k) for k in range(8)] + [(True, None)]
    assert last.count() == first[3].count() > 0


def test_stages_with_clashing_columns_and_long_texts(spark, tmp_path):
    names = ["score", "lang_pred", "has_letters", "whole", "_text", "of", "key", "place", "_id", "hit", "_hit", "before", "_before", "component_id", "shard", "size", "cluster"]
    long = " ".join(f"w{k % 9973}x{k}" for k in range(1_000_000))
    texts = ["a first text of a few words", "a second one that is quite another", long, long + " end", "what holds the sky above the hills of the north"]
    rows = [(k, t, "en", "s", len(t), *[k] * len(names), {"k": k}) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(f'`{n}` long' for n in names)}, more map<string, int>")
    *first, last = through_stages(spark, docs, tmp_path)
    assert all(d.columns == docs.columns for d in first)
    assert sorted(r.doc_id for r in first[3].select("doc_id").collect()) == [0, 1, 2]
    assert first[3].where("doc_id = 2").first().more == {"k": 2}
    assert {r.doc_id: r.n for r in last.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()} == {0: 7, 1: 7, 2: 1_000_000}
