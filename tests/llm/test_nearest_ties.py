"""Vectors of one direction tie, however many there are: the smaller ids win."""

import numpy as np
from cellweave.llm import ann
from pyspark.sql import functions as F


def test_equal_directions_go_by_id(spark):
    rng = np.random.default_rng(8)
    q = rng.normal(size=12).astype(np.float32)
    rows = [(k, [float(x) for x in q * np.float32(2.0 ** (k % 20 - 10))]) for k in range(60)]
    rows += [(100 + k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(400, 12)).astype(np.float32))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (16, 4096):
        got = ann.nearest(vectors, F.col("vec_id").isin(0, 50), list_size=64, block=block).collect()
        by = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
        assert by == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
