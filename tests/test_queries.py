"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from cellweave.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Queries whose tables are larger than a quick test needs run in the driver's comparison.
CHECKED = sorted(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=str)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(([r[names.index(c)] for c in columns] for r in found.fetchall()), key=str)
    assert sorted(names) == columns and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-5 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from cellweave.streaming.stats import windowed_stats

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream, "ts", ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windowed")) == key(windowed_stats(batch, "ts", ["event_type"], "value"))
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == batch.count()
