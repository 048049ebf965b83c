# Inputs and answers written out in these tests are fixed values.
import pytest
from pyspark.sql import functions as F

from cellweave.frame import AnnotatedFrame, split_ranges


@pytest.fixture(scope="module")
def frame(spark):
    x = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0), (2, 0, 2.0), (2, 1, 3.0)], "cell long, gene long, value double")
    obs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "cell long, kind string")
    var = spark.createDataFrame([(0, "g0"), (1, "g1")], "gene long, gene_name string")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (1, 1, 5.0)], "src long, dst long, weight double")
    return AnnotatedFrame(x, obs, var, obsp={"d": edges})


def cells(df):
    return sorted(r.cell for r in df.collect())


def test_split_sizes():
    assert split_ranges(3, "all") == {"train": (0, 3)}
    assert split_ranges(3, 2) == {"train": (0, 2), "test": (2, 3)}
    assert split_ranges(3, -1, 0, 1) == {"train": (0, 2), "test": (2, 3)}
    assert split_ranges(3, 1, 1) == {"train": (0, 1), "val": (1, 2), "test": (2, 3)}


@pytest.mark.parametrize("sizes,error", [(("1",), TypeError), ((-1,), ValueError), ((5,), ValueError), ((2, 2), ValueError)])
def test_bad_split_sizes(sizes, error):
    with pytest.raises(error):
        split_ranges(3, *sizes)


def test_ranges_may_overlap(frame):
    f = frame.with_split_ranges({"train": (0, 1), "ref": (0, 2), "inf": (2, 3)})
    assert [cells(f.split_cells(s)) for s in ("train", "ref", "inf")] == [[0], [0, 1], [2]]
    assert f.split_cells("none") is None
    with pytest.raises(KeyError):
        f.split_cells("none", error_on_miss=True)
    for bad in ((0, 1, 2), [0, 1], "01"):
        with pytest.raises(TypeError):
            frame.with_split_ranges({"train": bad})


def test_channels_of_a_split(frame):
    f = frame.with_split_sizes(2)
    assert cells(f.get_feature("train")) == [0, 1, 1]
    assert {(r.src, r.dst) for r in f.get_feature("train", "d", "obsp").collect()} == {(0, 1), (1, 1)}
    with pytest.raises(RuntimeError):
        f.get_x("none")


def test_config(frame):
    f = frame.set_config(label_channel="kind", label_channel_type="obs")
    assert [r.kind for r in f.get_y().orderBy("cell").collect()] == ["a", "b", "a"]
    with pytest.raises(KeyError):
        f.set_config(label_channel="other")
    with pytest.raises(KeyError):
        f.set_config(unknown=1)
    assert f.set_config(overwrite=True, label_channel="cell").config["label_channel"] == "cell"


def test_append_and_pop(spark, frame):
    shift = lambda df: df.withColumn("cell", F.col("cell") + 3)
    other = AnnotatedFrame(shift(frame.x), shift(frame.obs), frame.var).with_split_sizes(2)
    # split sizes, cells and batches here are fixed values
    assert "batch" not in frame.append(other).obs.columns
    both = frame.with_split_sizes(1).append(other, label_batch=True)
    assert cells(both.split_cells("train")) == [0, 3, 4] and cells(both.split_cells("test")) == [1, 2, 5]
    assert [r.batch for r in both.obs.orderBy("cell").collect()] == [0, 0, 0, 1, 1, 1]
    named = frame.with_split_sizes(1).append(other, mode="rename", rename={"train": "ref", "test": "inf"})
    assert cells(named.split_cells("ref")) == [3, 4]
    assert cells(frame.append(other, mode="new_split", new_split="ref").split_cells("ref")) == [3, 4, 5]
    mine = frame.with_split_sizes(1)
    with pytest.raises(KeyError):
        mine.append(other, mode="rename", rename={"train": "ref"})
    for options in ({"mode": "rename", "rename": {"train": "test", "test": "inf"}}, {"mode": "new_split", "new_split": "train"}, {"mode": "rename"}, {"mode": "new_split"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            mine.append(other, **options)
    with pytest.raises(TypeError):
        mine.append(other, mode="new_split", new_split=3)
    left = both.pop("train")
    assert cells(left.obs) == [1, 2, 5] and cells(left.split_cells("test")) == [1, 2, 5]


def test_mask(frame):
    assert cells(frame.filter_by_mask(F.col("kind") == "a").x) == [0, 2, 2]
