import pytest

from cellweave.frame import AnnotatedFrame
from cellweave.operators import transforms  # noqa: F401
from cellweave.plans.pipeline import SKIP, Action, Pipeline, PipelinePlanner, dump_config, flatten, load_config, subsets, top_configs
from cellweave.registry import Registry
from cellweave.sources.readers import cached, read_edges, read_gmt


def test_registry():
    r = Registry()
    r.set("a", 1)
    r.set("b.c", 2)
    assert list(r.children()) == ["a", "b.c"] and list(r.children(leaf_only=False)) == ["a", "b", "b.c"]
    with pytest.raises(KeyError):
        list(r.children("a"))
    with pytest.raises(KeyError):
        r.set("a", 3)
    r.set("a", 3, overwrite=True)
    assert r.get("a") == 3 and r.get("z", None) is None


@pytest.fixture(scope="module")
def frame(spark):
    x = spark.createDataFrame([(c, g, float(c + g)) for c in range(6) for g in range(4) if c + g], "cell long, gene long, value double")
    return AnnotatedFrame(x, spark.range(6).withColumnRenamed("id", "cell"), spark.range(4).withColumnRenamed("id", "gene"))


CHAIN = {"type": "preprocessor", "pipeline": [{"type": "filter.gene", "target": "FilterGenesTopK", "params": {"num_genes": 2, "mode": "sum"}}, {"type": "normalize", "target": SKIP}, {"type": "normalize", "target": "NormalizeTotal", "params": {"target_sum": 1.0, "max_fraction": 1.0}}]}


def test_pipeline_runs_and_skips(frame):
    p = Pipeline(CHAIN)
    out = p(frame)
    assert {r.gene for r in out.var.collect()} == {2, 3} and len(list(p)) == 2 and len(p) == 3
    assert all(abs(r.s - 1) < 1e-9 for r in out.x.groupBy("cell").sum("value").withColumnRenamed("sum(value)", "s").collect())
    assert Pipeline(p.to_dict()).to_dict() == p.to_dict()
    with pytest.raises(KeyError):
        Pipeline({"pipeline": [], "params": {"a": 1}})


def test_planner(frame):
    config = {"type": "preprocessor", "tune_mode": "pipeline", "pipeline": [
        {"type": "normalize", "include": ["Log1P", "NormalizeTotal"], "skippable": True, "default_params": {"NormalizeTotal": {"max_fraction": 1.0}}},
        {"type": "filter.gene", "target": "FilterGenesTopK", "params": {"num_genes": 3}},
    ]}
    p = PipelinePlanner(config)
    assert p.search_space() == {"pipeline.0.normalize": {"values": ["Log1P", "NormalizeTotal", SKIP]}}
    made = p.generate(["NormalizeTotal", None])
    assert made["pipeline"][0] == {"type": "normalize", "target": "NormalizeTotal", "params": {"max_fraction": 1.0}}
    with pytest.raises(ValueError):
        p.generate(["tfidfTransform", None])
    with pytest.raises(ValueError):
        p.generate(["Log1P", None], [{"unknown": 1}, {}])
    best = p.run(frame, lambda f: f.x.agg({"value": "sum"}).first()[0])
    assert len(best) == 3 and best[0][0] >= best[-1][0]


def test_params_mode():
    p = PipelinePlanner({"tune_mode": "params", "pipeline": [{"type": "filter.gene", "target": "FilterGenesTopK", "params_to_tune": {"num_genes": {"values": [1, 2]}}}]})
    assert p.search_space() == {"params.0.FilterGenesTopK.num_genes": {"values": [1, 2]}}
    assert [c["pipeline"][0]["params"] for c in p.grid()] == [{"num_genes": 1}, {"num_genes": 2}]


def test_helpers(tmp_path):
    assert flatten({"a": {"b": [1, 2]}, "c": {}}) == {"a.b.0": 1, "a.b.1": 2, "c": {}}
    assert len(subsets({"pipeline": [{}, {}, {}]}, required=(0,))) == 4
    assert top_configs([{"m": 1}, {"m": None}, {"m": 3}], "m", 1) == [{"m": 3}]
    dump_config({"a": 1}, tmp_path / "c.yaml")
    assert load_config(tmp_path / "c.yaml") == {"a": 1}
    with pytest.raises(FileExistsError):
        dump_config({}, tmp_path / "c.yaml", "error")


def test_sources(spark, frame, tmp_path):
    (tmp_path / "s.gmt").write_text("p1\tnote\ta\tb\np2\tnote\tc\n")
    assert {tuple(r) for r in read_gmt(spark, str(tmp_path / "s.gmt")).collect()} == {("p1", "a"), ("p1", "b"), ("p2", "c")}
    (tmp_path / "e.txt").write_text("a b\nb c 3\n")
    w = {(r.src, r.dst): r.weight for r in read_edges(spark, str(tmp_path / "e.txt")).collect()}
    assert w[("a", "a")] == 0.5 and abs(w[("b", "c")] - 0.6) < 1e-9
    calls = []
    load = lambda: calls.append(1) or frame
    for redo in (False, False, True):
        out = cached(spark, str(tmp_path / "cache"), "toy", load, CHAIN, redo=redo)
        assert out.num_genes == 2
    assert len(calls) == 2


def test_configs_import_allowed_modules_only():
    with pytest.raises(PermissionError):
        Action(type="misc", target="system", scope="os").functional
    assert Action(type="misc", target="compose", scope="cellweave.operators.transforms").functional
