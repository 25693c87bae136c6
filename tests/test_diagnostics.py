"""The runs on other universes, the gate of the new features, and the guards before them."""

from dataclasses import replace
from datetime import date

import pytest

from barline.config import Research, Windows
from barline.operators import features as feat
from barline.plans import pipelines as pipe

CFG = Research(horizon=2, embargo=2, train_end=date(2024, 3, 1), test_start=date(2024, 3, 10))


def rows(spark, *values, horizon=None):
    schema = "rank_ic_mean double" + ("" if horizon is None else ", horizon int")
    return spark.createDataFrame([(v,) if horizon is None else (v, h) for v, h in zip(values, horizon or values)], schema)


def test_windows_are_fixed(bars):
    feat.check_windows(Windows())
    for matrix in (feat.production_matrix, feat.combined_matrix):
        with pytest.raises(ValueError):
            matrix(bars([1.0, 2.0]), Windows(rsi=10))


@pytest.mark.parametrize(("rank_ic", "want"), [(0.05, "breadth_noise"), (0.001, "features_dead"), (0.019, "inconclusive"), (None, "inconclusive")])
def test_breadth(spark, bars, monkeypatch, rank_ic, want):
    monkeypatch.setattr(pipe, "run_baseline", lambda b, cfg: pipe.BaselineResult(rows(spark, rank_ic), None, None, None, ""))
    asked = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    found = pipe.universe_breadth(bars([1.0, 2.0]), CFG, asked)
    assert (found.requested, found.kept, found.dropped_share, found.verdict) == (2, 1, 0.5, want)


def test_breadth_refuses(spark, bars):
    with pytest.raises(ValueError, match="horizon"):
        pipe.universe_breadth(bars([1.0]), replace(CFG, embargo=5))
    with pytest.raises(ValueError, match="beyond"):
        pipe.universe_breadth(bars([1.0]), CFG, spark.createDataFrame([("BBB",)], "symbol string"))
    with pytest.raises(ValueError, match="no bars"):
        pipe.universe_breadth(bars([1.0]).where("false"), CFG)


@pytest.mark.parametrize(("values", "want", "above"), [((0.03, 0.0), "candidate", [True, False]), ((0.01, None), "exhausted", [False, False]), ((0.02, 0.02), "candidate", [True, True])])
def test_small_cap(spark, bars, monkeypatch, values, want, above):
    def one(b, cfg, horizons, arms):
        assert arms == {"all_new": feat.NEW}
        return rows(spark, *values, horizon=horizons)

    monkeypatch.setattr(pipe, "triage", one)
    found = pipe.small_cap(bars([1.0, 2.0]), CFG)
    got = found.rows.orderBy("horizon").collect()
    assert found.verdict == want and [r.above for r in got] == above
    assert [r.broad_rank_ic for r in got] == [0.022127, 0.034849]
    with pytest.raises(ValueError):
        pipe.small_cap(bars([1.0]), CFG, horizons=(5,))


def test_gate_of_the_new_features(bars, monkeypatch):
    seen = {}
    monkeypatch.setattr(pipe, "overfitting_gate", lambda data, names, cfg, **k: seen.update(names=names, cfg=cfg, columns=data.columns, **k))
    own = bars([float(i) for i in range(1, 90)])
    pipe.all_new_gate(own, replace(CFG, embargo=9), variance=0.1, trials=25)
    assert seen["names"] == feat.NEW and (seen["n"], seen["k"], seen["cfg"].embargo) == (6, 2, 2)
    assert seen["trading"] is own and {"timestamp", "symbol", "label", *feat.NEW} <= set(seen["columns"])
    for wrong in (feat.NEW[:-1], feat.NEW[::-1], feat.PRODUCTION):
        with pytest.raises(ValueError):
            pipe.all_new_gate(own, CFG, variance=0.1, trials=25, names=wrong)
    with pytest.raises(ValueError):
        pipe.all_new_dataset(own, 0)


def test_null_resumes_after_a_failure(spark, tmp_path):
    from types import SimpleNamespace

    days = [(date(2024, 1, d), x, float(d * i)) for d in (1, 2) for i, x in enumerate("ABC")]
    data = spark.createDataFrame(days, "timestamp date, symbol string, label double").selectExpr("cast(timestamp as timestamp) timestamp", "symbol", "label")
    path, calls = str(tmp_path / "null"), []

    def run(dealt, fail_at=None):
        calls.append(sorted(r.label for r in dealt.collect()))
        if len(calls) == fail_at:
            raise RuntimeError("lost")
        return SimpleNamespace(deflated=SimpleNamespace(dsr=len(calls) / 10))

    with pytest.raises(RuntimeError):
        pipe.permutation_null(data, lambda d: run(d, 3), 42, 4, path=path)
    done = spark.createDataFrame(spark.read.parquet(path).collect(), "perm_id int, dsr double")
    assert sorted(map(tuple, done.collect())) == [(0, 0.1), (1, 0.2)]
    assert pipe.permutation_null(data, run, 42, 4, done, path) == [(2, 0.4), (3, 0.5)]
    assert spark.read.parquet(path).count() == 4
    assert all(c == [0.0, 0.0, 1.0, 2.0, 2.0, 4.0] for c in calls)


def test_baseline_saves_its_model(spark, bars, monkeypatch, tmp_path):
    from pyspark.ml.feature import SQLTransformer

    from barline.sources.artifacts import ArtifactStore

    fitted = []

    def scored(data, names, cfg):
        fitted.append(names)
        split = spark.createDataFrame([("train", 3), ("test", 2)], "role string, n long")
        scores = spark.createDataFrame([(date(2024, 3, 11), "AAA", 0.1, 0.2), (date(2024, 3, 11), "BBB", 0.2, 0.3)], "timestamp date, symbol string, score double, fwd double")
        return SQLTransformer(statement="SELECT 1 FROM __THIS__"), scores, split

    monkeypatch.setattr(pipe, "_scored", scored)
    store = ArtifactStore(spark, str(tmp_path))
    cfg = replace(CFG, min_breadth=2)
    found = pipe.run_baseline(bars([1.0, 2.0]), cfg, store=store)
    meta = store.metadata(found.model_hash, feat.PRODUCTION)
    assert (meta.universe, meta.seed) == (("AAA",), cfg.seed)
    body = store.read_sidecar(found.model_hash)
    assert body["split"] == [{"role": "train", "n": 3}, {"role": "test", "n": 2}]
    assert body["metrics"] == found.metrics.first().asDict()
    with pytest.raises(FileExistsError):
        pipe.run_baseline(bars([1.0, 2.0]), cfg, store=store)
    assert len(fitted) == 1
