import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import metrics as met
from barline.operators import trials
from barline.plans import pipelines as pipe


@pytest.mark.parametrize(("n", "want"), [(100, 0.9004), (46, 0.9505)])
def test_deflated_sharpe_published_example(n, want):
    d = met.deflated_sharpe(2.5 / math.sqrt(250), 1250, -3, 10, 0.5 / 250, n)
    assert d.dsr == pytest.approx(want, abs=5e-4)


def test_far_tail_is_not_zero():
    assert 0 < met.phi(-22.5) < 1e-100


def test_trial_variance(spark):
    assert trials.variance(trials.trials(spark)) == pytest.approx(0.098142, abs=1e-6)
    assert len(trials.TRIAL_SHARPES) == trials.N_TRIALS


def test_classification_golden(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1, 0], [1, 0, 0, 1, 1, 0])), "label int, predicted int")
    r = met.classification(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert (r.precision, r.recall, r.f1, r.lift) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 4 / 3))


def test_accepted_bets(spark):
    rows = [(1, 0.9, 0.02), (1, 0.1, -0.01), (2, 0.6, 0.03), (2, 0.7, -0.04), (3, 0.1, 1.0)]
    out = met.accepted_returns(spark.createDataFrame(rows, "timestamp int, proba double, ret double"))
    assert [r.strategy_return for r in out.orderBy("timestamp").collect()] == pytest.approx([0.02, -0.005, 0.0])


def test_merge_paths(spark):
    rows = [(0, 2, 0.01), (0, 3, 0.02), (1, 3, 0.04), (1, 4, 0.03)]
    out = met.merge_paths(spark.createDataFrame(rows, "fold_id int, timestamp int, strategy_return double"))
    assert [r.strategy_return for r in out.orderBy("timestamp").collect()] == pytest.approx([0.01, 0.03, 0.03])


def test_constant_returns_have_no_sharpe(spark):
    df = spark.createDataFrame([(0.1,)] * 3, "strategy_return double")
    with pytest.raises(ValueError, match="no variance"):
        met.deflated_from_returns(df, 0.1, 25)


def test_ic_of_signal_and_noise(spark):
    rng = np.random.default_rng(0)
    rows = [(t, f"S{s}", x, x + e, z) for t in range(40) for s in range(5) for x, e, z in [(float(rng.normal()), float(rng.normal(0, 0.05)), float(rng.normal()))]]
    df = spark.createDataFrame(rows, "timestamp int, symbol string, score double, fwd double, noise double")
    assert met.ic_summary(met.ic_by_date(df)).first().ic_mean > 0.5
    assert abs(met.ic_summary(met.ic_by_date(df.withColumn("score", F.col("noise")))).first().ic_mean) < 0.2


def test_permutation_keeps_dates_and_depends_on_the_seed(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("timestamp"), F.concat(F.lit("S"), F.col("id")).alias("symbol"), F.col("id").cast("double").alias("label"))
    a, b, c = (sorted(map(tuple, met.permute_within_dates(d, 7, p).collect())) for d, p in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert a == b != c
    assert sorted((t, v) for t, _, v in a) == sorted((r.timestamp, r.label) for r in df.collect())


@pytest.mark.parametrize(("real", "q95", "want"), [(0.96, 0.1, "JA"), (0.5, 0.1, "NEIN"), (0.99, 0.95, "NEIN")])
def test_corrected_verdict(real, q95, want):
    assert met.corrected_verdict(real, q95) == want


def test_verdict_rules():
    assert [pipe.breadth_verdict(x) for x in (0.04, 0.001, 0.019)] == ["breadth_noise", "features_dead", "inconclusive"]
    assert [pipe.small_cap_verdict(x) for x in ((0.01, 0.015), (0.01, 0.025))] == ["exhausted", "candidate"]
    assert [pipe.momentum_verdict(x) for x in ((0.03, 0.04), (0.03, -0.04), (0.01, 0.015), (), (-0.03, -0.04), (0.03, None))] == ["JA"] + ["NEIN"] * 5


def test_candidates_need_every_horizon(spark):
    rows = [("a", 2, 0.03), ("a", 21, 0.02), ("b", 2, 0.5), ("c", 2, 0.03), ("c", 21, 0.01), ("d", 2, 0.03), ("d", 21, None), ("e", 63, 0.9)]
    out = pipe.triage_candidates(spark.createDataFrame(rows, "arm string, horizon int, rank_ic_mean double"))
    assert {r.arm for r in out.collect() if r.candidate} == {"a"}
    assert out.count() == 5


def test_path_sharpe(spark):
    import datetime as dt

    values = {0: [0.1, 0.2, 0.3], 1: [0.0, -0.1, 0.2]}
    rows = [(f, dt.datetime(2024, 1, 1 + i), v) for f, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "fold_id int, timestamp timestamp, strategy_return double")
    own = [np.mean(v) / np.std(v, ddof=1) for v in values.values()]
    got = pipe.GateResult(df, df, None).path_sharpe().first()
    assert (got["mean"], got["std"]) == pytest.approx((np.mean(own), np.std(own, ddof=1)))
    assert pipe.GateResult(df.where("fold_id = 0"), df, None).path_sharpe().first()["std"] == 0.0


def test_gate_refuses_rows_without_a_label_end(spark, bars):
    from pyspark.sql import functions as F

    from barline.config import Research

    b = bars([float(x) for x in range(1, 41)])
    data = b.select("timestamp", "symbol", F.lit(0.1).alias("label"), F.lit(1.0).alias("x"))
    with pytest.raises(Exception, match="label end"):
        pipe.overfitting_gate(data, ("x",), Research(horizon=5, embargo=5), variance=0.1, trials=2)


def test_align_and_report(spark):
    from barline.config import Settings
    from barline.plans import report

    data = spark.createDataFrame([(1, "A"), (2, "A")], "timestamp int, symbol string")
    bets = spark.createDataFrame([(1, "A", 0.5)], "timestamp int, symbol string, ret double")
    with pytest.raises(ValueError, match="at 2"):
        met.align_returns(data, bets)
    assert met.align_returns(data.where("timestamp = 1"), bets).first().ret == 0.5
    rows = spark.createDataFrame([("all", 0.25, None)], "arm string, ic double, icir double")
    assert report.results_table(rows, ["arm"], ["ic", "icir"]).first().line.split() == ["all", "0.250000", "n/a"]
    assert report.for_horizon(Settings(), 2).research.embargo == 2
    assert "pyspark" in report.library_versions()
