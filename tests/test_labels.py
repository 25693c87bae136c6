import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import indicators as ind
from barline.operators import labels as lab


def rows(df, *cols, by="timestamp"):
    return [tuple(r) for r in df.orderBy(by).select(*cols).collect()]


@pytest.mark.parametrize(("closes", "want"), [([100, 106, 90], 1), ([100, 94, 110], -1), ([100, 102, 101], 0)])
def test_triple_barrier_goldens(bars, closes, want):
    df = lab.barriers(bars(closes).withColumn("vol", F.lit(0.05)), vertical=2)
    assert rows(df, "label")[0][0] == want


@pytest.mark.parametrize(("closes", "want"), [([100, 106], 1), ([100, 94], 0)])
def test_meta_barrier_goldens(bars, closes, want):
    df = bars(closes).withColumns({"vol": F.lit(0.05), "side": F.lit(1.0)})
    assert rows(lab.barriers(df, vertical=1, side="side", full=True), "label") == [(want,)]


def test_last_bar_has_no_path(bars):
    df = lab.barriers(bars([100, 101]).withColumn("vol", F.lit(0.05)), vertical=3)
    last = df.orderBy(F.desc("timestamp")).first()
    assert (last.t1, last.ret, last.label) == (last.timestamp, 0.0, 0)


def test_cusum(bars):
    x = [100, 100, 100, 110, 110, 110]
    assert len(rows(lab.cusum_events(bars(x), 0.05), "direction")) == 1
    assert lab.cusum_events(bars([5] * 20), 0.05).count() == 0


def test_cusum_matches_a_loop(bars):
    rng = np.random.default_rng(5)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300)))
    p = n = 0.0
    want = []
    for i in range(1, len(x)):
        r = math.log(x[i] / x[i - 1])
        p, n = max(0.0, p + r), min(0.0, n + r)
        if p > 0.05:
            p = 0.0
            want.append((i, 1))
        elif n < -0.05:
            n = 0.0
            want.append((i, -1))
    got = lab.cusum_events(bars(list(x)), 0.05).orderBy("timestamp").collect()
    first = bars(list(x)).agg(F.min("timestamp")).first()[0]
    assert [((r.timestamp - first).days, r.direction) for r in got] == want


def test_label_pipeline_golden(bars):
    out = lab.label_pipeline(bars([100, 100.1, 100.2, 110, 110.1, 110.2]), threshold=0.02, vertical=2)
    r = out.first()
    assert out.count() == 1 and (r.t1 - r.t0).days == 2 and r.t0.day == 4


def test_sample_weights_golden(spark):
    from datetime import datetime

    d = lambda k: datetime(2024, 1, 1 + k)
    s = spark.createDataFrame([("A", d(0), d(4)), ("A", d(2), d(4))], "symbol string, t0 timestamp, t1 timestamp")
    assert [w for (w,) in rows(lab.sample_weights(s), "weight", by="t0")] == pytest.approx([0.7, 0.5])


def test_fracdiff_limits(bars):
    b = bars([1, 4, 9, 16])
    assert [v for (v,) in rows(b.withColumn("x", lab.fracdiff(b, d=0.0)), "x")] == [1, 4, 9, 16]
    assert [v for (v,) in rows(b.withColumn("x", lab.fracdiff(b, d=1.0)), "x")] == [None, 3, 5, 7]


def test_min_ffd_of_noise_is_zero(bars):
    rng = np.random.default_rng(0)
    r = lab.min_ffd_d(bars(list(100 + rng.normal(0, 1, 300))), thresh=1e-2).first()
    assert r.d == 0.0


def test_min_ffd_takes_the_series_as_given(bars):
    """A walk is not stationary as such; its logarithm, which may be, is not what is tested."""
    rng = np.random.default_rng(4)
    walk = 1000 + np.cumsum(rng.normal(0, 1, 400))
    found = lab.min_ffd_d(bars(list(walk)), thresh=1e-2).first().d
    tests = {round(i / 10, 1): lab.adf_pvalue(np.convolve(walk, lab.ffd_weights(i / 10, 1e-2), mode="valid")) for i in range(11)}
    assert found == min(d for d, p in tests.items() if p < 0.05) > 0
    growth = np.exp(np.cumsum(np.full(400, 0.05) + rng.normal(0, 0.001, 400)))
    with pytest.raises(Exception, match="stationary"):
        lab.min_ffd_d(bars(list(growth)), thresh=1e-2).collect()
    assert lab.min_ffd_d(bars(list(growth)), thresh=1e-2, missing="null").first().d is None


def test_events_that_no_barrier_fits_are_errors(bars):
    b = bars([100, 101, 103, 102, 104, 103])
    good = b.select("symbol", "timestamp").orderBy("timestamp").offset(3)
    assert lab.triple_barrier(b, good).count() == 3
    with pytest.raises(lab.LabelError, match="volatility"):
        lab.triple_barrier(b, b.select("symbol", "timestamp"))
    with pytest.raises(lab.LabelError, match="unknown"):
        lab.triple_barrier(b, good.selectExpr("symbol", "timestamp + interval 99 days as timestamp"))
    with pytest.raises(lab.LabelError, match="side"):
        lab.triple_barrier(b.selectExpr("*", "0.5 as side"), good, side="side")


def test_adf_separates_walk_and_noise():
    rng = np.random.default_rng(2)
    e = rng.normal(size=500)
    assert lab.adf_pvalue(e) < 0.01 < 0.1 < lab.adf_pvalue(np.cumsum(e))


def test_forward_returns(bars):
    df = lab.forward_returns(bars([100, 110, 121, 133.1]), 2)
    assert [v for (v,) in rows(df, "label")] == pytest.approx([0.21, 0.21])
    assert lab.short_symbols(bars([1, 2]), 2).count() == 1


def test_check_events(bars):
    b = bars([100, 101, 103, 102])
    events = b.select("symbol", "timestamp")
    assert lab.check_events(b, events).count() == 2  # no volatility before two returns


def test_trend_side(bars):
    df = bars([1] * 9 + [2, 1, 1.1]).withColumn("s", ind.trend_side(10))
    assert [v for (v,) in rows(df, "s")][8:] == [None, 1.0, -1.0, -1.0]
