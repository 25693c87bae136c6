import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import indicators as ind
from barline.functions.cross_section import cs_rank, cs_zscore
from barline.functions.ewm import Ewm, with_ewm
from barline.operators import features as feat
from barline.operators.corporate import adjust, check_actions


def walk(n, seed=1729):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0.0004, 0.012, n))))


def column(df, name):
    return [r[0] for r in df.orderBy("timestamp").select(name).collect()]


@pytest.mark.parametrize(("closes", "dividends", "splits", "want"), [([100, 102, 103, 104], {}, {2: 2.0}, [100, 102, 103, 104]), ([100, 99], {1: 1.0}, {}, [100, 100])])
def test_adjust_goldens(bars, closes, dividends, splits, want):
    assert column(adjust(bars(closes, dividends=dividends, splits=splits)), "adj") == pytest.approx(want)


def test_action_faults(bars):
    b = bars([100, None, -1, 4], dividends={3: -1.0})
    assert sorted(r.reason for r in check_actions(b.unionByName(b.limit(1))).collect()) == ["action", "duplicate", "missing close", "price"]


@pytest.mark.parametrize("length", [3, 40, 4000])
def test_ewm_matches_pandas(spark, bars, length):
    x = walk(length)
    s = pd.Series(x)
    specs = [Ewm.span("m9", "close", 9, 9), Ewm.span("s20", "close", 20, 2, std=True), Ewm.wilder("w14", "close", 14)]
    got = with_ewm(bars(x), specs).orderBy("timestamp").select("m9", "s20", "w14").toPandas()
    want = pd.DataFrame({"m9": s.ewm(span=9, adjust=False, min_periods=9).mean(), "s20": s.ewm(span=20, adjust=False, min_periods=2).std(), "w14": s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()})
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-7)


def test_rsi_of_rises_is_100(bars):
    df = feat.symbol_features(bars([100 + i for i in range(40)]))
    assert column(df, "rsi_14")[-1] == 100.0
    assert column(df, "gain_loss_ratio_14")[-1] is None


def test_reversal_golden(bars):
    df = bars([100, 101, 102, 103, 104, 110]).withColumn("x", ind.reversal(5))
    assert column(df, "x")[-1] == pytest.approx(-0.10)


def test_cross_section_goldens(spark):
    rows = [(0, "A", 1.0), (0, "B", 2.0), (0, "C", 3.0), (1, "A", 10.0), (1, "B", None), (1, "C", 12.0), (2, "A", 5.0)]
    df = spark.createDataFrame(rows, "timestamp int, symbol string, x double")
    out = {(r.timestamp, r.symbol): (r.k, r.z) for r in df.withColumns({"k": cs_rank("x"), "z": cs_zscore("x")}).collect()}
    assert [out[0, s][0] for s in "ABC"] == pytest.approx([1 / 3, 2 / 3, 1])
    assert out[1, "B"] == (None, None) and out[1, "A"][0] == 0.5 and out[1, "C"][0] == 1.0
    assert out[2, "A"] == (1.0, 0.0)
    assert out[0, "A"][1] == pytest.approx(-np.sqrt(1.5))


def test_later_rows_do_not_matter(bars):
    """Truncation and spike invariance of every feature."""
    x = walk(140)
    spiked = x[:100] + [v * 7 for v in x[100:]]
    frames = [feat.symbol_features(bars(v)).orderBy("timestamp").limit(100).toPandas() for v in (x[:100], x, spiked)]
    for other in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], other)


def test_registries():
    assert len(set(feat.COMBINED)) == 51
    assert feat.ARMS["new_plus_old"] == feat.PRODUCTION + feat.NEW


def test_vectors_drop_incomplete_rows(bars):
    df = feat.feature_vectors(bars([1, 2, 3]).withColumn("m", ind.momentum(1)), ("m", "close"))
    assert df.count() == 2
    assert df.select(F.size("features")).first()[0] == 2
