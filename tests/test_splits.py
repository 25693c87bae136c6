from datetime import date, datetime
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.config import Research, Settings, build, business_day
from barline.operators import splits as spl


def panel(spark, days, symbols=("A", "B")):
    return spark.createDataFrame([(s, d.to_pydatetime()) for s in symbols for d in days], "symbol string, timestamp timestamp")


@pytest.fixture
def holiday(spark):
    days = [d for d in pd.bdate_range("2022-12-01", "2023-01-31") if d != pd.Timestamp("2023-01-02")]
    return panel(spark, days)


def test_bar_gap_golden(holiday):
    with pytest.raises(spl.SplitError, match="bar gap 5"):
        spl.embargo_split(holiday, date(2022, 12, 30), date(2023, 1, 9), 5)
    train, test = spl.embargo_split(holiday, date(2022, 12, 30), date(2023, 1, 10), 5)
    assert train.count() and test.count()


def test_earliest_start(holiday):
    assert spl.earliest_test_start(spl.calendar(holiday), date(2022, 12, 30), 5) == date(2023, 1, 10)
    assert spl.earliest_test_start(spl.calendar(holiday), date(2023, 1, 31), 5) == business_day(date(2023, 1, 31), 10)


def test_label_end_skips_the_weekend(spark):
    df = panel(spark, pd.bdate_range("2024-01-01", "2024-01-12"), ("A",))
    out = spl.label_ends(df, 2).where(F.to_date("timestamp") == F.lit(date(2024, 1, 4))).first()
    assert out.t1 == datetime(2024, 1, 8)


def test_missing_label_end(spark):
    df = spl.label_ends(panel(spark, pd.bdate_range("2024-01-01", periods=2)), 2)
    with pytest.raises(spl.SplitError, match="missing t1"):
        spl.check_cpcv(df, spl.cpcv_roles(df, n=2, k=1))


def test_cpcv_matches_a_loop(spark):
    days = list(pd.bdate_range("2024-01-01", periods=40))
    h, e, n, k = 3, 2, 6, 2
    df = spl.label_ends(panel(spark, days), h).where("t1 is not null")
    got = {(r.fold_id, r.timestamp, r.symbol): r.role for r in spl.cpcv_roles(df, n=n, k=k, embargo=e).collect()}
    used = days[: len(days) - h]
    size, extra = divmod(len(used), n)
    block = [b for b in range(n) for _ in range(size + (b < extra))]
    assert len({f for f, _, _ in got}) == 15
    for f, test in enumerate(combinations(range(n), k)):
        pos = [i for i in range(len(used)) if block[i] in test]
        runs = []
        for i in pos:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        for i, d in enumerate(used):
            role = "test" if i in pos else "purged" if any(i <= hi and i + h >= lo for lo, hi in runs) else "embargoed" if any(hi < i <= hi + e for lo, hi in runs) else "train"
            assert got[f, d.to_pydatetime(), "A"] == role


def test_config_checks():
    with pytest.raises(ValueError, match="embargo"):
        Research(horizon=6, embargo=5)
    with pytest.raises(ValueError, match="unknown keys"):
        build(Settings, {"quality": {"nope": 1}})
    assert build(Settings, {"symbols": ["A"], "quality": {"stale_bars": 3}}).quality.stale_bars == 3
    with pytest.raises(ValueError, match="unique"):
        Settings(symbols=("A", "A"))
