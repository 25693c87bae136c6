from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.config import Quality
from barline.operators import pit, quality
from barline.schema import BARS, SchemaError
from barline.sources.bars import alias, canonicalise, decimal_rows, unpivot_wide
from barline.sources.providers import DataUnavailable, first_complete, secondary_stub

CLOSES = [100 + (i % 7) * 1.5 for i in range(60)]
NOW = datetime(2024, 3, 1)


def reason(bars, **k):
    return quality.report(bars, k.pop("now", NOW), Quality(), **k).first().reason


def test_clean_bars_pass(bars):
    assert reason(bars(CLOSES)) is None
    assert quality.gate(bars(CLOSES), NOW).count() == 60


def test_corruptions_fail(bars):
    b = bars(CLOSES)
    day = F.to_date("timestamp")
    assert reason(bars(CLOSES[:10] + [None] + CLOSES[11:])) == "missing open"
    assert reason(bars(CLOSES[:30] + [CLOSES[29]] * 5 + CLOSES[35:])) == "flatline"
    assert reason(b.withColumn("low", F.when(day == F.lit("2024-01-05").cast("date"), F.col("high") + 1).otherwise(F.col("low")))) == "geometry"
    assert reason(b, now=NOW + timedelta(days=8)) == "stale"
    assert reason(b, now=NOW - timedelta(days=8)) == "future"
    assert reason(b.unionByName(b.limit(1))) == "duplicate"
    swapped = b.withColumn("seq", F.when(day == F.lit("2024-01-01").cast("date"), 2).when(day == F.lit("2024-01-02").cast("date"), 1).otherwise(F.dayofyear("timestamp")))
    assert reason(swapped, sequence="seq") == "not increasing"
    with pytest.raises(quality.QualityError, match="AAA: flatline"):
        quality.gate(bars([5] * 60), NOW)


def test_expected_symbol_without_bars(spark, bars):
    want = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
    out = {r.symbol: r.reason for r in quality.report(bars(CLOSES), NOW, expected=want).collect()}
    assert out == {"AAA": None, "BBB": "empty"}
    assert quality.completeness(bars(CLOSES), want).collect()[0].fault == "missing"


def test_extreme_returns_are_flagged_only(bars):
    x = CLOSES[:20] + [CLOSES[20] * 1.5] + CLOSES[21:]
    assert quality.extreme_returns(bars(x)).count() == 2
    assert reason(bars(x)) is None


def test_asof_golden(spark):
    t0 = datetime(2024, 1, 10)
    f = spark.createDataFrame([("A", t0, 1.0)], "symbol string, timestamp timestamp, x double")
    t = spark.createDataFrame([("A", t0 - timedelta(days=1), 7.0), ("A", t0 + timedelta(days=1), 999999.0), ("B", t0, 5.0)], "symbol string, timestamp timestamp, x double")
    r = pit.asof_join(f, t, by=["symbol"]).first()
    assert r.x_target == 7.0 and r.timestamp_target < t0
    with pytest.raises(pit.LookaheadError):
        pit.assert_no_lookahead(f.withColumn("later", F.col("timestamp") + F.expr("interval 1 day")), "timestamp")
    assert pit.asof_join(f, t, by=["symbol"], tolerance="1 hour").first().x_target is None


def test_sources(spark, bars):
    raw = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 1.0, 2.0, 2.0, float("nan"), None, 0.0)], "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, Dividends double, `Stock Splits` double")
    r = canonicalise(raw, F.lit("AAA"))
    assert r.columns == BARS.fieldNames()
    row = r.first()
    assert (row.volume, row.dividends, row.adj_close) == (None, 0.0, 2.0)
    with pytest.raises(SchemaError, match="stock_splits"):
        canonicalise(raw.drop("Stock Splits"), F.lit("AAA"))
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "Date int, `Close|A` double, `B|Close` double")
    assert sorted((x.symbol, x.Close) for x in unpivot_wide(wide, ["A", "B"]).collect()) == [("A", 2.0), ("B", 3.0)]
    assert str(decimal_rows(bars([0.1]), "AAA").first().close).startswith("0.1000000")
    assert [x.s for x in spark.createDataFrame([("A",), ("B",)], "a string").select(alias(F.col("a"), {"A": "X"}).alias("s")).collect()] == ["X", "B"]


def test_provider_chain(bars):
    good = lambda s: bars(CLOSES)
    assert first_complete([("none", secondary_stub), ("good", good)], ["AAA"]).count() == 60
    with pytest.raises(DataUnavailable, match="none #2.*good #1: BBB missing"):
        first_complete([("none", secondary_stub), ("good", good)], ["AAA", "BBB"], attempts=2)


def test_universe(spark, bars):
    b = bars(CLOSES).unionByName(bars(CLOSES[:50], symbol="BBB"))
    cal = bars(CLOSES).select("timestamp")
    assert [r.symbol for r in quality.continuous(b, cal, datetime(2100, 1, 1)).collect()] == ["AAA"]
    assert quality.reindex(b, cal).where("close is null").count() == 10
    kept, dropped = quality.passing(b, NOW, min_symbols=1)
    assert kept.select("symbol").distinct().count() == 1 and dropped.first().reason == "stale"
