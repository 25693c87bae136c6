"""Data-quality gate: an ordered list of rules for each symbol, and soft flags for extreme returns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import Quality
from barline.functions.windows import ws, lag, last

FIELDS = ("open", "high", "low", "close", "volume")


class QualityError(ValueError):
    """A symbol failed the gate."""


def _returns(bars: DataFrame) -> DataFrame:
    r = F.log(F.when((F.col("close") > 0) & (lag("close") > 0), F.col("close") / lag("close")))
    return bars.withColumn("log_return", r)


def report(bars: DataFrame, now: datetime, limits: Quality = Quality(), *, expected: DataFrame | None = None, sequence: str | None = None) -> DataFrame:
    """(symbol, rows, nan ratios, extremes, last_timestamp, passed, reason): the first broken rule.

    ``expected`` (symbol) adds symbols without bars; ``sequence`` names the column of arrival order
    for the monotonicity rule.
    """
    df = _returns(bars)
    same = F.when(F.col("close") == lag("close"), 1).otherwise(0)
    df = df.withColumn("__same", same)
    df = df.withColumn("__flat", F.sum("__same").over(last(limits.stale_bars - 1)) >= limits.stale_bars - 1)
    bad = (F.col("high") < F.col("low")) | ~F.col("open").between(F.col("low"), F.col("high")) | ~F.col("close").between(F.col("low"), F.col("high"))
    df = df.withColumn("__geometry", bad)
    if sequence is not None:
        from pyspark.sql import Window

        arrival = Window.partitionBy("symbol").orderBy(sequence)
        df = df.withColumn("__back", F.lag("timestamp").over(arrival) >= F.col("timestamp"))
    else:
        df = df.withColumn("__back", F.lag("timestamp").over(ws()) >= F.col("timestamp"))
    stats = df.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_distinct("timestamp").alias("times"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"nan_{c}") for c in FIELDS],
        F.coalesce(F.bool_or("__geometry"), F.lit(False)).alias("geometry"),
        F.coalesce(F.bool_or("__flat"), F.lit(False)).alias("flat"),
        F.coalesce(F.bool_or("__back"), F.lit(False)).alias("back"),
        F.max("timestamp").alias("last_timestamp"),
        F.max(F.abs("log_return")).alias("max_abs_log_return"),
        F.avg("log_return").alias("mean"),
        F.stddev_pop("log_return").alias("std"),
        F.max("log_return").alias("r_max"),
        F.min("log_return").alias("r_min"),
    )
    z = F.greatest(F.col("r_max") - F.col("mean"), F.col("mean") - F.col("r_min"))
    stats = stats.withColumn("max_return_zscore", F.coalesce(F.try_divide(z, F.col("std")), F.lit(0.0)))
    if expected is not None:
        stats = expected.select("symbol").distinct().join(stats, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    at = F.lit(now)
    age = F.datediff(at, F.col("last_timestamp"))
    reason = F.when(F.col("rows") == 0, "empty").when(F.col("times") < F.col("rows"), "duplicate").when(F.col("back"), "not increasing")
    for c in FIELDS:
        reason = reason.when(F.col(f"nan_{c}") > limits.max_nan_ratio, f"missing {c}")
    reason = reason.when(F.col("geometry"), "geometry").when(F.col("flat"), "flatline")
    reason = reason.when(F.col("last_timestamp") > at, "future").when(age > limits.max_last_bar_age_days, "stale")
    ratios = F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col(f"nan_{c}") for c in FIELDS]))
    return stats.select("symbol", "rows", ratios.alias("nan_ratios"), "max_abs_log_return", "max_return_zscore", "last_timestamp", reason.isNull().alias("passed"), reason.alias("reason"))


def extreme_returns(bars: DataFrame, limits: Quality = Quality()) -> DataFrame:
    """Rows with an extreme return; they stay in the data."""
    from pyspark.sql import Window

    own = Window.partitionBy("symbol")
    df = _returns(bars)
    z = F.coalesce(F.try_divide(F.abs(F.col("log_return") - F.avg("log_return").over(own)), F.stddev_pop("log_return").over(own)), F.lit(0.0))
    df = df.withColumn("zscore", z)
    return df.where((F.abs("log_return") > limits.max_abs_logret) | (F.col("zscore") > limits.zscore_cap)).select("symbol", "timestamp", "log_return", "zscore")


def gate(bars: DataFrame, now: datetime, limits: Quality = Quality(), on_event=None) -> DataFrame:
    """``bars`` if every symbol passes, else an error with the reasons.  ``on_event`` gets each report row."""
    failed = []
    for row in report(bars, now, limits).orderBy("symbol").toLocalIterator():
        if on_event is not None:
            on_event(row)
        if not row.passed:
            failed.append(f"{row.symbol}: {row.reason}")
    if failed:
        raise QualityError("; ".join(failed))
    return bars


def passing(bars: DataFrame, now: datetime, limits: Quality = Quality(), min_symbols: int = 30) -> tuple[DataFrame, DataFrame]:
    """(bars of the symbols that pass, report of the dropped); too few survivors are an error."""
    rep = report(bars, now, limits)
    kept = rep.where("passed").select("symbol")
    if kept.count() < min_symbols:
        raise QualityError(f"fewer than {min_symbols} symbols passed")
    return bars.join(kept, "symbol", "left_semi"), rep.where("not passed").select("symbol", "reason")


def completeness(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Faults against a list of symbols: missing, unexpected, or with missing values."""
    want, have = expected.select("symbol").distinct(), bars.select("symbol").distinct()
    missing = want.join(have, "symbol", "left_anti").withColumn("fault", F.lit("missing"))
    extra = have.join(want, "symbol", "left_anti").withColumn("fault", F.lit("unexpected"))
    holes = bars.groupBy("symbol").agg(F.count_if(F.greatest(*[F.col(c).isNull() for c in FIELDS])).alias("n")).where("n > 0")
    return missing.unionByName(extra).unionByName(holes.select("symbol", F.lit("null values").alias("fault")))


def continuous(bars: DataFrame, calendar: DataFrame, until, min_symbols: int = 1) -> DataFrame:
    """Symbols with a close on every calendar timestamp up to ``until`` (symbol, have, want)."""
    dates = calendar.select("timestamp").distinct().where(F.col("timestamp") <= F.lit(until))
    want = dates.agg(F.count("*").alias("want"))
    have = bars.where(F.col("close").isNotNull()).join(dates, "timestamp", "left_semi").groupBy("symbol").agg(F.count_distinct("timestamp").alias("have"))
    kept = have.crossJoin(F.broadcast(want)).where("have = want")  # one row
    if min_symbols > 1 and kept.count() < min_symbols:
        raise QualityError(f"fewer than {min_symbols} symbols have a continuous history")
    return kept


def reindex(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every symbol on every calendar timestamp: missing prices NULL, missing actions 0."""
    cells = bars.select("symbol").distinct().withColumn("__one", F.lit(1)).join(calendar.select("timestamp").distinct().withColumn("__one", F.lit(1)), "__one").drop("__one")
    out = cells.join(bars, ["symbol", "timestamp"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dividends", "splits") if c in bars.columns})
