"""Labels: forward returns, event filters, barriers, sample weights, fractional differencing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import indicators as ind
from barline.functions.ewm import Ewm, with_ewm
from barline.functions.windows import ws, last
from barline.operators.corporate import adjust, adjusted_ohlc
from barline.session import ship


class LabelError(ValueError):
    """Labels cannot be made from these bars."""


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """(timestamp, symbol, label): adjusted return over the next ``horizon`` bars; the last bars of
    a symbol have none."""
    df = adjust(bars).withColumn("label", ind.forward_return(horizon, "adj"))
    return df.where("label is not null").select("timestamp", "symbol", "label")


def short_symbols(bars: DataFrame, horizon: int) -> DataFrame:
    """Symbols with too few bars for any label."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars")).where(F.col("bars") <= horizon)


def daily_volatility(bars: DataFrame, span: int = 20) -> DataFrame:
    """``bars`` with ``vol``: exponentially weighted deviation of log returns, from two returns on."""
    df = bars.withColumn("__r", ind.log_return())
    return with_ewm(df, [Ewm.span("vol", "__r", span, 2, std=True)]).drop("__r")


def cusum_events(bars: DataFrame, threshold: float) -> DataFrame:
    """(symbol, timestamp, direction) where the cumulated log return leaves the band; only the side
    that fired starts again, the upper one is tested first.

    The recurrence is sequential in a symbol: a fold over its time-sorted returns.  Events are
    gathered by position, so the fold carries two sums and a list of positions.
    """
    df = bars.withColumn("r", ind.log_return())
    series = df.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("timestamp", "r"))).alias("s"))
    state = "struct<p:double,n:double,e:array<struct<timestamp:timestamp,direction:int>>>"
    fold = F.expr(
        f"""aggregate(s, cast(struct(0D, 0D, array()) as {state}), (a, x) -> case
          when x.r is null then a
          when greatest(0D, a.p + x.r) > {threshold}D then struct(0D as p, least(0D, a.n + x.r) as n, concat(a.e, array(struct(cast(x.timestamp as timestamp) as timestamp, 1 as direction))) as e)
          when least(0D, a.n + x.r) < -{threshold}D then struct(greatest(0D, a.p + x.r) as p, 0D as n, concat(a.e, array(struct(cast(x.timestamp as timestamp) as timestamp, -1 as direction))) as e)
          else struct(greatest(0D, a.p + x.r) as p, least(0D, a.n + x.r) as n, a.e as e) end).e"""
    )
    return series.select("symbol", F.explode(fold).alias("x")).select("symbol", "x.timestamp", "x.direction")


def _touch(pt: float, sl: float) -> Column:
    """Index of the first path return beyond a barrier; the last index if none is."""
    hit = F.expr(f"array_min(filter(transform(sr, (x, j) -> if(x >= {pt}D * vol or x <= -{sl}D * vol, j, null)), x -> x is not null))")
    return F.coalesce(hit, F.size("sr") - 1)


def barriers(bars: DataFrame, *, pt: float = 1.0, sl: float = 1.0, vertical: int = 10, side: str | None = None, full: bool = False) -> DataFrame:
    """First barrier touched after each row: (symbol, timestamp, t1, ret, label) of rows with ``vol``.

    The path is the next ``vertical`` bars, fewer at the end of a symbol unless ``full``.  With a
    ``side`` column returns are signed and the label is ret > 0; else it is the side touched, 0 for
    none.  A row without a path ends where it starts, with return 0.
    """
    ahead = ws().rowsBetween(1, vertical)
    df = bars.withColumns({"path": F.collect_list("close").over(ahead), "times": F.collect_list("timestamp").over(ahead)})
    sign = F.col(side) if side else F.lit(1.0)
    df = df.where("vol is not null and vol > 0")
    if side:
        df = df.where(F.col(side).isin(1.0, -1.0))
    if full:
        df = df.where(F.size("path") == vertical)
    df = df.withColumn("sr", F.transform("path", lambda c: (F.try_divide(c, F.col("close")) - 1) * sign))
    df = df.withColumn("hit", F.when(F.size("sr") > 0, _touch(pt, sl)))
    ret = F.when(F.col("hit").isNull(), 0.0).otherwise(F.expr("try_element_at(sr, hit + 1)"))
    t1 = F.coalesce(F.expr("try_element_at(times, hit + 1)"), F.col("timestamp"))
    df = df.withColumns({"ret": ret, "t1": t1})
    if side:
        label = (F.col("ret") > 0).cast("int")
    else:
        label = F.when(F.col("ret") >= pt * F.col("vol"), 1).when(F.col("ret") <= -sl * F.col("vol"), -1).otherwise(0)
    return df.withColumn("label", label)


def triple_barrier(bars: DataFrame, events: DataFrame | None = None, *, span: int = 20, **options) -> DataFrame:
    """(symbol, t0, t1, ret, label) of each event (default: every bar with a volatility).

    Given events must be bars with a positive volatility, and with a ``side`` of 1 or -1 where one is
    asked for: an error names the first few that are not.
    """
    df = barriers(daily_volatility(bars, span), **options)
    if events is not None:
        bad = check_events(bars, events, span, options.get("side")).limit(5).collect()
        if bad:
            raise LabelError("; ".join(f"{r.reason}: {r.symbol} at {r.timestamp}" for r in bad))
        df = df.join(events.select("symbol", "timestamp").distinct(), ["symbol", "timestamp"], "left_semi")
    return df.select("symbol", F.col("timestamp").alias("t0"), "t1", "ret", "label")


def check_events(bars: DataFrame, events: DataFrame, span: int = 20, side: str | None = None) -> DataFrame:
    """Events that no bar has, or whose volatility is not positive, or whose side is neither 1 nor -1."""
    known = F.col(side).cast("double").isin(1.0, -1.0) if side else F.lit(True)
    vol = daily_volatility(bars, span).select("symbol", "timestamp", "vol", F.coalesce(known, F.lit(False)).alias("sided"))
    df = events.join(vol.withColumn("known", F.lit(True)), ["symbol", "timestamp"], "left")
    reason = F.when(F.col("known").isNull(), "unknown event").when(F.coalesce(F.col("vol"), F.lit(0.0)) <= 0, "volatility").when(~F.col("sided"), "side")
    return df.withColumn("reason", reason).where("reason is not null").select("symbol", "timestamp", "reason")


def meta_events(bars: DataFrame, *, span: int = 20, pt: float = 1.0, sl: float = 1.0, vertical: int = 10, trend: int = 10) -> DataFrame:
    """(timestamp, symbol, side, label, t1, ret) of every bar with a trend side and a full path, on
    adjusted prices; a price that is not finite is a missing one."""
    adjusted = adjusted_ohlc(bars)
    finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("open", "high", "low", "close")}
    df = daily_volatility(adjusted.withColumns(finite).withColumn("side", ind.trend_side(trend)), span)
    df = barriers(df, pt=pt, sl=sl, vertical=vertical, side="side", full=True)
    return df.select("timestamp", "symbol", "side", "label", "t1", "ret")


def sample_weights(samples: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """``samples`` (symbol, t0, t1) with ``weight``: mean over the observations in [t0, t1] of one over
    the number of samples of the symbol that cover them.

    ``observations`` (symbol, timestamp) default to calendar days.  Concurrency is a running sum of
    starts and ends, not a range join; the mean is a difference of running sums.
    """
    if observations is None:
        span = samples.groupBy("symbol").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
        observations = span.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("timestamp"))
    starts = samples.groupBy("symbol", F.col("t0").alias("timestamp")).agg(F.count("*").alias("up"))
    ends = samples.groupBy("symbol", F.col("t1").alias("timestamp")).agg(F.count("*").alias("down"))
    null = F.lit(None).cast("long")
    points = (
        observations.select("symbol", "timestamp", null.alias("up"), null.alias("down"), F.lit(1).alias("obs"))
        .unionByName(starts.select("symbol", "timestamp", "up", null.alias("down"), F.lit(0).alias("obs")))
        .unionByName(ends.select("symbol", "timestamp", null.alias("up"), "down", F.lit(0).alias("obs")))
    )
    points = points.groupBy("symbol", "timestamp").agg(F.coalesce(F.sum("up"), F.lit(0)).alias("up"), F.coalesce(F.sum("down"), F.lit(0)).alias("down"), F.max("obs").alias("obs"))
    before = ws().rowsBetween(Window.unboundedPreceding, -1)
    upto = ws().rowsBetween(Window.unboundedPreceding, 0)
    active = F.sum("up").over(upto) - F.coalesce(F.sum("down").over(before), F.lit(0))
    points = points.withColumn("active", active)
    share = F.when(F.col("obs") == 1, F.try_divide(F.lit(1.0), F.col("active")))
    points = points.withColumn("share", F.coalesce(share, F.lit(0.0)))
    points = points.withColumns({"s": F.sum("share").over(upto), "c": F.sum("obs").over(upto)})
    points = points.withColumns({"s0": F.col("s") - F.col("share"), "c0": F.col("c") - F.col("obs")})
    a = points.select("symbol", F.col("timestamp").alias("t0"), "s0", "c0")
    b = points.select("symbol", F.col("timestamp").alias("t1"), "s", "c")
    out = samples.join(a, ["symbol", "t0"]).join(b, ["symbol", "t1"])
    return out.withColumn("weight", F.try_divide(F.col("s") - F.col("s0"), F.col("c") - F.col("c0"))).select(*samples.columns, "weight")


def label_pipeline(bars: DataFrame, *, threshold: float = 0.02, span: int = 20, pt: float = 1.0, sl: float = 1.0, vertical: int = 10, events: DataFrame | None = None) -> DataFrame:
    """CUSUM events, barrier labels and uniqueness weights: (symbol, label, t0, t1, ret, weight)."""
    if events is None:
        events = cusum_events(bars, threshold)
    samples = triple_barrier(bars, events, span=span, pt=pt, sl=sl, vertical=vertical)
    if samples.isEmpty():
        raise LabelError("no samples")
    out = sample_weights(samples, bars.select("symbol", "timestamp"))
    return out.select("symbol", "label", "t0", "t1", "ret", "weight")


def labels_from_bars(bars: DataFrame, **options) -> DataFrame:
    """The pipeline on total-return prices."""
    return label_pipeline(adjust(bars).withColumn("close", F.col("adj")).drop("adj"), **options)


def ffd_weights(d: float, thresh: float = 1e-4) -> list[float]:
    """Fixed-width weights, newest first, down to the threshold."""
    w, k = [1.0], 1
    while True:
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < thresh:
            return w
        w.append(nxt)
        k += 1


def fracdiff(bars: DataFrame, *, column: str = "close", d: float = 0.4, thresh: float = 1e-4) -> Column:
    """Fractionally differenced ``column`` as an expression; NULL until the window is full."""
    weights = ffd_weights(d, thresh)
    oldest_first = F.array(*[F.lit(float(x)) for x in reversed(weights)])
    frame = F.collect_list(column).over(last(len(weights)))
    dot = F.aggregate(F.zip_with(frame, oldest_first, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(frame) == len(weights), dot)


# MacKinnon (1994) response surface for the test with a constant, one variable: fixed values.
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_TAU_SMALL = (2.1659, 1.4412, 0.038269)
_TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_pvalue(values) -> float:
    """p-value of the augmented Dickey-Fuller test with a constant and one lag."""
    import numpy as np

    x = np.asarray(values, dtype=float)
    dx = np.diff(x)
    y = dx[1:]
    design = np.column_stack([x[1:-1], dx[:-1], np.ones(len(y))])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ beta
    s2 = resid @ resid / (len(y) - design.shape[1])
    t = beta[0] / math.sqrt(s2 * np.linalg.pinv(design.T @ design)[0, 0])
    if t > _TAU_MAX:
        return 1.0
    if t < _TAU_MIN:
        return 0.0
    poly = _TAU_SMALL if t <= _TAU_STAR else _TAU_LARGE
    z = sum(c * t**i for i, c in enumerate(poly))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def min_ffd_d(bars: DataFrame, *, column: str = "close", thresh: float = 1e-4, significance: float = 0.05, step: float = 0.1, min_points: int = 20, missing: str = "raise") -> DataFrame:
    """(symbol, d): the least d on the grid whose differenced series is stationary.  A symbol without any
    is an error when it is met, or has a NULL with ``missing="null"``.

    The test regresses within one series, so each symbol is one group of a grouped map.
    """

    def search(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values("timestamp")[column].to_numpy(dtype=float)
        found = None
        for i in range(int(round(1 / step)) + 1):
            d = round(i * step, 10)
            w = np.array(ffd_weights(d, thresh))
            if len(x) < len(w) + min_points - 1:
                continue
            if adf_pvalue(np.convolve(x, w, mode="valid")) < significance:
                found = d
                break
        if found is None and missing == "raise":
            raise LabelError(f"no d in [0, 1] makes {pdf['symbol'].iloc[0]} stationary")
        return pd.DataFrame({"symbol": [pdf["symbol"].iloc[0]], "d": [found]}, columns=["symbol", "d"]).astype({"d": "float64"})

    if not 0.0 < significance < 1.0 or not 0.0 < step <= 1.0:
        raise LabelError("significance and step must be in (0, 1]")
    ship(bars.sparkSession)
    return bars.select("symbol", "timestamp", column).groupBy("symbol").applyInPandas(search, "symbol string, d double")
