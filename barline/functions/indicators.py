"""Per-symbol indicators as column expressions over a bar table (symbol, timestamp, OHLCV)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.windows import full, lag, last, ws


def _c() -> Column:
    return F.col("close")


def log_return() -> Column:
    return F.log(F.try_divide(_c(), lag("close")))


def momentum(k: int) -> Column:
    return F.try_divide(_c(), lag("close", k)) - 1


def reversal(k: int) -> Column:
    return -momentum(k)


def skip_momentum(window: int, skip: int = 21) -> Column:
    """Return over ``window`` bars that ends ``skip`` bars ago."""
    return F.try_divide(lag("close", skip), lag("close", skip + window)) - 1


def ma_ratio(n: int = 20) -> Column:
    return full(n, _c(), F.try_divide(_c(), F.avg(_c()).over(last(n))))


def mean_reversion(n: int = 20) -> Column:
    mean = F.avg(_c()).over(last(n))
    return full(n, _c(), F.try_divide(_c() - mean, mean))


def _pop_std(x: Column, n: int) -> Column:
    """Population deviation over the last n rows; exactly 0 where all values are equal."""
    flat = F.max(x).over(last(n)) == F.min(x).over(last(n))
    return F.when(flat, 0.0).otherwise(F.stddev_pop(x).over(last(n)))


def close_zscore(n: int = 20) -> Column:
    return full(n, _c(), F.try_divide(_c() - F.avg(_c()).over(last(n)), _pop_std(_c(), n)))


def return_std(n: int, returns: str = "log_return") -> Column:
    return full(n, F.col(returns), _pop_std(F.col(returns), n))


def return_std_sample(n: int, returns: str = "log_return") -> Column:
    return full(n, F.col(returns), F.stddev_samp(returns).over(last(n)))


def inverse_return_std(n: int, returns: str = "log_return") -> Column:
    return full(n, F.col(returns), F.try_divide(F.lit(1.0), _pop_std(F.col(returns), n)))


def volume_ratio(n: int = 20) -> Column:
    return full(n, F.col("volume"), F.try_divide(F.col("volume"), F.avg(F.col("volume")).over(last(n))))


def parkinson(n: int = 21) -> Column:
    rng = F.when((F.col("high") > 0) & (F.col("low") > 0), F.pow(F.log(F.col("high") / F.col("low")), 2))
    return full(n, rng, F.sqrt(F.sum(rng).over(last(n)) / (4.0 * n * math.log(2.0))))


def true_range() -> Column:
    """Of the first bar its height: greatest skips the NULL terms."""
    prev = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def trend_side(n: int = 10) -> Column:
    """+1 above the n-bar mean, -1 below, NULL at equality and before n bars."""
    mean = F.avg(_c()).over(last(n))
    return full(n, _c(), F.when(_c() > mean, 1.0).when(_c() < mean, -1.0))


def forward_return(h: int, price: str = "adj") -> Column:
    return F.try_divide(F.lead(price, h).over(ws()), F.col(price)) - 1


def gain() -> Column:
    d = _c() - lag("close")
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))


def loss() -> Column:
    d = _c() - lag("close")
    return F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))


def rsi(gain_mean: Column, loss_mean: Column) -> Column:
    """100 without losses, NULL without either."""
    flat = (gain_mean == 0) & (loss_mean == 0)
    return F.when(flat, None).when(loss_mean == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain_mean, loss_mean)))
