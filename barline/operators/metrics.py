"""Evaluation: information coefficients, portfolio returns, Sharpe moments, deflation, classification."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.cross_section import rank

EULER = 0.5772156649015329


def _corr(x: str, y: str) -> Column:
    """Pearson correlation of a group; NULL where either side is constant."""
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def ic_by_date(scores: DataFrame) -> DataFrame:
    """(timestamp, breadth, ic, rank_ic) of dates with two rows or more of (score, fwd)."""
    df = scores.where("score is not null and fwd is not null")
    df = df.withColumns({"rs": rank("score"), "rf": rank("fwd")})
    out = df.groupBy("timestamp").agg(F.count("*").alias("breadth"), _corr("score", "fwd").alias("ic"), _corr("rs", "rf").alias("rank_ic"))
    return out.where("breadth >= 2")


def ic_summary(by_date: DataFrame, *, min_breadth: int = 30, threshold: float = 0.02) -> DataFrame:
    """One row: means, information ratio, median breadth and flags."""
    out = by_date.agg(
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("icir"),
        F.median("breadth").alias("median_breadth"),
        F.count("ic").alias("n_dates"),
    )
    return out.withColumns({"breadth_warning": F.col("median_breadth") < min_breadth, "passes": F.coalesce(F.col("ic_mean") > threshold, F.lit(False))})


def portfolio_returns(scores: DataFrame, keys: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Long-short return of each date: demeaned scores over their absolute sum; 0 without dispersion."""
    d = F.col("score") - F.avg("score").over(Window.partitionBy(*keys))
    df = scores.withColumn("d", d)
    flat = (F.count("*") < 2) | (F.max("score") == F.min("score"))
    value = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.sum(F.col("d") * F.col("fwd")), F.sum(F.abs("d"))), F.lit(0.0)))
    return df.groupBy(*keys).agg(value.alias("strategy_return"))


def accepted_returns(bets: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Mean return of the bets at or above the threshold; 0 on dates without one."""
    return bets.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("proba") >= threshold, F.col("ret"))), F.lit(0.0)).alias("strategy_return"))


def align_returns(data: DataFrame, bets: DataFrame, column: str = "ret") -> DataFrame:
    """``data`` with the bet return of each (timestamp, symbol); a row without one is an error."""
    keys = ["timestamp", "symbol"]
    missing = data.join(bets, keys, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no bet return for {missing[0].symbol} at {missing[0].timestamp}")
    return data.join(bets.select(*keys, column), keys, "left")


def merge_paths(paths: DataFrame) -> DataFrame:
    """Mean over folds for each timestamp."""
    return paths.groupBy("timestamp").agg(F.avg("strategy_return").alias("strategy_return"))


def sharpe_moments(returns: DataFrame, column: str = "strategy_return", keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean over sample deviation, population skewness and Pearson kurtosis."""
    flat = F.max(column) == F.min(column)
    sharpe = F.when(~flat, F.try_divide(F.avg(column), F.stddev_samp(column)))
    grouped = returns.groupBy(*keys) if keys else returns.groupBy()
    return grouped.agg(F.count(column).alias("n"), sharpe.alias("sharpe"), F.when(~flat, F.skewness(column)).alias("skew"), F.when(~flat, F.kurtosis(column) + 3.0).alias("kurtosis"))


def classification(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Confusion counts, precision, recall, F1, base rate and lift; 0 for undefined ratios."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "base_rate": ratio(tp + fn, tp + fp + fn + tn)})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("lift", ratio(F.col("precision"), F.col("base_rate")))


def grinold(rank_ic: Column, breadth: Column) -> Column:
    return rank_ic * F.sqrt(breadth)


def null_summary(null: DataFrame, real: float, column: str = "dsr") -> DataFrame:
    """Quantiles (linear) of a permutation null, and the share of it below the real value in percent."""
    return null.agg(
        F.percentile(column, 0.5).alias("q50"),
        F.percentile(column, 0.95).alias("q95"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        (F.avg((F.col(column) < real).cast("double")) * 100).alias("below_pct"),
    )


def phi(z: float) -> float:
    """Normal distribution, accurate far in the lower tail."""
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Expected greatest Sharpe ratio of ``trials`` without skill."""
    if trials < 2:
        raise ValueError("need two trials at least")
    if variance < 0 or not math.isfinite(variance):
        raise ValueError("variance must be finite and not negative")
    if variance == 0:
        return 0.0
    inv = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e)))


@dataclass(frozen=True)
class Deflated:
    sharpe: float
    threshold: float
    n: int
    z: float
    dsr: float

    @property
    def verdict(self) -> str:
        return "JA" if self.dsr >= 0.95 else "NEIN"


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, variance: float, trials: int) -> Deflated:
    """Probability that the true ratio beats the expected best of the trials."""
    if n < 2:
        raise ValueError("need two observations at least")
    threshold = expected_max_sharpe(variance, trials)
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    if spread <= 0:
        raise ValueError("the variance term is not positive")
    z = (sharpe - threshold) * math.sqrt(n - 1) / math.sqrt(spread)
    return Deflated(sharpe, threshold, n, z, phi(z))


def deflated_from_returns(returns: DataFrame, variance: float, trials: int, column: str = "strategy_return") -> Deflated:
    m = sharpe_moments(returns, column).first()
    if m.n < 2 or m.sharpe is None:
        raise ValueError("no variance in the returns")
    return deflated_sharpe(m.sharpe, m.n, m.skew, m.kurtosis, variance, trials)


def corrected_verdict(real: float, q95: float) -> str:
    """JA only above the deflation limit and above an unbroken null."""
    return "JA" if real >= 0.95 and real > q95 and q95 < 0.9 else "NEIN"


def permute_within_dates(labels: DataFrame, seed: int, perm: int, column: str = "label") -> DataFrame:
    """The labels of each date dealt anew among its symbols: a seeded order of digests, the same on any
    partitioning.  Rows are numbered twice within their date, by symbol and by digest of
    ``seed|perm|timestamp|symbol``; the label of the i-th digest goes to the i-th symbol."""
    when = F.col("timestamp").cast("string")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(perm)), when, "symbol"))
    here = Window.partitionBy("timestamp").orderBy("symbol")
    drawn = Window.partitionBy("timestamp").orderBy(digest, "symbol")
    df = labels.withColumns({"__i": F.row_number().over(here), "__j": F.row_number().over(drawn)})
    dealt = df.select("timestamp", F.col("__j").alias("__i"), F.col(column).alias("__v"))
    out = df.join(dealt, ["timestamp", "__i"]).withColumn(column, F.col("__v"))
    return out.select(*labels.columns)
