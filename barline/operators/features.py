"""Feature matrices: registries of columns, the per-symbol bundle, and the cross-sectional pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import Windows
from barline.functions import indicators as ind
from barline.functions.cross_section import cs_rank, cs_zscore
from barline.functions.ewm import Ewm, with_ewm
from barline.operators.corporate import adjusted_ohlc

# Fixed names and order of the feature columns.
BASE = ("log_return", "realized_vol_20", "momentum_20", "ma_ratio_20", "rsi_14", "macd", "macd_signal", "atr_14", "close_zscore_20")
MORE = ("momentum_5", "momentum_10", "momentum_60", "ret_std_10", "ret_std_20", "ret_std_60", "mean_reversion_20", "gain_loss_ratio_14", "volume_ratio_20")
CLASS_RAW = ("reversal_5", "reversal_21", "inv_ret_std_21", "inv_ret_std_63", "parkinson_vol_21")


def crossed(names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"{n}{s}" for n in names for s in ("_cs_rank", "_cs_zscore"))


CROSS_BASE = MORE
PRODUCTION = BASE + MORE + crossed(CROSS_BASE)
NEW = tuple(n for raw in CLASS_RAW for n in (raw, *crossed((raw,))))
COMBINED = PRODUCTION + NEW
ARMS = {
    "reversal": tuple(c for c in NEW if c.startswith("reversal")),
    "low_vol": tuple(c for c in NEW if c.startswith("inv_ret_std")),
    "range_vol": tuple(c for c in NEW if c.startswith("parkinson")),
    "all_new": NEW,
    "new_plus_old": COMBINED,
}
assert len(PRODUCTION) == 36 and len(NEW) == 15 and len(COMBINED) == 51


def symbol_features(bars: DataFrame, *, adjusted: bool = True) -> DataFrame:
    """All raw features of each symbol; the rolling windows share one sort by (symbol, timestamp), the
    exponential ones another by (symbol, block)."""
    df = adjusted_ohlc(bars) if adjusted else bars
    df = df.withColumns({"log_return": ind.log_return(), "__gain": ind.gain(), "__loss": ind.loss(), "__tr": ind.true_range()})
    df = with_ewm(
        df,
        [
            Ewm.span("realized_vol_20", "log_return", 20, 20, std=True),
            Ewm.span("__fast", "close", 12, 12),
            Ewm.span("__slow", "close", 26, 26),
            Ewm.wilder("__g", "__gain", 14),
            Ewm.wilder("__l", "__loss", 14),
            Ewm.wilder("atr_14", "__tr", 14),
        ],
    )
    df = df.withColumn("macd", F.col("__fast") - F.col("__slow"))
    df = with_ewm(df, [Ewm.span("macd_signal", "macd", 9, 9)])
    raw = {
        "rsi_14": ind.rsi(F.col("__g"), F.col("__l")),
        "gain_loss_ratio_14": F.try_divide(F.col("__g"), F.col("__l")),
        "ma_ratio_20": ind.ma_ratio(20),
        "close_zscore_20": ind.close_zscore(20),
        "mean_reversion_20": ind.mean_reversion(20),
        "volume_ratio_20": ind.volume_ratio(20),
        "parkinson_vol_21": ind.parkinson(21),
    }
    raw |= {f"momentum_{k}": ind.momentum(k) for k in (5, 10, 20, 60)}
    raw |= {f"reversal_{k}": ind.reversal(k) for k in (5, 21)}
    raw |= {f"ret_std_{n}": ind.return_std(n) for n in (10, 20, 60)}
    raw |= {f"inv_ret_std_{n}": ind.inverse_return_std(n) for n in (21, 63)}
    return df.withColumns(raw).select("timestamp", "symbol", *BASE, *MORE, *CLASS_RAW)


def cross_section(raw: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``raw`` with rank and z-score of ``names`` among the symbols of each timestamp."""
    cols = {f"{n}_cs_rank": cs_rank(n) for n in names} | {f"{n}_cs_zscore": cs_zscore(n) for n in names}
    return raw.withColumns(cols)


def check_windows(windows: Windows | None) -> None:
    """The matrices are defined by their names: other lengths than the fixed ones are an error."""
    if windows is not None and windows != Windows():
        raise ValueError("the feature matrices have fixed windows")


def production_matrix(bars: DataFrame, windows: Windows | None = None) -> DataFrame:
    """The 36 production features of every bar."""
    check_windows(windows)
    return cross_section(symbol_features(bars), CROSS_BASE).select("timestamp", "symbol", *PRODUCTION)


def combined_matrix(bars: DataFrame, windows: Windows | None = None) -> DataFrame:
    """All 51 features; experiment arms select from it, and unused columns are pruned."""
    check_windows(windows)
    return cross_section(symbol_features(bars), CROSS_BASE + CLASS_RAW).select("timestamp", "symbol", *COMBINED)


def momentum_matrix(bars: DataFrame) -> DataFrame:
    """Skip-month momentum, reversal and volatility; complete rows only, then z-scored per date."""
    df = bars.withColumn("log_return", ind.log_return())
    raw = {f"mom_{w}_skip21": ind.skip_momentum(w) for w in (63, 126, 252)} | {"rev_21": ind.momentum(21), "vol_63": ind.return_std_sample(63)}
    names = list(raw)
    df = df.withColumns(raw).select("timestamp", "symbol", *names).dropna(subset=names)
    return df.withColumns({n: cs_zscore(n) for n in names})


def feature_vectors(matrix: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows without gaps as (timestamp, symbol, array of name and value)."""
    finite = F.lit(True)
    for n in names:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    vector = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    return matrix.where(finite).select("timestamp", "symbol", vector.alias("features"))
