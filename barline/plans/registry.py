"""Registered queries over the test tables, and the DuckDB SQL that states the same results.

Floats are rounded to six places on both sides; dates are written as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.config import Quality, Research
from barline.functions import indicators as ind
from barline.functions.cross_section import cs_rank, cs_zscore
from barline.functions.ewm import Ewm, with_ewm
from barline.operators import features as feat
from barline.operators import labels as lab
from barline.operators import metrics as met
from barline.operators import models as mod
from barline.operators import pit, quality, trials
from barline.operators import splits as spl
from barline.operators.corporate import adjust, adjusted_ohlc
from barline.plans import pipelines
from barline.sources.bars import event_hour_bars, priority_bars, user_bars
from barline.streaming.bars import stream_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _ticks(symbol: str, ts: str, price: str, order: str, table: str) -> str:
    return f"""SELECT symbol, timestamp, min_by(p, o) AS open, max(p) AS high, min(p) AS low, max_by(p, o) AS close,
      CAST(count(*) AS DOUBLE) AS volume FROM (SELECT {symbol} AS symbol, {ts} AS timestamp, {price} AS p, {order} AS o FROM {table}) GROUP BY symbol, timestamp"""


PRIO = "bars AS (SELECT *, CASE WHEN day(timestamp) = 15 THEN close * 0.01 ELSE 0.0 END AS dividends FROM (" + _ticks("o_orderpriority", "CAST(o_orderdate AS DATE)", "o_totalprice", "o_orderkey", "orders") + "))"
USER = "bars AS (" + _ticks("CAST(user_id AS VARCHAR)", "CAST(ts AS DATE)", "value", "(ts, event_id)", "events") + ")"
HOUR = "bars AS (" + _ticks("event_type", "date_trunc('hour', ts)", "value", "(ts, event_id)", "events") + ")"
ADJ = """gross AS (SELECT *, coalesce((close + dividends) / nullif(lag(close) OVER w, 0), 1.0) AS g FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
adj AS (SELECT *, first_value(close) OVER w * product(g) OVER w AS adj FROM gross WINDOW w AS (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING))"""
RET = "ret AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"
DAY = "strftime(timestamp, '%Y-%m-%d') AS day"
W = "(PARTITION BY symbol ORDER BY timestamp)"


def last_sql(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY timestamp ROWS {n - 1} PRECEDING)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Keys with the timestamp as text, values rounded (negative zero made positive)."""
    cols = [F.date_format("timestamp", "yyyy-MM-dd").alias("day") if k == "timestamp" else F.col(k) for k in keys]
    return df.select(*cols, *[(F.round(F.col(v), digits) + F.lit(0.0)).alias(v) for v in values])


def r_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


@query(
    "cs_momentum_rank",
    f"""WITH {USER}, m AS (SELECT symbol, timestamp, close / nullif(lag(close, 5) OVER {W}, 0) - 1 AS momentum_5 FROM bars),
s AS (SELECT *, rank() OVER (PARTITION BY timestamp ORDER BY momentum_5 NULLS LAST) + (count(momentum_5) OVER (PARTITION BY timestamp, momentum_5) - 1) / 2.0 AS k,
  count(momentum_5) OVER t AS n, avg(momentum_5) OVER t AS a, stddev_pop(momentum_5) OVER t AS d, max(momentum_5) OVER t = min(momentum_5) OVER t AS flat FROM m WINDOW t AS (PARTITION BY timestamp))
SELECT symbol, {DAY}, round(momentum_5, 6) + 0.0 AS momentum_5, CASE WHEN momentum_5 IS NOT NULL THEN round(k / n, 6) + 0.0 END AS cs_rank,
  CASE WHEN momentum_5 IS NOT NULL THEN CASE WHEN flat THEN 0.0 ELSE round((momentum_5 - a) / d, 6) + 0.0 END END AS cs_zscore FROM s""",
)
def cs_momentum_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = user_bars(spark, sf_dir).withColumn("momentum_5", ind.momentum(5))
    df = df.withColumns({"cs_rank": cs_rank("momentum_5"), "cs_zscore": cs_zscore("momentum_5")})
    return rounded(df, ["symbol", "timestamp"], ["momentum_5", "cs_rank", "cs_zscore"])


OHLCV = ["open", "high", "low", "close", "volume"]
for _name, _view, _sql in (("bars_user_day", user_bars, USER), ("bars_priority_day", priority_bars, PRIO)):
    QUERIES[_name] = lambda spark, sf_dir, v=_view: rounded(v(spark, sf_dir), ["symbol", "timestamp"], OHLCV)
    SQL[_name] = f"WITH {_sql} SELECT symbol, {DAY}, {r_sql(*OHLCV)} FROM bars"


@query("total_return_adjust", f"WITH {PRIO}, {ADJ} SELECT symbol, {DAY}, {r_sql('adj')}, round(high * adj / close, 6) + 0.0 AS adj_high FROM adj")
def total_return_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    df = adjusted_ohlc(bars).withColumnRenamed("high", "adj_high")
    return rounded(df, ["symbol", "timestamp"], ["adj", "adj_high"])


RETURNS = {"log_return": ind.log_return, "momentum_5": lambda: ind.momentum(5), "momentum_60": lambda: ind.momentum(60), "reversal_21": lambda: ind.reversal(21), "mom_63_skip21": lambda: ind.skip_momentum(63)}


@query(
    "window_returns",
    f"""WITH {PRIO}, f AS (SELECT symbol, timestamp, ln(close / lag(close) OVER w) AS log_return, close / lag(close, 5) OVER w - 1 AS momentum_5, close / lag(close, 60) OVER w - 1 AS momentum_60,
 -(close / lag(close, 21) OVER w - 1) AS reversal_21, lag(close, 21) OVER w / lag(close, 84) OVER w - 1 AS mom_63_skip21 FROM bars WINDOW w AS {W})
SELECT symbol, {DAY}, {r_sql(*RETURNS)} FROM f""",
)
def window_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priority_bars(spark, sf_dir).withColumns({k: f() for k, f in RETURNS.items()})
    return rounded(df, ["symbol", "timestamp"], list(RETURNS))


def _full_sql(n: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {value} END"


ROLLING = ["ma_ratio_20", "mean_reversion_20", "close_zscore_20", "ret_std_20", "inv_ret_std_21", "vol_63", "volume_ratio_20", "parkinson_vol_21", "trend_side"]


@query(
    "window_rolling",
    f"""WITH {PRIO}, {RET}, f AS (SELECT symbol, timestamp,
 {_full_sql(20, 'close', 'close / avg(close) OVER w20')} AS ma_ratio_20, {_full_sql(20, 'close', '(close - avg(close) OVER w20) / avg(close) OVER w20')} AS mean_reversion_20,
 {_full_sql(20, 'close', '(close - avg(close) OVER w20) / nullif(stddev_pop(close) OVER w20, 0)')} AS close_zscore_20, {_full_sql(20, 'r', 'stddev_pop(r) OVER w20')} AS ret_std_20,
 {_full_sql(21, 'r', '1 / nullif(stddev_pop(r) OVER w21, 0)')} AS inv_ret_std_21, {_full_sql(63, 'r', 'stddev_samp(r) OVER w63')} AS vol_63,
 {_full_sql(20, 'volume', 'volume / nullif(avg(volume) OVER w20, 0)')} AS volume_ratio_20,
 {_full_sql(21, 'high', 'sqrt(sum(pow(ln(high / low), 2)) OVER w21 / (4 * 21 * ln(2)))')} AS parkinson_vol_21,
 {_full_sql(10, 'close', 'CASE WHEN close > avg(close) OVER w10 THEN 1.0 WHEN close < avg(close) OVER w10 THEN -1.0 END')} AS trend_side
 FROM ret WINDOW w10 AS {last_sql(10)}, w20 AS {last_sql(20)}, w21 AS {last_sql(21)}, w63 AS {last_sql(63)})
SELECT symbol, {DAY}, {r_sql(*ROLLING)} FROM f""",
)
def window_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = priority_bars(spark, sf_dir).withColumn("log_return", ind.log_return())
    cols = {
        "ma_ratio_20": ind.ma_ratio(20),
        "mean_reversion_20": ind.mean_reversion(20),
        "close_zscore_20": ind.close_zscore(20),
        "ret_std_20": ind.return_std(20),
        "inv_ret_std_21": ind.inverse_return_std(21),
        "vol_63": ind.return_std_sample(63),
        "volume_ratio_20": ind.volume_ratio(20),
        "parkinson_vol_21": ind.parkinson(21),
        "trend_side": ind.trend_side(10),
    }
    return rounded(df.withColumns(cols), ["symbol", "timestamp"], ROLLING)


def ewm_sql(source: str, alpha: str, value: str, table: str, name: str, std: bool = False) -> str:
    """Prefix-sum form of the recursive mean, another route than the operator's blocks."""
    q = f"(1 - {alpha})"
    var = f", sum(c * pow(x, 2) * pow({q}, -k)) OVER cum * pow({q}, k) AS e2, pow({q}, 2 * k) + pow({alpha}, 2) * (1 - pow({q}, 2 * k)) / (1 - pow({q}, 2)) AS w2" if std else ""
    return f"""{name} AS (SELECT symbol, timestamp, k, {value} AS v FROM (
 SELECT *, sum(c * x * pow({q}, -k)) OVER cum * pow({q}, k) AS m{var} FROM (
  SELECT symbol, timestamp, x, k, CASE WHEN k = 0 THEN 1.0 ELSE {alpha} END AS c FROM (
   SELECT symbol, timestamp, {source} AS x, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS DOUBLE) AS k FROM {table} WHERE {source} IS NOT NULL))
 WINDOW cum AS (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING)))"""


_STD = "CASE WHEN k > 0 THEN sqrt(greatest(e2 - m * m, 0) / (1 - w2)) END"
EWMS = ["realized_vol_20", "daily_vol", "rsi_14", "gain_loss_ratio_14", "atr_14", "macd", "macd_signal"]


@query(
    "window_ewm",
    f"""WITH {PRIO}, base AS (SELECT *, ln(close / lag(close) OVER w) AS r, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS dn, lag(close) OVER w AS pc,
 greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS {W}),
ups AS (SELECT symbol, timestamp, CASE WHEN pc IS NOT NULL THEN up END AS up, CASE WHEN pc IS NOT NULL THEN dn END AS dn FROM base),
{ewm_sql('r', '(2.0/21)', _STD, 'base', 'vol', std=True)}, {ewm_sql('up', '(1.0/14)', 'm', 'ups', 'eg')}, {ewm_sql('dn', '(1.0/14)', 'm', 'ups', 'el')}, {ewm_sql('tr', '(1.0/14)', 'm', 'base', 'et')},
{ewm_sql('close', '(2.0/13)', 'm', 'base', 'ef')}, {ewm_sql('close', '(2.0/27)', 'm', 'base', 'es')},
line AS (SELECT symbol, timestamp, CASE WHEN es.k >= 25 THEN ef.v - es.v END AS macd FROM ef JOIN es USING (symbol, timestamp)),
{ewm_sql('macd', '(2.0/10)', 'm', 'line', 'sg')},
j AS (SELECT symbol, timestamp, CASE WHEN vol.k >= 19 THEN vol.v END AS realized_vol_20, CASE WHEN vol.k >= 1 THEN vol.v END AS daily_vol,
 CASE WHEN eg.k >= 13 THEN CASE WHEN eg.v = 0 AND el.v = 0 THEN NULL WHEN el.v = 0 THEN 100.0 ELSE 100 - 100 / (1 + eg.v / el.v) END END AS rsi_14,
 CASE WHEN eg.k >= 13 THEN eg.v / nullif(el.v, 0) END AS gain_loss_ratio_14, CASE WHEN et.k >= 13 THEN et.v END AS atr_14, macd, CASE WHEN sg.k >= 8 THEN sg.v END AS macd_signal
 FROM line LEFT JOIN vol USING (symbol, timestamp) LEFT JOIN eg USING (symbol, timestamp) LEFT JOIN el USING (symbol, timestamp) LEFT JOIN et USING (symbol, timestamp) LEFT JOIN sg USING (symbol, timestamp))
SELECT symbol, {DAY}, {r_sql(*EWMS, digits=5)} FROM j""",
)
def window_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    df = feat.symbol_features(bars, adjusted=False)
    vol = lab.daily_volatility(bars).select("symbol", "timestamp", F.col("vol").alias("daily_vol"))
    return rounded(df.join(vol, ["symbol", "timestamp"]), ["symbol", "timestamp"], EWMS, digits=5)


def _features_sql(bars: str) -> str:
    """All raw features on adjusted prices (``feat``); ``bars`` defines bars with dividends."""
    names = ", ".join(f"w{n} AS {last_sql(n)}" for n in (10, 20, 21, 60, 63))
    momentum = ", ".join(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS momentum_{k}" for k in (5, 10, 20, 60))
    reversal = ", ".join(f"-(close / nullif(lag(close, {k}) OVER w, 0) - 1) AS reversal_{k}" for k in (5, 21))
    spread = ", ".join(f"{_full_sql(n, 'r', f'stddev_pop(r) OVER w{n}')} AS ret_std_{n}" for n in (10, 20, 60))
    inverse = ", ".join(f"{_full_sql(n, 'r', f'1 / nullif(stddev_pop(r) OVER w{n}, 0)')} AS inv_ret_std_{n}" for n in (21, 63))
    ewms = [("r", "(2.0/21)", _STD, "base", "vol", True), ("up", "(1.0/14)", "m", "base", "eg"), ("dn", "(1.0/14)", "m", "base", "el"), ("tr", "(1.0/14)", "m", "base", "et"), ("close", "(2.0/13)", "m", "base", "ef"), ("close", "(2.0/27)", "m", "base", "es")]
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, timestamp)" for t in ("vol", "eg", "el", "et", "line", "sg"))
    return f"""{bars}, {ADJ}, a AS (SELECT symbol, timestamp, volume, high * adj / close AS high, low * adj / close AS low, close * adj / close AS close FROM adj),
base AS (SELECT *, lag(close) OVER w AS pc, CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / lag(close) OVER w) END AS r,
 CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(close - lag(close) OVER w, 0) END AS up, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(lag(close) OVER w - close, 0) END AS dn,
 greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
 CASE WHEN high > 0 AND low > 0 THEN ln(high / low) END AS hl FROM a WINDOW w AS {W}),
{", ".join(ewm_sql(*e) for e in ewms)},
line AS (SELECT symbol, timestamp, CASE WHEN es.k >= 25 THEN ef.v - es.v END AS macd FROM ef JOIN es USING (symbol, timestamp)), {ewm_sql("macd", "(2.0/10)", "m", "line", "sg")},
roll AS (SELECT symbol, timestamp, r AS log_return, {momentum}, {reversal}, {spread}, {inverse},
 {_full_sql(20, 'close', 'close / nullif(avg(close) OVER w20, 0)')} AS ma_ratio_20, {_full_sql(20, 'close', '(close - avg(close) OVER w20) / nullif(avg(close) OVER w20, 0)')} AS mean_reversion_20,
 {_full_sql(20, 'close', '(close - avg(close) OVER w20) / nullif(stddev_pop(close) OVER w20, 0)')} AS close_zscore_20, {_full_sql(20, 'volume', 'volume / nullif(avg(volume) OVER w20, 0)')} AS volume_ratio_20,
 {_full_sql(21, 'hl', 'sqrt(sum(pow(hl, 2)) OVER w21 / (4 * 21 * ln(2)))')} AS parkinson_vol_21 FROM base WINDOW w AS {W}, {names}),
feat AS (SELECT roll.*, CASE WHEN vol.k >= 19 THEN vol.v END AS realized_vol_20, macd, CASE WHEN sg.k >= 8 THEN sg.v END AS macd_signal, CASE WHEN et.k >= 13 THEN et.v END AS atr_14,
 CASE WHEN eg.k >= 13 THEN CASE WHEN eg.v = 0 AND el.v = 0 THEN NULL WHEN el.v = 0 THEN 100.0 ELSE 100 - 100 / (1 + eg.v / el.v) END END AS rsi_14, CASE WHEN eg.k >= 13 THEN eg.v / nullif(el.v, 0) END AS gain_loss_ratio_14
 FROM roll {joins})"""


#: Features on the scale of prices: their digits beyond the third are noise of either engine.
PRICED = ("macd", "macd_signal", "atr_14")


def _matrix(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    small = [n for n in names if n not in PRICED]
    return rounded(df.withColumns({n: F.round(n, 3) for n in PRICED}), ["symbol", "timestamp"], [*PRICED, *small], digits=7)


def _matrix_sql(bars: str, raw: tuple[str, ...], crossed: tuple[str, ...]) -> str:
    """Raw features and, of the ``crossed`` ones, rank and z-score among the symbols of a date."""
    both = []
    for c in crossed:
        rank = f"(rank() OVER (PARTITION BY timestamp ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY timestamp, {c}) - 1) / 2.0) / count({c}) OVER t"
        score = f"CASE WHEN max({c}) OVER t = min({c}) OVER t THEN 0.0 ELSE ({c} - avg({c}) OVER t) / stddev_pop({c}) OVER t END"
        both += [f"CASE WHEN {c} IS NOT NULL THEN round({rank}, 7) + 0.0 END AS {c}_cs_rank", f"CASE WHEN {c} IS NOT NULL THEN round({score}, 7) + 0.0 END AS {c}_cs_zscore"]
    return f"WITH {_features_sql(bars)} SELECT symbol, {DAY}, {r_sql(*PRICED, digits=3)}, {r_sql(*(c for c in raw if c not in PRICED), digits=7)}, {', '.join(both)} FROM feat WINDOW t AS (PARTITION BY timestamp)"


@query("feature_matrix_36", _matrix_sql(USER.replace("bars AS (", "bars AS (SELECT *, CASE WHEN day(timestamp) = 15 THEN close * 0.01 ELSE 0.0 END AS dividends FROM (", 1) + ")", feat.BASE + feat.MORE, feat.CROSS_BASE))
def feature_matrix_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(feat.production_matrix(user_bars(spark, sf_dir)), feat.PRODUCTION)


@query("feature_matrix_51", _matrix_sql(PRIO, feat.BASE + feat.MORE + feat.CLASS_RAW, feat.CROSS_BASE + feat.CLASS_RAW))
def feature_matrix_51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(feat.combined_matrix(priority_bars(spark, sf_dir)), feat.COMBINED)


@query(
    "feature_vectors",
    f"WITH {_features_sql(PRIO)} SELECT symbol, {DAY}, 3 AS n, round(log_return + momentum_20 + close_zscore_20, 6) + 0.0 AS total FROM feat WHERE log_return IS NOT NULL AND momentum_20 IS NOT NULL AND close_zscore_20 IS NOT NULL",
)
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("log_return", "momentum_20", "close_zscore_20")
    vectors = feat.feature_vectors(feat.symbol_features(priority_bars(spark, sf_dir)), names)
    return vectors.select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x["value"]), 6).alias("total"))


NOW = datetime(2026, 1, 1)
LIMITS = Quality(max_abs_logret=1.0, zscore_cap=2.5, stale_bars=3)


@query(
    "quality_report",
    f"""WITH {PRIO}, {RET}, s AS (SELECT *, CASE WHEN close = lag(close) OVER {W} THEN 1 ELSE 0 END AS same FROM ret), fl AS (SELECT *, sum(same) OVER {last_sql(2)} >= 2 AS flat FROM s),
g AS (SELECT symbol, count(*) AS rows, max(abs(r)) AS mx, avg(r) AS a, stddev_pop(r) AS d, max(r) AS rx, min(r) AS rn, max(timestamp) AS lt, bool_or(flat) AS flat, bool_or(high < low) AS geo FROM fl GROUP BY symbol)
SELECT symbol, rows, round(mx, 6) AS max_abs_log_return, round(greatest(rx - a, a - rn) / d, 6) AS max_return_zscore, NOT (geo OR flat OR date_diff('day', lt, DATE '2026-01-01') > 7) AS passed,
 CASE WHEN geo THEN 'geometry' WHEN flat THEN 'flatline' WHEN date_diff('day', lt, DATE '2026-01-01') > 7 THEN 'stale' END AS reason FROM g""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = quality.report(priority_bars(spark, sf_dir), NOW, LIMITS)
    return rep.select("symbol", "rows", F.round("max_abs_log_return", 6).alias("max_abs_log_return"), F.round("max_return_zscore", 6).alias("max_return_zscore"), "passed", "reason")


@query(
    "quality_flags",
    f"""WITH {PRIO}, {RET}, z AS (SELECT *, coalesce(abs(r - avg(r) OVER p) / nullif(stddev_pop(r) OVER p, 0), 0) AS zs FROM ret WINDOW p AS (PARTITION BY symbol))
SELECT symbol, {DAY}, round(r, 6) + 0.0 AS log_return, round(zs, 6) AS zscore FROM z WHERE abs(r) > 1.0 OR zs > 2.5""",
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.extreme_returns(priority_bars(spark, sf_dir), LIMITS), ["symbol", "timestamp"], ["log_return", "zscore"])


@query(
    "universe_continuous",
    f"WITH {PRIO}, c AS (SELECT count(DISTINCT timestamp) AS want FROM bars WHERE symbol = '1-URGENT'), h AS (SELECT symbol, count(DISTINCT timestamp) AS have FROM bars WHERE timestamp IN (SELECT timestamp FROM bars WHERE symbol = '1-URGENT') GROUP BY symbol) SELECT symbol, have, want FROM h, c WHERE have = want",
)
def universe_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    cal = bars.where("symbol = '1-URGENT'").select("timestamp")
    return quality.continuous(bars, cal, date(2100, 1, 1)).select("symbol", "have", "want")


@query(
    "completeness",
    f"WITH {HOUR} SELECT symbol, 'unexpected' AS fault FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol NOT IN ('click', 'absent') UNION ALL SELECT s, 'missing' FROM (VALUES ('click'), ('absent')) t(s) WHERE s NOT IN (SELECT symbol FROM bars)",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame([("click",), ("absent",)], "symbol string")
    return quality.completeness(event_hour_bars(spark, sf_dir), want)


@query(
    "reindex_calendar",
    f"WITH {PRIO}, c AS (SELECT DISTINCT timestamp FROM bars), s AS (SELECT DISTINCT symbol FROM bars) SELECT symbol, {DAY}, round(close, 6) AS close, round(coalesce(dividends, 0), 6) AS dividends FROM (SELECT symbol, timestamp FROM c, s) LEFT JOIN bars USING (symbol, timestamp)",
)
def reindex_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    return rounded(quality.reindex(bars, spl.calendar(bars)), ["symbol", "timestamp"], ["close", "dividends"])


@query(
    "asof_join",
    """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts)
SELECT l.event_id, l.user_id, round(l.value, 6) AS value, round(r.value, 6) AS value_target FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = pit.asof_join(left, right, on="ts", by=["user_id"])
    return out.select("event_id", "user_id", F.round("value", 6).alias("value"), F.round("value_target", 6).alias("value_target"))


@query("lookahead_guard", "SELECT count(*) AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate")
def lookahead_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderdate", "l_shipdate")
    return pit.lookahead_rows(joined, "o_orderdate").agg(F.count("*").alias("late"))


FWD = f"fwd AS (SELECT symbol, timestamp, lead(adj, 5) OVER {W} / adj - 1 AS label FROM adj)"


@query("forward_returns", f"WITH {PRIO}, {ADJ}, {FWD} SELECT symbol, {DAY}, round(label, 6) + 0.0 AS label FROM fwd WHERE label IS NOT NULL")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lab.forward_returns(priority_bars(spark, sf_dir), 5), ["symbol", "timestamp"], ["label"])


DATASET = f"{PRIO}, {ADJ}, {FWD}, f AS (SELECT symbol, timestamp, close / lag(close, 5) OVER w - 1 AS momentum_5, {_full_sql(20, 'close', 'close / avg(close) OVER w20')} AS ma_ratio_20 FROM bars WINDOW w AS {W}, w20 AS {last_sql(20)}), ds AS (SELECT f.*, fwd.label FROM f JOIN fwd USING (symbol, timestamp) WHERE momentum_5 IS NOT NULL AND ma_ratio_20 IS NOT NULL AND label IS NOT NULL)"


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    f = bars.withColumns({"momentum_5": ind.momentum(5), "ma_ratio_20": ind.ma_ratio(20)})
    return mod.assemble(f, lab.forward_returns(bars, 5), ("momentum_5", "ma_ratio_20"))


@query("assemble_dataset", f"WITH {DATASET} SELECT symbol, {DAY}, {r_sql('momentum_5', 'ma_ratio_20', 'label')} FROM ds")
def assemble_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_dataset(spark, sf_dir), ["symbol", "timestamp"], ["momentum_5", "ma_ratio_20", "label"])


SCORES = f"""{USER}, sc AS (SELECT symbol, timestamp, close / nullif(lag(close, 5) OVER w, 0) - 1 AS score, lead(close, 1) OVER w / nullif(close, 0) - 1 AS fwd FROM bars WINDOW w AS {W}),
ok AS (SELECT * FROM sc WHERE score IS NOT NULL AND fwd IS NOT NULL)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = user_bars(spark, sf_dir).withColumns({"score": ind.momentum(5), "fwd": ind.forward_return(1, "close")})
    return df.select("symbol", "timestamp", "score", "fwd").where("score is not null and fwd is not null")


IC = f"""{SCORES}, rk AS (SELECT *, rank() OVER (PARTITION BY timestamp ORDER BY score) + (count(*) OVER (PARTITION BY timestamp, score) - 1) / 2.0 AS rs,
 rank() OVER (PARTITION BY timestamp ORDER BY fwd) + (count(*) OVER (PARTITION BY timestamp, fwd) - 1) / 2.0 AS rf FROM ok),
ic AS (SELECT timestamp, count(*) AS breadth, CASE WHEN max(score) > min(score) AND max(fwd) > min(fwd) THEN covar_pop(score, fwd) / (stddev_pop(score) * stddev_pop(fwd)) END AS ic,
 CASE WHEN max(rs) > min(rs) AND max(rf) > min(rf) THEN covar_pop(rs, rf) / (stddev_pop(rs) * stddev_pop(rf)) END AS rank_ic FROM rk GROUP BY timestamp HAVING count(*) >= 2)"""


@query("ic_by_date", f"WITH {IC} SELECT {DAY}, breadth, {r_sql('ic', 'rank_ic')} FROM ic")
def ic_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.ic_by_date(_scores(spark, sf_dir)), ["timestamp", "breadth"], ["ic", "rank_ic"])


@query(
    "ic_summary",
    f"WITH {IC} SELECT round(avg(ic), 6) + 0.0 AS ic_mean, round(avg(rank_ic), 6) + 0.0 AS rank_ic_mean, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) + 0.0 AS icir, round(median(breadth), 6) AS median_breadth, count(ic) AS n_dates, median(breadth) < 30 AS breadth_warning, coalesce(avg(ic) > 0.02, false) AS passes FROM ic",
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = met.ic_summary(met.ic_by_date(_scores(spark, sf_dir)))
    out = out.withColumns({c: F.round(c, 6) + 0.0 for c in ("ic_mean", "rank_ic_mean", "icir")})
    return out.withColumn("median_breadth", F.round("median_breadth", 6))


PF = f"""{SCORES}, dm AS (SELECT *, score - avg(score) OVER (PARTITION BY timestamp) AS d FROM ok),
pf AS (SELECT timestamp, CASE WHEN count(*) < 2 OR max(score) = min(score) THEN 0.0 ELSE sum(d * fwd) / sum(abs(d)) END AS strategy_return FROM dm GROUP BY timestamp)"""


@query("portfolio_returns", f"WITH {PF} SELECT {DAY}, round(strategy_return, 6) + 0.0 AS strategy_return FROM pf")
def portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(met.portfolio_returns(_scores(spark, sf_dir)), ["timestamp"], ["strategy_return"])


@query(
    "sharpe_moments",
    f"WITH {PF} SELECT count(*) AS n, round(avg(strategy_return) / stddev_samp(strategy_return), 6) + 0.0 AS sharpe, round((avg(pow(strategy_return, 3)) - 3 * avg(strategy_return) * avg(pow(strategy_return, 2)) + 2 * pow(avg(strategy_return), 3)) / pow(stddev_pop(strategy_return), 3), 6) + 0.0 AS skew, round(kurtosis_pop(strategy_return) + 3, 6) AS kurtosis FROM pf",
)
def sharpe_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = met.sharpe_moments(met.portfolio_returns(_scores(spark, sf_dir)))
    return out.select("n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sharpe", "skew", "kurtosis")])


@query(
    "merge_paths",
    f"WITH {PF}, p AS (SELECT timestamp, strategy_return FROM pf UNION ALL SELECT timestamp, strategy_return / 2 FROM pf WHERE day(timestamp) > 15) SELECT {DAY}, round(avg(strategy_return), 6) + 0.0 AS strategy_return FROM p GROUP BY timestamp",
)
def merge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pf = met.portfolio_returns(_scores(spark, sf_dir))
    half = pf.where(F.dayofmonth("timestamp") > 15).withColumn("strategy_return", F.col("strategy_return") / 2)
    return rounded(met.merge_paths(pf.unionByName(half)), ["timestamp"], ["strategy_return"])


@query("accepted_returns", f"WITH {SCORES} SELECT {DAY}, round(coalesce(avg(CASE WHEN score >= 0.5 THEN fwd END), 0.0), 6) + 0.0 AS strategy_return FROM ok GROUP BY timestamp")
def accepted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = _scores(spark, sf_dir).select("timestamp", F.col("score").alias("proba"), F.col("fwd").alias("ret"))
    return rounded(met.accepted_returns(bets), ["timestamp"], ["strategy_return"])


@query(
    "classification",
    f"""WITH {SCORES}, c AS (SELECT sum(CASE WHEN fwd > 0 AND score > 0 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN fwd <= 0 AND score > 0 THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN fwd > 0 AND score <= 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN fwd <= 0 AND score <= 0 THEN 1 ELSE 0 END) AS tn FROM ok),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce((tp + fn) / nullif(tp + fp + fn + tn, 0), 0) AS br FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(br, 6) AS base_rate, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(coalesce(pr / nullif(br, 0), 0), 6) AS lift FROM p""",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scores(spark, sf_dir).select((F.col("fwd") > 0).cast("int").alias("label"), (F.col("score") > 0).cast("int").alias("predicted"))
    out = met.classification(df)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "base_rate", "f1", "lift")])


VOL = f"{RET}, {ewm_sql('r', '(2.0/21)', _STD, 'ret', 'ev', std=True)}, bv AS (SELECT b.*, CASE WHEN ev.k >= 1 THEN ev.v END AS vol, row_number() OVER {W} AS pos FROM ret b LEFT JOIN ev USING (symbol, timestamp))"


def _barrier_sql(side: str, full: bool, label: str, where: str) -> str:
    return f"""path AS (SELECT a.symbol, a.timestamp, a.vol, a.side, a.n, b.pos - a.pos AS j, b.timestamp AS t, (b.close / a.close - 1) * a.side AS sr FROM
 (SELECT symbol, timestamp, pos, close, vol, {side} AS side, least(10, max(pos) OVER (PARTITION BY symbol) - pos) AS n FROM bv) a JOIN bv b ON b.symbol = a.symbol AND b.pos > a.pos AND b.pos <= a.pos + 10 WHERE a.vol > 0 AND a.side IS NOT NULL {where}),
hit AS (SELECT symbol, timestamp, any_value(vol) AS vol, any_value(n) AS n, coalesce(min(CASE WHEN sr >= vol OR sr <= -vol THEN j END), max(j)) AS j FROM path GROUP BY symbol, timestamp),
res AS (SELECT h.symbol, h.timestamp, p.t AS t1, p.sr AS ret, {label} AS label, p.side FROM hit h JOIN path p ON p.symbol = h.symbol AND p.timestamp = h.timestamp AND p.j = h.j)"""


_TB = _barrier_sql("1.0", False, "CASE WHEN p.sr >= h.vol THEN 1 WHEN p.sr <= -h.vol THEN -1 ELSE 0 END", "")


@query(
    "triple_barrier",
    f"WITH {PRIO}, {VOL}, {_TB} SELECT symbol, {DAY}, strftime(t1, '%Y-%m-%d') AS t1, round(ret, 6) + 0.0 AS ret, label FROM res UNION ALL SELECT symbol, {DAY}, strftime(timestamp, '%Y-%m-%d'), 0.0, 0 FROM (SELECT *, max(pos) OVER (PARTITION BY symbol) AS m FROM bv) WHERE pos = m AND vol > 0",
)
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lab.triple_barrier(priority_bars(spark, sf_dir))
    return out.select("symbol", F.date_format("t0", "yyyy-MM-dd").alias("day"), F.date_format("t1", "yyyy-MM-dd").alias("t1"), (F.round("ret", 6) + 0.0).alias("ret"), "label")


@query(
    "meta_events",
    f"""WITH raw AS (SELECT * FROM ({_ticks('o_orderpriority', 'CAST(o_orderdate AS DATE)', 'o_totalprice', 'o_orderkey', 'orders')})), bars AS (SELECT *, 0.0 AS dividends FROM raw), {VOL},
sd AS (SELECT symbol, timestamp, CASE WHEN count(close) OVER w = 10 THEN CASE WHEN close > avg(close) OVER w THEN 1.0 WHEN close < avg(close) OVER w THEN -1.0 END END AS s FROM bars WINDOW w AS {last_sql(10)}),
{_barrier_sql('(SELECT s FROM sd WHERE sd.symbol = bv.symbol AND sd.timestamp = bv.timestamp)', True, 'CASE WHEN p.sr > 0 THEN 1 ELSE 0 END', 'AND a.n = 10')}
SELECT symbol, {DAY}, side, label, strftime(t1, '%Y-%m-%d') AS t1, round(ret, 6) + 0.0 AS ret FROM res""",
)
def meta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir).withColumn("dividends", F.lit(0.0))
    out = lab.meta_events(bars)
    return out.select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "side", "label", F.date_format("t1", "yyyy-MM-dd").alias("t1"), (F.round("ret", 6) + 0.0).alias("ret"))


@query(
    "sample_weights",
    f"""WITH {PRIO}, {VOL}, {_TB}, c AS (SELECT o.symbol, o.timestamp, count(*) AS c FROM bars o JOIN res e ON e.symbol = o.symbol AND o.timestamp BETWEEN e.timestamp AND e.t1 GROUP BY ALL)
SELECT e.symbol, strftime(e.timestamp, '%Y-%m-%d') AS day, round(avg(1.0 / c.c), 6) AS weight FROM res e JOIN c ON c.symbol = e.symbol AND c.timestamp BETWEEN e.timestamp AND e.t1 GROUP BY e.symbol, e.timestamp""",
)
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    samples = lab.triple_barrier(bars).where("t1 > t0")
    out = lab.sample_weights(samples, bars.select("symbol", "timestamp"))
    return out.select("symbol", F.date_format("t0", "yyyy-MM-dd").alias("day"), F.round("weight", 6).alias("weight"))


@query(
    "cusum_events",
    f"""WITH RECURSIVE {PRIO}, {RET}, o AS (SELECT symbol, timestamp, coalesce(r, 0) AS r, row_number() OVER {W} AS i FROM ret),
st AS (SELECT symbol, i, timestamp, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS n, 0 AS direction FROM o WHERE i = 1
 UNION ALL SELECT o.symbol, o.i, o.timestamp, CASE WHEN greatest(0, st.p + o.r) > 1.5 THEN CAST(0 AS DOUBLE) ELSE greatest(0, st.p + o.r) END,
  CASE WHEN greatest(0, st.p + o.r) <= 1.5 AND least(0, st.n + o.r) < -1.5 THEN CAST(0 AS DOUBLE) ELSE least(0, st.n + o.r) END,
  CASE WHEN greatest(0, st.p + o.r) > 1.5 THEN 1 WHEN least(0, st.n + o.r) < -1.5 THEN -1 ELSE 0 END FROM st JOIN o ON o.symbol = st.symbol AND o.i = st.i + 1)
SELECT symbol, {DAY}, direction FROM st WHERE direction <> 0""",
)
def cusum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lab.cusum_events(priority_bars(spark, sf_dir), 1.5)
    return out.select("symbol", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "direction")


_FFD = lab.ffd_weights(0.4, 1e-2)


@query(
    "fracdiff",
    f"WITH {PRIO} SELECT symbol, {DAY}, round(v, 5) + 0.0 AS fracdiff FROM (SELECT symbol, timestamp, CASE WHEN count(*) OVER {last_sql(len(_FFD))} = {len(_FFD)} THEN "
    + " + ".join(f"({w!r}) * lag(close, {k}) OVER {W}" for k, w in enumerate(_FFD))
    + " END AS v FROM bars)",
)
def fracdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    return rounded(bars.withColumn("fracdiff", lab.fracdiff(bars, d=0.4, thresh=1e-2)), ["symbol", "timestamp"], ["fracdiff"], digits=5)


@query(
    "fracdiff_full",
    f"""WITH RECURSIVE {PRIO}, w(k, v) AS (SELECT 0, CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, -v * (CAST(0.4 AS DOUBLE) - k) / (k + 1) FROM w WHERE abs(v * (CAST(0.4 AS DOUBLE) - k) / (k + 1)) >= 1e-4),
p AS (SELECT symbol, timestamp, close, row_number() OVER {W} AS i FROM bars),
s AS (SELECT a.symbol, a.timestamp, count(*) AS n, fsum(v * b.close) AS x FROM p a CROSS JOIN w JOIN p b ON b.symbol = a.symbol AND b.i = a.i - w.k GROUP BY a.symbol, a.timestamp)
SELECT symbol, {DAY}, CASE WHEN n = (SELECT count(*) FROM w) THEN round(x, 3) + 0.0 END AS fracdiff FROM s""",
)
def fracdiff_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights down to the operator's own threshold, 1e-4."""
    bars = priority_bars(spark, sf_dir)
    return rounded(bars.withColumn("fracdiff", lab.fracdiff(bars)), ["symbol", "timestamp"], ["fracdiff"], digits=3)


@query("min_ffd_d")
def min_ffd_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.min_ffd_d(priority_bars(spark, sf_dir), missing="null")


TRAIN_END, TEST_START = date(1996, 12, 30), date(1997, 1, 14)


@query(
    "split_summary",
    f"WITH {DATASET}, r AS (SELECT *, CASE WHEN timestamp <= DATE '{TRAIN_END}' THEN 'train' WHEN timestamp >= DATE '{TEST_START}' THEN 'test' END AS role FROM ds) SELECT role, count(*) AS rows, strftime(min(timestamp), '%Y-%m-%d') AS first, strftime(max(timestamp), '%Y-%m-%d') AS last, count(DISTINCT symbol) AS symbols FROM r WHERE role IS NOT NULL GROUP BY role",
)
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spl.summary(spl.with_role(_dataset(spark, sf_dir), TRAIN_END, TEST_START))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query(
    "split_bar_gaps",
    f"WITH {PRIO}, p AS (SELECT symbol, timestamp, row_number() OVER {W} AS pos FROM bars) SELECT symbol, min(pos) FILTER (WHERE timestamp >= DATE '{TEST_START}') - max(pos) FILTER (WHERE timestamp <= DATE '{TRAIN_END}') AS gap FROM p GROUP BY symbol",
)
def split_bar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spl.bar_gaps(priority_bars(spark, sf_dir), TRAIN_END, TEST_START).withColumn("gap", F.col("gap").cast("long"))


@query(
    "cpcv_counts",
    f"""WITH {PRIO}, e AS (SELECT symbol, timestamp, lead(timestamp, 5) OVER {W} AS t1 FROM bars), d AS (SELECT * FROM e WHERE t1 IS NOT NULL),
c AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) - 1 AS pos, ntile(6) OVER (ORDER BY timestamp) - 1 AS block FROM (SELECT DISTINCT timestamp FROM d)),
f AS (SELECT a.i AS a, b.i AS b, CAST(row_number() OVER (ORDER BY a.i, b.i) - 1 AS INTEGER) AS fold_id FROM range(6) a(i), range(6) b(i) WHERE a.i < b.i),
t AS (SELECT fold_id, block, min(pos) AS lo, max(pos) AS hi, min(timestamp) AS lt, max(timestamp) AS ht FROM f JOIN c ON c.block IN (f.a, f.b) GROUP BY ALL),
rows_ AS (SELECT fold_id, d.symbol, d.timestamp, bool_or(c.pos BETWEEN lo AND hi) AS te, bool_or(d.timestamp <= ht AND d.t1 >= lt) AS pu, bool_or(c.pos > hi AND c.pos <= hi + 5) AS em FROM d JOIN c USING (timestamp), t GROUP BY ALL)
SELECT fold_id, sum(CASE WHEN NOT te AND NOT pu AND NOT em THEN 1 ELSE 0 END)::BIGINT AS train, sum(te::INT)::BIGINT AS test, sum((NOT te AND pu)::INT)::BIGINT AS purged, sum((NOT te AND NOT pu AND em)::INT)::BIGINT AS embargoed FROM rows_ GROUP BY fold_id""",
)
def cpcv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = spl.label_ends(priority_bars(spark, sf_dir).select("symbol", "timestamp"), 5).where("t1 is not null")
    return spl.cpcv_counts(spl.cpcv_roles(ends, n=6, k=2, embargo=5))


@query("trial_variance", "SELECT count(*) AS n, round(var_samp(s), 6) AS variance FROM (VALUES " + ", ".join(f"({s})" for s in trials.TRIAL_SHARPES) + ") t(s)")
def trial_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trials(spark).agg(F.count("*").alias("n"), F.round(F.var_samp("sharpe"), 6).alias("variance"))


@query("deflated_sharpe")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = met.portfolio_returns(_scores(spark, sf_dir))
    d = met.deflated_from_returns(returns, trials.variance(trials.trials(spark)), trials.N_TRIALS)
    return spark.createDataFrame([(d.n, d.sharpe, d.threshold, d.z, d.dsr, d.verdict)], "n long, sharpe double, threshold double, z double, dsr double, verdict string")


@query(
    "permuted_labels",
    f"""WITH {SCORES}, n AS (SELECT symbol, timestamp, fwd, row_number() OVER (PARTITION BY timestamp ORDER BY symbol) AS i,
 row_number() OVER (PARTITION BY timestamp ORDER BY md5('42|1|' || strftime(timestamp, '%Y-%m-%d') || '|' || symbol), symbol) AS j FROM ok)
SELECT a.symbol, strftime(a.timestamp, '%Y-%m-%d') AS day, round(b.fwd, 6) + 0.0 AS fwd FROM n a JOIN n b ON a.timestamp = b.timestamp AND a.i = b.j""",
)
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the label that it is dealt."""
    return rounded(met.permute_within_dates(_scores(spark, sf_dir), 42, 1, "fwd"), ["symbol", "timestamp"], ["fwd"])


@query("null_summary", f"WITH {PF} SELECT round(quantile_cont(strategy_return, 0.5), 6) + 0.0 AS q50, round(quantile_cont(strategy_return, 0.95), 6) AS q95, round(min(strategy_return), 6) AS min, round(max(strategy_return), 6) AS max, round(avg(CASE WHEN strategy_return < 0.01 THEN 1.0 ELSE 0.0 END) * 100, 6) AS below_pct FROM pf")
def null_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = met.null_summary(met.portfolio_returns(_scores(spark, sf_dir)), 0.01, "strategy_return")
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) for c in out.columns])


SURVEYED = Research(horizon=5, embargo=5, train_end=TRAIN_END, test_start=TEST_START)


@query("run_baseline")
def run_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    start = pipelines.settle_start(SURVEYED, SURVEYED.horizon, bars, lab.forward_returns(bars, SURVEYED.horizon))
    return pipelines.run_baseline(bars, replace(SURVEYED, test_start=start)).metrics


@query("overfitting_gate")
def overfitting_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    data = mod.assemble(feat.production_matrix(bars), lab.forward_returns(bars, SURVEYED.horizon), feat.PRODUCTION)
    gate = pipelines.overfitting_gate(data, feat.PRODUCTION, SURVEYED, trading=bars, variance=trials.variance(trials.trials(spark)), trials=trials.N_TRIALS)
    return gate.merged


@query("meta_triage")
def meta_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.meta_triage(priority_bars(spark, sf_dir), SURVEYED)["classification"]


@query("triage")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.triage(priority_bars(spark, sf_dir), SURVEYED)


@query("universe_breadth")
def universe_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = priority_bars(spark, sf_dir)
    cfg = replace(SURVEYED, horizon=2, embargo=2)
    start = pipelines.settle_start(cfg, cfg.horizon, bars, lab.forward_returns(bars, cfg.horizon))
    found = pipelines.universe_breadth(bars, replace(cfg, test_start=start))
    return found.rows.withColumns({"symbols": F.lit(found.kept), "verdict": F.lit(found.verdict)})


@query("small_cap")
def small_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pipelines.small_cap(priority_bars(spark, sf_dir), SURVEYED)
    return found.rows.withColumns({"symbols": F.lit(found.kept), "verdict": F.lit(found.verdict)})


@query("momentum_probe")
def momentum_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.momentum_probe(priority_bars(spark, sf_dir), SURVEYED)


@query("window_bars", f"WITH {HOUR} SELECT symbol, strftime(timestamp, '%Y-%m-%d %H') AS hour, {r_sql(*OHLCV)} FROM bars")
def window_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bars = stream_bars(e, symbol=F.col("event_type"), price=F.col("value"), order=F.col("event_id"))
    return bars.select("symbol", F.date_format("timestamp", "yyyy-MM-dd HH").alias("hour"), *[F.round(c, 6).alias(c) for c in OHLCV])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
