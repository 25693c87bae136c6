"""Scans that end in the canonical bar table: one row for each symbol and timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.schema import BARS, SchemaError, null_for_nan

VENDOR = {"open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "adj_close", "volume": "volume"}


def read_bars(spark: SparkSession, path: str, *, fmt: str = "parquet", symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from files of the canonical schema; the symbol list and the date range reach the scan."""
    df = spark.read.schema(BARS).format(fmt).load(path)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return null_for_nan(df)


def canonical_names(df: DataFrame) -> DataFrame:
    """Vendor headers as lower-case names with underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def canonicalise(df: DataFrame, symbol: Column, *, timestamp: str = "date") -> DataFrame:
    """Vendor columns of one or many symbols as bars.  Missing columns are an error, missing actions
    in a present column are 0; naive timestamps are UTC."""
    df = canonical_names(df)
    needed = [timestamp, *VENDOR, "dividends", "stock_splits"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    prices = [F.col(v).cast("double").alias(k) for k, v in VENDOR.items()]
    actions = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in (("dividends", "dividends"), ("stock_splits", "splits"))]
    return null_for_nan(df.select(symbol.alias("symbol"), F.col(timestamp).cast("timestamp").alias("timestamp"), *prices, *actions))


def unpivot_wide(df: DataFrame, symbols: list[str], *, timestamp: str = "Date", sep: str = "|") -> DataFrame:
    """Wide columns ``field|symbol`` or ``symbol|field`` as one row for each symbol and date.

    A symbol without any column is an error.
    """
    fields = sorted({p for c in df.columns if sep in c for p in c.split(sep)} - set(symbols))
    parts = []
    for s in symbols:
        cols = {f: next((c for c in (f"{f}{sep}{s}", f"{s}{sep}{f}") if c in df.columns), None) for f in fields}
        if not any(cols.values()):
            raise SchemaError(f"no columns for {s}")
        parts.append(F.struct(F.lit(s).alias("symbol"), *[(F.col(f"`{c}`") if c else F.lit(None)).cast("double").alias(f) for f, c in cols.items()]))
    return df.select(F.col(timestamp), F.explode(F.array(*parts)).alias("x")).select(timestamp, "x.*")


def alias(symbol: Column, aliases: dict[str, str]) -> Column:
    """Vendor name of a symbol: its alias or itself."""
    if not aliases:
        return symbol
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, symbol), symbol)


def decimal_rows(bars: DataFrame, symbol: str) -> DataFrame:
    """One symbol's bars with exact decimals of the shortest text of each number."""
    exact = [F.col(c).cast("string").cast(T.DecimalType(38, 18)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return bars.where(F.col("symbol") == symbol).select("symbol", "timestamp", *exact)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_ticks(df: DataFrame, symbol: Column, timestamp: Column, price: Column, order: Column) -> DataFrame:
    """First, highest, lowest and last price of each cell, and the number of ticks."""
    ticks = df.select(symbol.alias("symbol"), timestamp.alias("timestamp"), price.alias("p"), order.alias("o"))
    bars = ticks.groupBy("symbol", "timestamp").agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    paid = F.when(F.dayofmonth("timestamp") == 15, F.col("close") * 0.01).otherwise(0.0)
    return bars.withColumns({"adj_close": F.col("close"), "dividends": paid, "splits": F.lit(0.0)})


def priority_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority: few symbols, long histories."""
    t = _table(spark, sf_dir, "orders")
    return _from_ticks(t, F.col("o_orderpriority"), F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values by user: many symbols, short histories."""
    t = _table(spark, sf_dir, "events")
    return _from_ticks(t, F.col("user_id").cast("string"), F.to_date("ts"), F.col("value"), F.struct("ts", "event_id"))


def event_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by type, with gaps."""
    t = _table(spark, sf_dir, "events")
    return _from_ticks(t, F.col("event_type"), F.date_trunc("hour", F.col("ts")), F.col("value"), F.struct("ts", "event_id"))
