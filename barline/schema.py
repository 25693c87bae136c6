"""Schemas of the data model and the checks at its boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close", "adj_close")
BARS = T.StructType(
    [T.StructField("symbol", T.StringType(), False), T.StructField("timestamp", T.TimestampType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume", "dividends", "splits")]
)
LABELS = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType()), T.StructField("label", T.DoubleType())])
META_EVENTS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("side", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("t1", T.TimestampType()),
        T.StructField("ret", T.DoubleType()),
    ]
)
SYMBOL_PATTERN = "^[A-Z0-9._-]+$"


class SchemaError(ValueError):
    """A frame does not have the columns that an operator needs."""


def validate_schema(df: DataFrame, expected: T.StructType, *, exact: bool = True) -> DataFrame:
    """``df`` unchanged, or an error that names every difference of name or type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name, 'missing')}" for f in expected if have.get(f.name) != f.dataType]
    extra = [c for c in have if c not in expected.fieldNames()] if exact else []
    if wrong or extra:
        raise SchemaError(f"wrong or missing: {wrong}; unexpected: {extra}")
    return df


def null_for_nan(df: DataFrame) -> DataFrame:
    """NULL in place of NaN in every floating column: aggregates skip NULL only."""
    fix = {f.name: F.when(F.isnan(f.name), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def violations(bars: DataFrame) -> DataFrame:
    """Rows of a bar table that break a constraint of the model, with the reason."""
    body = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    reason = (
        F.when(~F.col("symbol").rlike(SYMBOL_PATTERN), "symbol")
        .when((F.col("high") < body[0]) | (F.col("low") > body[1]), "geometry")
        .when(F.least("open", "high", "low", "close") <= 0, "price")
        .when((F.col("dividends") < 0) | (F.col("splits") < 0), "action")
        .when(F.col("volume") < 0, "volume")
    )
    return bars.withColumn("reason", reason).where("reason is not null")
