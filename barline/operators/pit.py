"""Point-in-time joins and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


class LookaheadError(ValueError):
    """A row holds information from after its anchor."""


def lookahead_rows(df: DataFrame, anchor: str) -> DataFrame:
    """Rows in which another time column is later than ``anchor`` (NULLs do not count)."""
    other = [f.name for f in df.schema if isinstance(f.dataType, _TIMES) and f.name != anchor]
    if anchor not in df.columns:
        raise KeyError(anchor)
    late = F.lit(False)
    for c in other:
        late = late | F.coalesce(F.col(c) > F.col(anchor), F.lit(False))
    return df.where(late)


def assert_no_lookahead(df: DataFrame, anchor: str) -> DataFrame:
    if not lookahead_rows(df, anchor).isEmpty():
        raise LookaheadError(f"a time after {anchor}")
    return df


def asof_join(features: DataFrame, targets: DataFrame, *, on: str = "timestamp", by: list[str] | None = None, suffix: str = "_target", tolerance: str | None = None) -> DataFrame:
    """Each feature row with the latest target row at or before it (same ``by`` keys).

    One shuffle of the union of both sides by the keys; linear after the sort.  Keys of a side
    should be unique; where they are not, the last row in sort order is taken.  Target columns get
    ``suffix`` if they clash; the matched time is ``<on><suffix>``.
    """
    by = by or []
    rest = [c for c in targets.columns if c not in by]
    names = {c: (f"{c}{suffix}" if c == on or c in features.columns else c) for c in rest}
    left = features.select(*by, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.struct(*features.columns).alias("__f"), F.lit(None).cast(T.StructType([targets.schema[c] for c in rest])).alias("__x"))
    right = targets.select(*by, F.col(on).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(features.schema).alias("__f"), F.struct(*rest).alias("__x"))
    keys = by or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__m", F.last("__x", ignorenulls=True).over(w)).where("__side = 1")
    m = F.col("__m")
    if tolerance is not None:
        m = F.when(F.col("__t") - F.col(f"__m.{on}") <= F.expr(f"interval {tolerance}"), m)
    out = both.select("__f.*", m.alias("__m"))
    return out.select(*features.columns, *[F.col("__m")[c].alias(n) for c, n in names.items()])


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
