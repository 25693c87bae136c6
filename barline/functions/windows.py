"""Window shorthands: per symbol in time order, and per timestamp across symbols."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def ws():
    """Rows of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("timestamp")


def cum():
    """All rows of a symbol up to the current one."""
    return ws().rowsBetween(Window.unboundedPreceding, 0)


def wt():
    """All rows of a timestamp."""
    return Window.partitionBy("timestamp")


def last(n: int):
    """Frame of the last n rows of a symbol."""
    return ws().rowsBetween(-(n - 1), 0)


def full(n: int, x: Column, value: Column) -> Column:
    """``value`` where the frame holds n non-null x, else NULL: frames at the start are not shortened."""
    return F.when(F.count(x).over(last(n)) == n, value)


def lag(column: str, k: int = 1) -> Column:
    return F.lag(column, k).over(ws())
