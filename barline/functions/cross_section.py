"""Cross-sectional columns: rank and z-score of a column among the symbols of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barline.functions.windows import wt


def rank(x: str, by: tuple[str, ...] = ("timestamp",)) -> Column:
    """Average-tie rank; NULL for NULL."""
    order = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    # rows of equal value are the peers of the rank's own order: one sort for both
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def cs_rank(x: str) -> Column:
    """Average-tie rank over the number of known values."""
    return rank(x) / F.count(x).over(wt())


def cs_zscore(x: str) -> Column:
    """Distance from the mean in population deviations; 0 for a lone or constant cross-section."""
    flat = F.max(x).over(wt()) == F.min(x).over(wt())
    z = F.try_divide(F.col(x) - F.avg(x).over(wt()), F.stddev_pop(x).over(wt()))
    return F.when(F.col(x).isNotNull(), F.when(flat, 0.0).otherwise(F.coalesce(z, F.lit(0.0))))
