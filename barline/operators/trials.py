"""The logged research trials and the dispersion of their Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sharpe proxies of the logged trials, in order.
TRIAL_SHARPES = (
    0.075, 0.071, 0.071, 0.053, 0.035, 0.071, 0.103, 0.035, -0.035, -0.071, -0.064, -0.297, 0.329,
    0.239, 0.199, 0.375, 1.078, 0.075, 0.746, 0.492, 0.775, 0.335, 0.508, 0.049881, -0.074422,
)
N_TRIALS = 25


def trials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(TRIAL_SHARPES)], "trial int, sharpe double")


def variance(table: DataFrame) -> float:
    """Sample variance of at least two finite ratios."""
    row = table.agg(F.count("sharpe").alias("n"), F.var_samp("sharpe").alias("v")).first()
    if row.n < 2:
        raise ValueError("need two trials at least")
    return row.v
