"""Calendar splits with an embargo, and combinatorial purged cross-validation."""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.config import business_day
from barline.functions.windows import ws


class SplitError(ValueError):
    """The split leaks or leaves nothing."""


def calendar(df: DataFrame) -> DataFrame:
    """Sorted distinct timestamps of all symbols."""
    return df.select("timestamp").distinct()


def with_role(df: DataFrame, train_end: date, test_start: date) -> DataFrame:
    """``role`` train or test by date; rows between are dropped."""
    day = F.to_date("timestamp")
    role = F.when(day <= F.lit(train_end), "train").when(day >= F.lit(test_start), "test")
    return df.withColumn("role", role).where("role is not null")


def bar_gaps(df: DataFrame, train_end: date, test_start: date) -> DataFrame:
    """(symbol, gap) in bars between the last train and the first test row, counted before the split."""
    day = F.to_date("timestamp")
    pos = df.select("symbol", "timestamp").distinct().withColumn("pos", F.row_number().over(ws()))
    gap = F.min(F.when(day >= F.lit(test_start), F.col("pos"))) - F.max(F.when(day <= F.lit(train_end), F.col("pos")))
    return pos.groupBy("symbol").agg(gap.alias("gap")).where("gap is not null")


def embargo_split(df: DataFrame, train_end: date, test_start: date, horizon: int, *, embargo: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test), or an error if dates, calendar gap, bar gap or emptiness forbid it."""
    if test_start <= train_end:
        raise SplitError("test_start must be after train_end")
    if (test_start - train_end).days < (embargo or horizon):
        raise SplitError("calendar gap is shorter than the embargo")
    least = bar_gaps(df, train_end, test_start).agg(F.min("gap")).first()[0]
    if least is not None and least <= horizon:
        raise SplitError(f"bar gap {least} does not exceed the horizon {horizon}")
    split = with_role(df, train_end, test_start)
    sizes = {r["role"]: r["count"] for r in split.groupBy("role").count().collect()}
    if sizes.keys() != {"train", "test"}:
        raise SplitError("train or test is empty")
    return split.where("role = 'train'").drop("role"), split.where("role = 'test'").drop("role")


def summary(df: DataFrame) -> DataFrame:
    """Rows, first and last timestamp and symbols of each role."""
    return df.groupBy("role").agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_distinct("symbol").alias("symbols"))


def earliest_test_start(dates: DataFrame, train_end: date, horizon: int) -> date:
    """First date of the calendar more than ``horizon`` bars after the last train date; beyond its
    end, business days."""
    days = dates.select(F.to_date("timestamp").alias("d")).distinct()
    if days.where(F.col("d") <= F.lit(train_end)).isEmpty():
        raise SplitError("no date up to train_end")
    after = [r[0] for r in days.where(F.col("d") > F.lit(train_end)).orderBy("d").limit(horizon + 1).collect()]
    return after[horizon] if len(after) > horizon else business_day(train_end, horizon + 5)


def earliest_test_start_all(df: DataFrame, train_end: date, configured: date, horizon: int) -> date:
    """The latest such date over symbols, not before the configured one nor ``horizon`` calendar days."""
    from datetime import timedelta

    day = F.to_date("timestamp")
    pos = df.select("symbol", "timestamp").distinct().where(day > F.lit(train_end)).withColumn("pos", F.row_number().over(ws()))
    own = pos.where(F.col("pos") == horizon + 1).agg(F.max(F.to_date("timestamp"))).first()[0]
    return max(x for x in (own, configured, train_end + timedelta(days=horizon)) if x is not None)


def purge_barrier_ends(train: DataFrame, train_end: date) -> DataFrame:
    """Events whose barrier is reached after the training window go."""
    return train.where(F.to_date("t1") <= F.lit(train_end))


def cap_test(df: DataFrame, test_end: date) -> DataFrame:
    return df.where(F.to_date("timestamp") <= F.lit(test_end))


def blocks(dates: DataFrame, n: int) -> DataFrame:
    """(timestamp, pos, block): contiguous blocks, the first ones a row longer.

    The calendar is one row for each timestamp, however many symbols there are.
    """
    w = Window.orderBy("timestamp")
    return dates.select("timestamp").distinct().select("timestamp", (F.row_number().over(w) - 1).alias("pos"), (F.ntile(n).over(w) - 1).alias("block"))


def fold_blocks(spark, n: int, k: int) -> DataFrame:
    """(fold_id, block) of the test blocks of all combinations in lexicographic order."""
    if not 1 <= k < n or n < 2:
        raise SplitError("need 1 <= k < n")
    rows = [(i, b) for i, c in enumerate(combinations(range(n), k)) for b in c]
    return spark.createDataFrame(rows, "fold_id int, block int")


def test_runs(placed: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold_id, lo, hi, lo_ts, hi_ts): maximal runs of adjacent test blocks."""
    w = Window.partitionBy("fold_id").orderBy("block")
    runs = folds.withColumn("island", F.col("block") - F.row_number().over(w))
    edge = placed.groupBy("block").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("timestamp").alias("ta"), F.max("timestamp").alias("tb"))
    return runs.join(F.broadcast(edge), "block").groupBy("fold_id", "island").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.min("ta").alias("lo_ts"), F.max("tb").alias("hi_ts")).drop("island")


def label_ends(df: DataFrame, horizon: int, trading: DataFrame | None = None) -> DataFrame:
    """``df`` with ``t1``: the ``horizon``-th next timestamp of the trading calendar, or of the symbol."""
    if trading is None:
        own = df.select("symbol", "timestamp").distinct().withColumn("t1", F.lead("timestamp", horizon).over(ws()))
        return df.join(own, ["symbol", "timestamp"])
    ahead = calendar(trading).withColumn("t1", F.lead("timestamp", horizon).over(Window.orderBy("timestamp")))
    return df.join(ahead, "timestamp", "left")


def cpcv_roles(df: DataFrame, *, n: int = 6, k: int = 2, embargo: int = 5) -> DataFrame:
    """(fold_id, timestamp, symbol, role) of every row of ``df`` (timestamp, symbol, t1) in every fold.

    Test rows lie in a test block.  Others are purged if [timestamp, t1] meets a test run, else
    embargoed in the ``embargo`` timestamps after one, else train.  The folds are a fixed number, and
    runs are few, so the calendar side of the range condition is small whatever the panel holds.
    """
    spark = df.sparkSession
    placed = blocks(calendar(df), n)
    folds = fold_blocks(spark, n, k)
    runs = test_runs(placed, folds)
    cells = df.select("timestamp", "symbol", "t1").join(placed, "timestamp")
    # at most C(n, k) * k runs, fixed by the parameters
    joined = cells.join(F.broadcast(runs))
    hit = (F.col("timestamp") <= F.col("hi_ts")) & (F.col("t1") >= F.col("lo_ts"))
    inside = F.col("pos").between(F.col("lo"), F.col("hi"))
    late = (F.col("pos") > F.col("hi")) & (F.col("pos") <= F.col("hi") + embargo)
    roles = joined.groupBy("fold_id", "timestamp", "symbol").agg(F.bool_or(inside).alias("test"), F.bool_or(hit).alias("purged"), F.bool_or(late).alias("embargoed"))
    role = F.when(F.col("test"), "test").when(F.col("purged"), "purged").when(F.col("embargoed"), "embargoed").otherwise("train")
    return roles.select("fold_id", "timestamp", "symbol", role.alias("role"))


def cpcv_counts(roles: DataFrame) -> DataFrame:
    """Rows of each role in each fold."""
    count = {r: F.count_if(F.col("role") == r).alias(r) for r in ("train", "test", "purged", "embargoed")}
    return roles.groupBy("fold_id").agg(*count.values())


def check_cpcv(df: DataFrame, roles: DataFrame) -> DataFrame:
    """``roles``, or an error for rows without a label end and folds without training rows."""
    if not df.where("t1 is null").isEmpty():
        raise SplitError("missing t1 bar")
    if not cpcv_counts(roles).where("train = 0").isEmpty():
        raise SplitError("a fold has no training rows")
    return roles
