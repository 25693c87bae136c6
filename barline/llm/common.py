"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import ship as ship_package


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made, but in local mode only: executors elsewhere could
    not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "barline-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/barline-{tag}-{uuid.uuid4().hex}"


#: Paths written by ``materialise`` and not yet deleted, oldest first.
WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage
    with files that survive the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barline_path = path
    WRITTEN.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by ``materialise``."""
    path = getattr(df, "_barline_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what was written after the first ``since`` paths, but the files behind ``keep``: for a
    caller that has written the result and needs the steps before it no more."""
    kept = {getattr(df, "_barline_path", None) for df in keep}
    for path in WRITTEN[since:]:
        if path not in kept:
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(*cols: str) -> Column:
    """64-bit key of a row's content.  Equal rows share it on purpose: an operator that
    joins back on it treats repeated rows alike."""
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, and bound the texts that a worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ship_package(spark)
