"""Boosted-tree models on assembled datasets.

Trees grow by depth here; a depth of 5 bounds the leaves at 32.  Fits are seeded and
deterministic for a given partitioning of the rows, so datasets are laid out by key first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from datetime import date
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.config import Research


#: Fits that run at once.  A boosting round is a chain of short jobs that wait for the driver, not for cores.
AT_ONCE = 8
T = TypeVar("T")


def at_once(spark: SparkSession, calls: Iterable[Callable[[], T]]) -> list[T]:
    """What each of the independent ``calls`` gives, in order; up to ``AT_ONCE`` of them run at a time."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda call: call()), list(calls), chunksize=1)


def assemble(features: DataFrame, labels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Inner join on (timestamp, symbol) without incomplete rows."""
    missing = [c for c in names if c not in features.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")
    kept = features.select("timestamp", "symbol", *names).join(labels, ["timestamp", "symbol"])
    return kept.dropna(subset=[*names, "label"])


def _vector(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="__v", handleInvalid="error").transform(df)


def parameters(cfg: Research) -> dict[str, object]:
    return {"maxIter": cfg.rounds, "stepSize": cfg.learning_rate, "maxDepth": cfg.max_depth, "minInstancesPerNode": cfg.min_leaf, "subsamplingRate": cfg.bagging_fraction, "featureSubsetStrategy": str(cfg.feature_fraction), "seed": cfg.seed}


def fit_regressor(train: DataFrame, names: tuple[str, ...], cfg: Research = Research()):
    from pyspark.ml.regression import GBTRegressor

    rows = _vector(train.repartitionByRange("timestamp", "symbol").sortWithinPartitions("timestamp", "symbol"), names)
    return GBTRegressor(featuresCol="__v", labelCol="label", predictionCol="score", **parameters(cfg)).fit(rows)


def fit_classifier(train: DataFrame, names: tuple[str, ...], cfg: Research = Research()):
    from pyspark.ml.classification import GBTClassifier

    rows = _vector(train.repartitionByRange("timestamp", "symbol").sortWithinPartitions("timestamp", "symbol"), names)
    return GBTClassifier(featuresCol="__v", labelCol="label", **parameters(cfg)).fit(rows)


def predict_scores(model, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(timestamp, symbol, score, fwd)."""
    return model.transform(_vector(df, names)).select("timestamp", "symbol", "score", F.col("label").alias("fwd"))


def predict_proba(model, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(_vector(df, names)).withColumn("proba", vector_to_array("probability")[1]).drop("__v", "rawPrediction", "probability", "prediction")


def identity_hash(features, hyperparameters, universe, start: date, end: date, frequency: str, seed: int) -> str:
    """SHA-256 of the compact JSON array [features, parameters by key, universe sorted, dates, frequency, seed]."""
    body = [list(features), dict(sorted(hyperparameters.items())), sorted(universe), start.isoformat(), end.isoformat(), frequency, seed]
    return hashlib.sha256(json.dumps(body, separators=(",", ":")).encode()).hexdigest()
