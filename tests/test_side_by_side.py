"""Independent fits of a run overlap, and their results stay in order."""

import threading
from datetime import date

import pytest

from barline.config import Research
from barline.operators import models as mod
from barline.plans import pipelines as pipe

WAIT = 60


def test_results_keep_their_order(spark):
    assert mod.at_once(spark, [lambda i=i: i for i in range(20)]) == list(range(20))
    with pytest.raises(KeyError):
        mod.at_once(spark, [lambda: {}["x"], lambda: 1])


def test_folds_are_fitted_side_by_side(spark):
    two = threading.Barrier(2)
    data = spark.range(4).selectExpr("cast(id as timestamp) as timestamp", "'A' as symbol", "1.0 as label")
    roles = data.selectExpr("explode(array(0, 1)) as fold_id", "timestamp", "symbol", "if(fold_id = 0, 'test', 'train') as role")

    def one(train, test):
        two.wait(WAIT)  # one fold after the other never gets past this
        return test.selectExpr("timestamp", "label as strategy_return")

    paths = pipe._paths(data, roles, 2, one)
    assert [r.fold_id for r in paths.collect()] == [0] * 4


def test_arms_are_fitted_side_by_side(spark, bars, monkeypatch):
    two = threading.Barrier(2)

    def scored(data, names, cfg):
        two.wait(WAIT)
        return None, data.selectExpr("timestamp", "symbol", f"{names[0]} as score", "label as fwd"), None

    monkeypatch.setattr(pipe, "_scored", scored)
    monkeypatch.setattr(pipe, "settle_start", lambda cfg, *a: cfg.test_start)
    panel = bars([100 + i % 7 for i in range(60)]).unionByName(bars([90 + i % 5 for i in range(60)], symbol="BBB"))
    cfg = Research(train_end=date(2024, 2, 1), test_start=date(2024, 2, 26))
    rows = pipe.triage(panel, cfg, (2, 21), {"a": ("reversal_5",)}).collect()
    assert [(r.arm, r.arm_order, r.horizon) for r in rows] == [("a", 0, 2), ("a", 0, 21)]
    assert all(r.n_dates > 0 and r.median_breadth == 2 for r in rows)
