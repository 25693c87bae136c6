import inspect
from pathlib import Path

import pytest

from barline.operators import features as feat
from barline.operators import labels as lab
from barline.plans import pipelines, registry

SF = Path("/root/testdata/sf0.001")


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["run_baseline", "overfitting_gate", "meta_triage", "triage", "momentum_probe"])
def test_registered_runs_have_the_surveyed_parameters(spark, monkeypatch, name):
    if not SF.exists():
        pytest.skip("no test tables")
    real = inspect.signature(getattr(pipelines, name))

    def record(*a, **k):
        bound = real.bind(*a, **k)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    monkeypatch.setattr(registry.pipelines, name, record)
    with pytest.raises(Seen) as e:
        registry.queries()[name](spark, str(SF))
    seen = e.value.args[0]
    assert (seen["cfg"].rounds, seen["cfg"].min_leaf) == (100, 20)
    if name == "overfitting_gate":
        assert (seen["n"], seen["k"], tuple(seen["names"])) == (6, 2, feat.PRODUCTION)
        assert seen["trading"] is not None
    if name == "triage":
        assert seen["horizons"] == (2, 21) and len(seen["arms"] or feat.ARMS) == 5
    if name == "momentum_probe":
        assert seen["horizons"] == (63, 126)


def test_least_order_has_the_surveyed_threshold(spark, monkeypatch):
    if not SF.exists():
        pytest.skip("no test tables")
    got = {}
    monkeypatch.setattr(registry.lab, "min_ffd_d", lambda bars, missing, thresh=inspect.signature(lab.min_ffd_d).parameters["thresh"].default: got.update(thresh=thresh))
    registry.queries()["min_ffd_d"](spark, str(SF))
    assert got["thresh"] == 1e-4
