import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from barline.session import session

    s = session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _bars(spark, closes, symbol="AAA", start="2024-01-01", dividends=None, splits=None, volume=None):
    import pandas as pd

    days = pd.date_range(start, periods=len(closes), freq="D")
    rows = []
    for i, (d, c) in enumerate(zip(days, closes)):
        c = None if c is None else float(c)
        rows.append((symbol, d.to_pydatetime(), c, c, c, c, c, float(volume[i]) if volume else 1e6, float((dividends or {}).get(i, 0.0)), float((splits or {}).get(i, 0.0))))
    from barline.schema import BARS

    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="session")
def bars(spark):
    return lambda *a, **k: _bars(spark, *a, **k)
