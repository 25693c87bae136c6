"""A close of 0 on adjusted prices: the queries give what their SQL gives."""

import math

import numpy as np
import pytest

from barline.functions.ewm import Ewm, with_ewm
from barline.plans import registry


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """(folder, DuckDB) of events of four users on 40 days; the last price of one user on day 20 is 0."""
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path_factory.mktemp("zero")
    con = duckdb.connect()
    rng = np.random.default_rng(3)
    rows = [(d * 8 + u * 2 + i, d, u, 0.0 if (u, d, i) == (2, 20, 1) else round(float(rng.uniform(1, 90)), 2)) for d in range(40) for u in range(4) for i in range(2)]
    con.execute("create table raw (event_id bigint, d int, user_id bigint, value double)")
    con.executemany("insert into raw values (?, ?, ?, ?)", rows)
    con.execute(f"copy (select event_id, timestamp '2024-01-01' + to_days(d) as ts, user_id, 'x' as event_type, value from raw) to '{path}/events.parquet'")
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet')")
    return str(path), con


def same(a, b):
    if a is None or b is None or not isinstance(a, float):
        return a == b
    return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-7)


def test_feature_matrix_matches_its_sql_after_a_close_of_zero(spark, events):
    path, con = events
    cur = con.execute(registry.oracle_sql()["feature_matrix_36"])
    names = [d[0] for d in cur.description]
    want = {r[:2]: r for r in cur.fetchall()}
    got = {(r.symbol, r.day): tuple(r[n] for n in names) for r in registry.queries()["feature_matrix_36"](spark, path).collect()}
    assert names[:2] == ["symbol", "day"] and got.keys() == want.keys() and len(got) == 160
    assert math.isnan(want["2", "2024-01-21"][names.index("momentum_5")])
    for key in want:
        assert all(map(same, got[key], want[key])), [(n, a, b) for n, a, b in zip(names, got[key], want[key]) if not same(a, b)]


def test_nan_stays_in_exponential_means_beyond_two_blocks(bars):
    x = [1.0, math.nan] + [2.0] * 700
    last = with_ewm(bars(x), [Ewm.span("m", "close", 9, 1)]).orderBy("timestamp").select("m").collect()
    assert last[0].m == 1.0 and all(math.isnan(r.m) for r in last[1:])
