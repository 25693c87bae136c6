from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barline.bus import Bus, Command, Event, FrozenClock, SeededIds
from barline.contracts import MarketDataRequest, Order, OrderType, RiskCheck, Side
from barline.operators.models import identity_hash
from barline.sources.artifacts import ArtifactStore, Metadata, append_results, pending
from barline.streaming.bars import stream_bars

AT = datetime(2024, 1, 1, tzinfo=UTC)


def test_bus_order_and_channels():
    class Ping(Event):
        pass

    bus, seen = Bus(), []
    bus.on_event(Ping, lambda m: seen.append("a"))
    bus.on_event(Ping, lambda m: seen.append("b"))
    assert bus.publish(Ping("1", AT)) == 2 and seen == ["a", "b"]
    assert bus.publish(Event("2", AT)) == 0  # exact type only
    with pytest.raises(TypeError):
        bus.send(Ping("3", AT))
    with pytest.raises(TypeError):
        bus.on_command(Ping, print)
    with pytest.raises(ValueError):
        Command("4", datetime(2024, 1, 1))


def test_contract_checks():
    with pytest.raises(ValueError):
        Order("1", AT, "AAA", Side.BUY, OrderType.LIMIT, Decimal(1))
    with pytest.raises(ValueError):
        RiskCheck("1", AT, "o", True, ("x",))
    with pytest.raises(ValueError):
        MarketDataRequest(("a b",), date(2024, 1, 1), date(2024, 1, 2))
    assert SeededIds(1).new() == SeededIds(1).new()
    assert FrozenClock(AT).now() == AT


def meta(seed=42, features=("a", "b")):
    body = dict(features=features, hyperparameters={"b": 1, "a": 2}, universe=("X", "Y"), start="2015-01-01", end="2026-01-01", frequency="1d", seed=seed)
    h = identity_hash(features, body["hyperparameters"], body["universe"], date(2015, 1, 1), date(2026, 1, 1), "1d", seed)
    return Metadata("s", model_hash=h, **body)


def test_identity_hash_is_sensitive():
    assert meta().model_hash != meta(seed=43).model_hash != meta(features=("b", "a")).model_hash
    with pytest.raises(ValueError):
        Metadata(**{**meta().__dict__, "seed": 1})


def test_artifacts(spark, tmp_path):
    from pyspark.ml.feature import SQLTransformer

    store = ArtifactStore(spark, str(tmp_path))
    m = meta()
    store.save(SQLTransformer(statement="SELECT 1 FROM __THIS__"), m)
    with pytest.raises(FileExistsError):
        store.save(SQLTransformer(statement="SELECT 1 FROM __THIS__"), m)
    assert store.load(SQLTransformer, m.model_hash).getStatement() == "SELECT 1 FROM __THIS__"
    assert store.metadata(m.model_hash, ("a", "b")) == m
    with pytest.raises(ValueError):
        store.metadata(m.model_hash, ("a",))
    with pytest.raises(LookupError):
        store.find("0" * 64)
    store.write_sidecar(m.model_hash, {"x": 1})
    assert store.read_sidecar(m.model_hash) == {"x": 1}
    append_results(spark.createDataFrame([(0, 0.5)], "perm_id int, dsr double"), f"{tmp_path}/null")
    left = pending(spark.createDataFrame([(0,), (1,)], "perm_id int"), spark.read.parquet(f"{tmp_path}/null"))
    assert [r.perm_id for r in left.collect()] == [1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i // 4, (i * 17) % 60), f"S{i % 2}", float(i % 5)) for i in range(40)]
    ticks = spark.createDataFrame(rows, "id int, ts timestamp, s string, p double")
    ticks.write.parquet(f"{tmp_path}/ticks")
    make = lambda d: stream_bars(d, symbol=F.col("s"), price=F.col("p"), order=F.col("id"))
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks")
    q = make(stream).writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.symbol, r.timestamp)
    assert sorted(spark.table("bars_out").collect(), key=key) == sorted(make(ticks).collect(), key=key)
