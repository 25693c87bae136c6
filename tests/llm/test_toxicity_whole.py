"""The toxicity model and its thresholds come from all labelled rows, in one shard or in many."""

import numpy as np
import pytest

from barline.llm import toxicity
from barline.llm.common import ship

WORDS = [f"w{i}" for i in range(300)]


def labelled(spark, n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        bad = int(i % 4 == 0)
        t = list(rng.choice(WORDS, int(rng.integers(3, 12))))
        if bad:
            t[int(rng.integers(len(t)))] = "scummy"
        rows.append((" ".join(t), bad, "xx", i))
    return spark.createDataFrame([*rows, (None, 1, "xx", n), ("w1", None, "xx", n + 1), ("w1 w2", 7, "xx", n + 2)], "text string, toxic int, lang string, doc_id int")


@pytest.mark.parametrize("shard_rows", [20000, 700])
def test_all_labelled_rows_are_learned_and_set_the_thresholds(spark, monkeypatch, shard_rows):
    ship(spark)
    n, learned, counted = 9000, [], []
    summed, thresholds = toxicity._sum_of_shards, toxicity.threshold_counts

    def sums(rows, n_shards, *a):
        out = summed(rows, n_shards, *a)
        learned.append((out.rows, n_shards))
        return out

    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(toxicity, "_sum_of_shards", sums)
    monkeypatch.setattr(toxicity, "threshold_counts", lambda *a: counted.extend(thresholds(*a)) or counted)
    model = toxicity.fit(labelled(spark, n))
    # the whole model learns all rows, the models of the halves together all rows again
    assert sum(rows for rows, _ in learned) == 2 * n
    assert max(shards for _, shards in learned) == (1 if shard_rows > n else -(-n // shard_rows) - 1)
    assert sum(r[3] for r in counted) == n and sum(r[3] for r in counted if r[2] == 1) == n // 4
    assert model.prior == 0.25
    import pyarrow as pa

    rng = np.random.default_rng(6)
    clean = [" ".join(rng.choice(WORDS, 8)) for _ in range(200)]
    assert (model.score(pa.array(clean)) < 0.5).mean() > 0.97
    assert (model.score(pa.array([c + " scummy" for c in clean])) >= 0.5).mean() > 0.97


def test_thresholds_of_counts_equal_those_of_rows():
    rng = np.random.default_rng(7)
    z, y = np.round(rng.normal(0, 2, 500) * 4) / 4, (rng.random(500) < 0.3).astype(float)
    pairs = sorted(set(zip(z, y)))
    weight = np.array([np.sum((z == a) & (y == b)) for a, b in pairs], dtype=float)
    got = toxicity.best_threshold(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), weight)
    assert got == toxicity.best_threshold(z, y, np.ones(500))
