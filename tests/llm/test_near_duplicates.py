import collections
import random
import re

import numpy as np
import pytest

from barline.llm import cap_filters, minhash
from barline.llm.common import ship
from barline.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(parent, i)] = min(d, least.get(find(parent, i), 1 << 60))
    return collections.Counter((d, len(sets[i]), least[find(parent, i)], d == least[find(parent, i)]) for i, (d, _) in enumerate(docs))


def copies(seed, groups=20, most=12, edits=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 6, 20, 60]))]
        for _ in range(rnd.randrange(1, most)):
            own = list(base)
            for _ in range(rnd.randrange(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(words).upper()
            docs.append((len(docs), " ".join(own)))
    return docs


def near_group(seed):
    """One large group: many copies beyond the threshold from the middle, some of them linked to each other only."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    docs, line = [], []
    for i in range(120):
        own = list(line[-1] if line and rnd.random() < 0.3 else base)
        for _ in range(rnd.randrange(1, 7)):
            own[rnd.randrange(80)] = f"x{rnd.randrange(400)}"
        line.append(own)
        docs.append((i, " ".join(own)))
    return docs


@pytest.mark.parametrize("docs", [copies(3) + [(900, None), (901, ""), (902, " \n"), (903, "ab"), (904, "AB")], near_group(1), near_group(2)])
def test_groups_match_brute_force(spark, docs):
    ship(spark)
    docs = [*docs, docs[5]]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, set int").repartition(3)
    assert collections.Counter(map(tuple, minhash.op9_minhash(df).collect())) == brute(docs)


def test_one_row_of_each_group_stays(spark):
    ship(spark)
    docs = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (3, None), (3, None), (4, "other words stand here alone")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.keep_one(df, size=5).collect()) == [1, 3, 3, 4]
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_groups_without_a_key_or_with_one_key_stay_apart(spark):
    ship(spark)
    docs = [(None, "a b c d e f g"), (None, "A b c d e f g"), (None, "other words stand here alone"), (5, "one text of number five is this"), (5, "quite another with the same number here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    left = [(r.doc_id, r.text.lower()) for r in minhash.keep_one(df, size=5).collect()]
    assert sorted(t for _, t in left) == sorted({t.lower() for _, t in docs})
    assert len(left) == 4


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = np.unique(pool[:200]), np.unique(pool[100:])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.06
    assert (minhash.signatures(a, np.array([0, len(a)]), 96) == minhash.signatures(a[::-1].copy(), np.array([0, len(a)]), 96)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (1, 0)]
    out = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def brute_vectors(rows):
    unit = []
    for _, label, v in rows:
        good = label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    parent, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, r in enumerate(rows):
        least[find(parent, i)] = min(r[0], least.get(find(parent, i), 1 << 60))
    return collections.Counter((r[0], links[i], least[find(parent, i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize(("dim", "n"), [(16, 1000), (64, 1000), (256, 1000), (64, 10**5), (256, 10**6)])
def test_planted_pairs_share_a_filter(dim, n):
    size = cap_filters.code_size(n)
    rng = np.random.default_rng(dim)
    a, z = rng.normal(size=(2, 5000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    one, two = cap_filters.decode(a, *size), cap_filters.decode(b, *size)
    assert min(map(len, one)) > 0
    assert sum(not set(x) & set(y) for x, y in zip(one, two)) == 0
    assert (np.bitwise_count(cap_filters.sketch(a) ^ cap_filters.sketch(b)).sum(axis=1) <= cap_filters.most_signs(0.93)).all()


def test_unrelated_vectors_meet_less_often_the_more_there_are():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for n in (2_000, 50_000, 1_000_000):
        f = np.array(cap_filters.decode(x, *cap_filters.code_size(n)))
        met = np.mean([bool(np.intersect1d(f[i], f[i + 1]).size) for i in range(0, 1000, 2)])
        shares.append(met)
    assert shares[0] > 3 * shares[1] and shares[1] > 3 * shares[2]


@pytest.mark.parametrize(("cut", "dim", "size"), [(2048, 16, None), (3, 16, None), (2048, 64, (128, 3)), (3, 64, (256, 3))])
def test_vectors_match_brute_force(spark, monkeypatch, cut, dim, size):
    ship(spark)
    if size:
        monkeypatch.setattr(cap_filters, "code_size", lambda n: size)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        middle = rng.normal(size=dim)
        rows += [(len(rows) + k, g % 3 if g else None, [float(x) for x in np.float32(middle + rng.normal(size=dim) * 0.25)]) for k in range(10)]
    rows += [(500, 1, None), (501, 1, []), (502, 1, [0.0] * 16), (503, 1, [None] + [1.0] * 15), (504, 1, [float("nan")] * 16), (505, 1, [float("inf")] + [1.0] * 15)]
    rows += [(506, 1, [1.0, 2.0]), (507, 1, [1.0, 2.0]), (20, rows[20][1], rows[20][2]), (508, 2, [3.0])]
    df = spark.createDataFrame([(a, b, c, 7) for a, b, c in rows], "vec_id long, label int, embedding array<float>, cid int")
    got = cap_filters.near_duplicates(df, cut=cut).collect()
    assert collections.Counter(map(tuple, got)) == brute_vectors(rows)
    assert cap_filters.op7_caps(df.limit(0)).count() == 0
