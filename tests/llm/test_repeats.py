import collections
import hashlib
import random

import pytest

from barline.llm import substring_dedup, window_dedup
from barline.llm.common import ship


def covered(texts, width):
    seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    piece = lambda: "".join(rnd.choice("ab é") for _ in range(rnd.choice([0, 5, 30, 120])))
    pool = [piece() for _ in range(8)]
    docs = [(i, "".join(rnd.choice(pool)[rnd.randrange(0, 10) :] if rnd.random() < 0.6 else piece() for _ in range(rnd.randrange(0, 5)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "a" * 300), (3, docs[3][1]), (103, "ab" * 100), (104, " ".join(str(k % 7) for k in range(200)))]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, block int").repartition(3)


@pytest.mark.parametrize(("length", "batches"), [(20, 1), (20, 2), (7, 3)])
def test_bytes_match_brute_force(spark, length, batches):
    ship(spark)
    docs = corpus(length)
    want = collections.Counter()
    raw = [(t or "").encode() for _, t in docs]
    for (i, _), t, gone in zip(docs, raw, covered(raw, length)):
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want[i, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)] += 1
    got = substring_dedup.dedup(frame(spark, docs), length=length, batches=batches).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize(("length", "batches"), [(6, 2), (11, 4)])
def test_words_match_brute_force(spark, length, batches):
    ship(spark)
    docs = [(i, None if t is None else t.replace("a", " x ").replace("b", "y\t")) for i, t in corpus(length)]
    words = [tuple((t or "").encode().split()) for _, t in docs]
    want = collections.Counter()
    for (i, _), w, gone in zip(docs, words, covered(words, length)):
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)] += 1
    got = window_dedup.dedup(frame(spark, docs), length=length, batches=batches).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want


def test_pieces_of_a_very_long_text(spark, monkeypatch):
    """Windows of a text cut into pieces are the windows of the text."""
    import numpy as np

    from barline.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", (1 << 9) - 1)
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 5000).astype(np.uint8)
    a = repeats.Alphabet("byte", 20, 10)
    _, start, more, *_ = a.anchors(text, np.array([0, len(text)]))
    places = sorted(p for s, m in zip(start, more) for p in range(s, s + m + 1))
    assert places == list(range(5000 - 20 + 1))


def test_registered_batches_merge_levels_in_byte_order(spark, monkeypatch):
    """The second of the four batches merges with the first; a level is sorted by the bytes of its
    suffixes and agrees with the texts."""
    import numpy as np

    from barline.llm import repeats, vec

    ship(spark)
    seen = []
    scan = repeats.RepeatIndex.scan

    def spy(self, *args, **options):
        out = scan(self, *args, **options)
        seen.append((self, [n for n, _ in self.levels]))
        return out

    monkeypatch.setattr(repeats.RepeatIndex, "scan", spy)
    docs = frame(spark, corpus(20))
    substring_dedup.dedup(docs, length=20)
    assert [sizes for _, sizes in seen] == [[1], [2], [2, 1], [2, 1]]
    texts = {(t or "").encode() for _, t in corpus(20)}
    for part in seen[-1][0].levels[0][1].groupBy("part").agg({"block": "collect_list"}).collect():
        for block in part[1]:
            first = vec.unpack(block)[0].astype(">u8").view("S8")
            assert np.all(first[:-1] <= first[1:])
            assert all(any(x in t for t in texts) for x in first[:50].tolist())


def test_windows_beyond_the_packed_place_are_refused():
    from barline.llm.repeats import Alphabet

    with pytest.raises(ValueError, match="32767"):
        Alphabet("byte", 1 << 15, 100)


def test_contract_columns(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "w " * 40), (2, None)], "doc_id long, text string")
    one = {r.doc_id: r for r in substring_dedup.op1_suffix_dedup(docs).collect()}
    five = {r.doc_id: r for r in window_dedup.op5_window_dedup(docs).collect()}
    assert (one[1].n_bytes, one[1].n_removed, one[2].n_spans) == (80, 0, 0)
    assert (five[1].n_words, five[1].n_removed) == (40, 40)
    assert five[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring_dedup.op1_suffix_dedup(docs.limit(0)).count() == 0
