import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import decontaminate, langid, lm_score, mixing, pii, toxicity
from barline.llm.common import ship

ODD = [
    "a@b.c_d@e.f", "a@b.c.d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111-", "x4111111111111111 9",
    "5 4111 1111 1111 1111", "4111  1111 1111 1111 1111", "+1 (234) 555-1234. +49 30 (1", "é😀 a.b@c.de 😀 10.0.0.1", "1 " * 20000, "a" * 50000 + "@", "9" * 30000,
    None, "", "41111111111111111111", "1.1.1.1" * 50, "+12 34-56.78(9)0", "@a.b a@b a@b. a@b.c.",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ):
        if kind == "email" and "@" not in t or kind == "email" and len(t) > 10000:
            continue
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t) if fine(m)]
    return ",".join(out)


def test_pii_patterns_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, base string")
    for r in pii.op3_pii(df).collect():
        want = base(ODD[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), ODD[r.doc_id]
        kinds = collections.Counter(x.split(":")[0] for x in want.split(",") if x)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
    assert pii.op3_pii(df.limit(0)).count() == 0


def test_pii_terms_that_disclose(spark):
    told = "mail bob@x.com or call Bobbington, at +1 (234) 555-1234 now"
    rows = [(1, told), (1, told), (2, None), (3, "call Bobbington about bob@x.com please"), (4, "if Bobbington bob@x.com"), (5, "Bob calls mail now please")]
    rows += [(10 + k, "call mail now about please call at if or") for k in range(6)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, terms int")
    out = collections.Counter((r.doc_id, r.text) for r in pii.sanitise(df, min_bits=0, remove_at=1.1).collect())
    assert out[4, "if <TERM> <EMAIL>"] == 1
    assert out[1, "mail <EMAIL> or call <TERM>, at <PHONE> now"] == 2
    assert out[2, None] == 1 and out[5, "Bob calls mail now please"] == 1
    gone = {r.doc_id: r.text for r in pii.sanitise(df, min_bits=0).collect()}
    assert gone[4] == "if  <EMAIL>"


def test_pii_telling_terms_go_at_every_place(spark):
    filler = " word" * 20
    rows = [(i, f"write to bob@x.com{filler} Bobbington") for i in range(4)] + [(10, "alone stands bobbington here, Bobbington")]
    rows += [(20 + i, f"this is a text{filler} write here alone stands number") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df, min_bits=0, remove_at=1.1).collect()}
    assert out[10] == "alone stands <TERM> here, <TERM>"
    assert out[0] == f"write to <EMAIL>{filler} <TERM>"
    assert out[20] == rows[-6][1]


def test_pii_hot_entity_with_the_defaults(spark):
    rows = [(i, "ask Bobbington at bob@x.com now") for i in range(100)]
    rows += [(100 + i, "ask now at this other place of number") for i in range(200)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[i] for i in range(100)} == {"ask  at <EMAIL> now"}
    assert {out[i] for i in range(100, 300)} == {rows[-1][1]}


def test_pii_documents_of_terms(spark):
    docs = spark.createDataFrame([("one two three",), ("Two four two",), (None,)], "text string")
    terms = spark.createDataFrame([("two",), ("four",), ("nine",)], "term string")
    assert sorted(map(tuple, pii.term_documents(docs, terms, "text").select("term", "df").collect())) == [("four", 1), ("two", 2)]


def test_pii_terms_match_brute_force(spark):
    """Added terms of the defaults, counted by plain loops over a corpus with hot and rare entities."""
    rng = np.random.default_rng(11)
    mails = ["hot@x.com", "warm@x.com", "cold@y.org", "rare@z.net"]
    names = ["Hotter", "Warmer", "Colder", "Rarest"]
    words = [f"word{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(300):
        text = list(rng.choice(words, 6))
        k = int(rng.choice(6, p=[0.3, 0.1, 0.03, 0.01, 0.28, 0.28]))
        if k < 4:
            text += [mails[k]] * (rng.random() < 0.9) + [names[k]] * (rng.random() < 0.8)
        rows.append((i, " ".join(rng.permutation(text))))
    docs = [({w.lower() for w in t.split() if "@" not in w}, {w for w in t.split() if "@" in w}) for _, t in rows]
    df, de = collections.Counter(w for ws, _ in docs for w in ws), collections.Counter(e for _, es in docs for e in es)
    both = collections.Counter((e, w) for ws, es in docs for e in es for w in ws)
    told = {w for (e, w), n in both.items() if n >= 3 and de[e] >= 3 and n / df[w] >= 0.5 and math.log2(n / df[w] * len(rows) / de[e]) >= 0.5 * math.log2(len(rows) / de[e])}
    assert {"hotter", "warmer", "colder"} <= told and not told & set(words)
    got = {r.doc_id: sorted((s.start, s.end) for s in r.terms) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [m.span() for m in re.finditer(r"\S+", t) if m.group().lower() in told] for i, t in rows}


def test_pii_text_of_very_many_matches(spark):
    """20,000 matches and code points beyond the basic plane: every place is right."""
    text = " ".join(f"é😀 u{k}@ex.org 10.0.{k % 256}.{k % 7}" for k in range(10000))
    df = spark.createDataFrame([(1, text), (2, "b@ex.org")], "doc_id long, text string")
    r = next(r for r in pii.op3_pii(df).collect() if r.doc_id == 1)
    assert (r.n_email, r.n_ip) == (10000, 10000)
    want = [f"{k}:{m.start()}:{m.end()}" for k, p in (("email", r"u\d+@ex\.org"), ("ip", r"10\.0\.\d+\.\d+")) for m in re.finditer(p, text)]
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean == {1: " ".join(["é😀 <EMAIL> <IP>"] * 10000), 2: "<EMAIL>"}


def contaminated(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    win = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            win[tuple(w[k : k + width])].add("null" if i is None else str(i))
    out = collections.Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in win}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in win:
                    hit.update(range(k, k + size))
                    found |= win[tuple(w[k : k + size])]
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("bound", [100_000, 0])
def test_decontamination_matches_brute_force(spark, monkeypatch, bound):
    docs = [(1, "the cat"), (2, None), (3, ""), (4, "The CAT the cat sat É é"), (5, "x a b c d e f g h i j k"), (5, "x a b c d e f g h i j k"), (6, "a b c d e f g h i")]
    items = [(1, "The cat"), (10, "cat THE"), (2, "A B c d e f g h i j"), (None, "é"), (3, None), (3, "... "), (7, "zz zz")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, win int")
    b = spark.createDataFrame(items, "item_id long, text string")
    real = decontaminate.find
    monkeypatch.setattr(decontaminate, "find", lambda *a, **k: real(*a, **k | {"broadcast_rows": bound}))
    got = collections.Counter(tuple(r) for r in decontaminate.op2_decontaminate(d, b).collect())
    assert got == contaminated(docs, items)
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(d, b).collect()) == [2, 3, 6]
    assert decontaminate.op2_decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.op2_decontaminate(d, b.limit(0)).where("contaminated").count() == 0


def fair(sizes, weights, cap=3):
    """Targets by the contract's rounds: cap and reshare until nobody is above."""
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in done]
        left = total - sum(done.values())
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def test_mixing_targets_and_places(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 7) ** 2 // 8)}", 1) for i in range(600)]
    rows += [(900 + k, "a b c", "tiny", 1) for k in range(2)] + [(950, "x " * 80, None, 1), (951, None, "s1", 1), (952, "", None, 1), (7, rows[7][1], rows[7][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fair(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.first_slot is None) == (r.taken == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    assert mixing.op6_mixing(df.limit(0)).count() == 0
    assert mixing.op6_mixing(df.where("text is null")).first().taken == 0


@pytest.mark.parametrize("block", [256, 3])
def test_mixing_takes_the_rounded_target_of_every_source(spark, block):
    sizes = {f"big{k}": 9000 + 700 * k for k in range(3)} | {f"tiny{k}": 3 + 9 * k for k in range(12)} | {"none": 0}
    rows = [(i, "w " * n, s) for i, (s, size) in enumerate(sizes.items()) for n in [size // 3, size - size // 3]]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block).collect()
    taken, target = collections.Counter(), {r.source: r.target for r in out}
    for r in out:
        taken[r.source] += r.taken
        assert (r.first_slot is None) == (r.taken == 0)
    assert {s: taken[s] for s in sizes} == {s: math.floor(target[s] + 0.5) for s in sizes}


LANGS = {"xx": "kra tul vem zo brik", "yy": "ail oue lent euri seau", "zz": "ñor que lladé cíon asto"}


def speech(rng, lang, n=40):
    return " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "a", "e"]) for _ in range(n))


def test_language_identification(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    rows = [(i, speech(rng, lang), lang, "s") for i, lang in enumerate(list(LANGS) * 80)]
    rows += [(900, None, "xx", "s"), (901, "123 --", "xx", "s"), (902, "", None, "s"), (903, speech(rng, "zz", 20000), None, "s"), (None, speech(rng, "yy"), "yy", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in langid.op8_langid(df).collect()}
    import zlib

    for i, _, lang, _ in rows:
        if i is not None:
            assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    known = [r for r in rows if r[0] is not None and r[0] < 900]
    assert np.mean([out[i].lang_pred == lang for i, _, lang, _ in known if out[i].held_out]) > 0.95
    assert [out[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "zz", "yy"]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.op8_langid(df.limit(0)).count() == 0


def test_language_pieces_lose_and_add_no_ngram(monkeypatch):
    texts = ["", "a", "Straße über den Ðé 12", "İx" * 40, "abcdefghij" * 7]
    whole = [(tuple(i), tuple(n)) for i, n in langid.counts_per_text(texts)]
    model = langid.LanguageModel(["x", "y"], np.ones(langid.SIZE), np.random.default_rng(1).normal(size=(langid.SIZE, 2)), 1.0)
    logits = model.logits(texts)
    monkeypatch.setattr(langid, "_PIECE", 5)
    assert [(tuple(i), tuple(n)) for i, n in langid.counts_per_text(texts)] == whole
    assert model.logits(texts) == pytest.approx(logits, rel=1e-6, abs=1e-6)
    # against a plain loop over the n-grams
    for t, row in zip(texts, logits):
        p = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in f" {t.lower()}  ")
        grams = [langid.ngram_ids([p[k : k + 3]])[0][:, 0] for k in range(len(p) - 2)]
        want = sum(model.weights[g].sum(axis=0) for g in grams) * langid.SCALE / (3 * len(grams))
        assert row == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_toxicity_is_learned(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(700):
        bad = int(i % 3 == 0)
        t = speech(rng, "xx").split()
        if bad:
            t[int(rng.integers(len(t)))] = rng.choice(["scumbag", "Scumlord", "scummy"])
        rows.append((i, " ".join(t), "xx", 0.0))
        labels.append((i, bad, bad))
    rows += [(900, None, None, 0.0), (901, "", None, 0.0), (902, speech(rng, "yy", 90000) + " scumbag", None, 0.0), (None, "scummy", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.op4_toxicity(df, lab).collect()}
    held = [(out[i].predicted, bad) for i, _, bad in labels if out[i].held_out]
    assert len(held) > 100 and np.mean([p == b for p, b in held]) > 0.95
    assert len(out) == len(rows) and out[902].predicted == 1 and out[901].predicted == 0
    assert toxicity.op4_toxicity(df.limit(0), lab).count() == 0


def brute_losses(docs, target, vocabulary, smoothing, backoff, counted):
    """(target, background) loss of each text with a word by plain counting."""
    texts = [(i, ["<s>", *(t or "").lower().split()]) for i, t in docs]

    def model(rows):
        word, hist, pair = collections.Counter(), collections.Counter(), collections.Counter()
        for w in rows:
            word.update(w[1:])
            hist.update(w[:-1])
            pair.update(zip(w, w[1:]))
        return word, hist, pair, sum(word.values())

    sides = [[w for i, w in texts if (i in target) == (k == 0)] for k in (0, 1)]
    size = [sum(len(w) - 1 for w in side) for side in sides]
    out = []
    for i, w in texts:
        both = []
        for k, side in enumerate(sides):
            rest = list(side)
            if counted and w in rest and (i in target) == (k == 0):
                rest.remove(w)
            word, hist, pair, total = model(rest)
            r = min(size) / size[k]
            both.append(np.mean([-math.log((r * pair[h, x] + backoff * (r * word[x] + smoothing) / (r * total + smoothing * vocabulary)) / (r * hist[h] + backoff)) for h, x in zip(w, w[1:])]) if len(w) > 1 else None)
        out.append((i, len(w) - 1, *both))
    return out


@pytest.mark.parametrize("counted", [False, True])
def test_language_model_scores_match_brute_force(spark, counted):
    ship(spark)
    shape = lm_score.Shape(word_bits=16)
    docs = [(0, "a b a c"), (1, "A b b"), (2, "c c\tc a"), (3, None), (4, " "), (1, "A b b")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_tokens int").repartition(3)
    ids = spark.createDataFrame([(1,), (None,)], "doc_id long")
    if counted:
        out = lm_score.fit_score(df, ids, shape=shape)
    else:
        models = lm_score.fit(df, ids, shape=shape)
        out = lm_score.score(df, models, keep=["doc_id"])
        assert lm_score.score(df.limit(0), models, keep=["doc_id"]).count() == 0
    got = sorted(map(tuple, out.collect()))
    for r, (i, n, a, b) in zip(got, sorted(brute_losses(docs, {1}, 1 << 16, 0.5, 8.0, counted))):
        assert r[:2] == (i, n)
        assert r[2:] == ((None,) * 3 if n == 0 else pytest.approx((a, b, a - b), rel=1e-9))


@pytest.mark.parametrize("counted", [False, True])
def test_language_model_counts_are_exact_at_any_vocabulary(spark, counted):
    ship(spark)
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ids, shape = spark.createDataFrame([(i,) for i in range(9)], "doc_id long"), lm_score.Shape(word_bits=4)
    words = len({x for _, t in docs for x in t.split()})
    out = lm_score.fit_score(df, ids, shape=shape) if counted else lm_score.score(df, lm_score.fit(df, ids, shape=shape), keep=["doc_id"])
    got = {r.doc_id: r for r in out.collect()}
    for i, _, a, b in brute_losses(docs, set(range(9)), words, 0.5, 8.0, counted):
        assert (got[i].ce_target, got[i].ce_background) == pytest.approx((a, b), rel=1e-9)


def test_language_model_tells_documents_that_occur_twice(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 40))) for i in range(60)]
    docs += [(100, docs[50][1]), (101, docs[51][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = lm_score.fit_score(df, spark.createDataFrame([(i,) for i in range(9)], "doc_id long"))
    ranked = [r.doc_id for r in out.orderBy("ce_background").collect()]
    assert set(ranked[:4]) == {50, 51, 100, 101}


def test_language_model_without_a_target_is_uniform(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    assert {r.score for r in lm_score.fit_score(df, df.select("doc_id").limit(0)).collect()} == {0.0}


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows = [(i, speech(rng, lang, 60), lang, f"s{i % 2}", 0) for i, lang in enumerate(list(LANGS) * 20)]
    leak = "one two three four five six seven eight nine ten eleven"
    rows += [(100, rows[0][1] + " more", "xx", "s0", 0), (101, "pre " + leak, "yy", "s0", 0), (102, "12 34", None, "s1", 0), (103, rows[1][1][::-1] + " a@b.cd", "yy", "s1", 0)]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixture":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everyone = {r[0] for r in rows}
    assert left["language"] == everyone - {102}
    assert left["near_duplicates"] == left["language"] - {100}
    assert left["decontamination"] == left["privacy"] == left["mixture"] == left["near_duplicates"] - {101}
    text = spark.read.parquet(f"{tmp_path}/privacy").where("doc_id = 103").first().text
    assert text.endswith("<EMAIL>") and "@" not in text
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("taken") > 0).count() > 0
