"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of the hashed embeddings of itself, its first 3, 4 and 5 bytes and its last
4, so that inflected and compound forms share what was learned; filters of widths 1, 2 and 3 slide over the
whole text, the maximum over positions feeds a logistic layer.  After training, the score
is shifted so that 0.5 stands at the threshold that is best for the language of the text;
that language is itself predicted from the text.

The model learns every labelled training row, both classes weighing the same, in shards whose models are
averaged; the thresholds are the best over every labelled training row, each scored by a model that has not
learned its text.
"""

from __future__ import annotations

import copy
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import langid, vec
from barline.llm.common import discard, materialise

VOCAB_BITS = 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
SPAN = 1 << 16
#: Rows and characters that a task learns from at a time.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 23
#: Rows of a shard up to MAX_SHARDS shards, more beyond; fewer rows than LEAST_VISITS are learned several times.
SHARD_ROWS, MAX_SHARDS, LEAST_VISITS = 20000, 64, 36000
#: Thresholds are told apart to a 256th of the log-odds.
BINS = 256
VIEWS = (
    vec.whole,
    lambda s, e: (s, np.minimum(s + 3, e)),
    lambda s, e: (s, np.minimum(s + 4, e)),
    lambda s, e: (s, np.minimum(s + 5, e)),
    lambda s, e: (np.maximum(e - 4, s), e),
)
#: Keeps the hashes of equal strings in different views apart.
VIEW_SALT = vec.mix64(np.arange(1, len(VIEWS) + 1, dtype=np.uint64))
PAD = np.zeros((2, len(VIEWS)), dtype=np.int64)


def word_ids(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word of the texts, each text between two padding words; bounds of
    the texts."""
    low = vec.LOWER[buf]
    # A blank before each text keeps the last word of one from running into the next.
    sep = np.zeros(len(low) + len(offsets) - 1, dtype=np.uint8)
    where = np.arange(len(low)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    sep[:] = 0x20
    sep[where] = low
    starts_of = offsets[:-1] + np.arange(len(offsets) - 1)
    h, s, _ = vec.word_hashes(sep, vec.NON_WORD, seed=4, views=VIEWS)
    h = vec.mix64(h + VIEW_SALT)
    first = np.searchsorted(s, np.append(starts_of, len(sep)))
    n_words = np.diff(first)
    ids = np.zeros((len(h) + 2 * len(n_words), len(VIEWS)), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(n_words + 2)])
    at = np.arange(len(h)) + 2 * np.repeat(np.arange(len(n_words)), n_words)
    ids[at] = 1 + (h >> np.uint64(64 - VOCAB_BITS)).astype(np.int64)
    return ids, bounds


@dataclass
class TextCNN:
    emb: np.ndarray
    filt: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    prior: float = 0.0  # share of label 1, the score of a text without words
    shift: dict[str, float] = field(default_factory=dict)
    languages: langid.LanguageModel | None = None

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, argmax: bool = False):
        """Max-pooled activations (texts x filters) and, for training, the winning positions."""
        x = self.emb[ids[:, 0]]
        for k in range(1, len(VIEWS)):
            x += self.emb[ids[:, k]]
        feats, wins = [], []
        for w in WIDTHS:
            n = len(ids) - w + 1
            z = x[:n] @ self.filt[w][:DIM]
            for j in range(1, w):
                z += x[j : n + j] @ self.filt[w][j * DIM : (j + 1) * DIM]
            z += self.bias[w]
            # positions whose window would run into the next text don't count
            for j in range(1, w):
                cut = bounds[1:] - j
                z[cut[cut < n]] = -1e9
            # two padding words alone make a text shorter than the widest window
            top = np.maximum.reduceat(z, np.minimum(bounds[:-1], n - 1), axis=0)
            feats.append(np.maximum(top, 0))
            if argmax:
                win = np.zeros(top.shape, dtype=np.int64)
                for d in range(len(bounds) - 1):
                    a, b = bounds[d], min(bounds[d + 1], n)
                    win[d] = a + z[a:b].argmax(axis=0) if a < b else 0
                wins.append(win)
        return np.concatenate(feats, axis=1), wins

    def raw(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds before calibration, for texts of any length and in bounded memory; NaN without words."""
        ids, bounds = word_ids(buf, offsets)
        out = np.zeros(len(offsets) - 1)
        for a, b in vec.chunks(np.diff(bounds), SPAN):
            lo, hi = bounds[a], bounds[b]
            if b - a == 1 and hi - lo > SPAN:
                best = None
                for at in range(lo, hi, SPAN):
                    part = ids[at : min(hi, at + SPAN + max(WIDTHS) - 1)]
                    part = np.concatenate([part, PAD]) if len(part) < 3 else part
                    f, _ = self.pooled(part, np.array([0, len(part)]))
                    best = f if best is None else np.maximum(best, f)
                feats = best
            else:
                part = np.concatenate([ids[lo:hi], PAD])
                feats, _ = self.pooled(part, bounds[a : b + 1] - lo)
            out[a:b] = feats @ self.out + self.out_bias
        out[np.diff(bounds) == 2] = np.nan
        return out

    def score(self, column) -> np.ndarray:
        buf, offsets = vec.text_buffer(column)
        z = self.raw(buf, offsets)
        if self.shift:
            langs = self.languages.predict(column.to_pylist())[0] if self.languages else ["und"] * len(z)
            z = z - np.array([self.shift.get(x, self.shift["und"]) for x in langs])
        return np.where(np.isnan(z), self.prior, 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def untrained(seed: int = 11) -> TextCNN:
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, ((1 << VOCAB_BITS) + 1, DIM)).astype(np.float32)
    emb[0] = 0
    filt = {w: rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    return TextCNN(emb, filt, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)


class Trainer:
    """Adam on the logistic loss, block by block; gradients flow through the pooled positions only.

    ``weight`` has the weights of labels 0 and 1.  ``touched`` counts the steps of each embedding row.
    """

    def __init__(self, model: TextCNN, *, weight: tuple[float, float] = (1.0, 1.0), batch: int = 32, rate: float = 0.01, seed: int = 11):
        self.model, self.weight, self.batch, self.rate = copy.deepcopy(model), np.array(weight), batch, rate
        self.rng = np.random.default_rng(seed)
        self.state: dict[str, list] = {}
        self.emb_m, self.emb_v = np.zeros_like(model.emb), np.zeros_like(model.emb)
        self.touched = np.zeros(len(model.emb), dtype=np.int64)
        self.rows = self.steps = 0

    def _adam(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def learn(self, texts: list[str], y: np.ndarray, epochs: int = 1) -> None:
        """``epochs`` passes over a block of texts."""
        ids, bounds = word_ids(*vec.text_buffer(pa.array(texts, pa.large_string())))
        self.rows += len(texts)
        for _ in range(epochs):
            order = self.rng.permutation(len(texts))
            for at in range(0, len(order), self.batch):
                self._step(ids, bounds, order[at : at + self.batch], y)

    def _step(self, ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
        model = self.model
        self.steps += 1
        sub = np.concatenate([ids[bounds[r] : bounds[r + 1]] for r in rows] + [PAD])
        bnd = np.concatenate([[0], np.cumsum(bounds[rows + 1] - bounds[rows])])
        feats, wins = model.pooled(sub, bnd, argmax=True)
        bias = np.array([model.out_bias])
        p = 1 / (1 + np.exp(-np.clip(feats @ model.out + bias[0], -30, 30)))
        d = (p - y[rows]) * self.weight[y[rows].astype(int)] / len(rows)
        g_feat = d[:, None] * model.out[None, :] * (feats > 0)
        g_out, g_bias = feats.T @ d + 1e-4 * model.out, np.array([d.sum()])
        touched, grads = [], []
        for k, w in enumerate(WIDTHS):
            g = g_feat[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
            g_filt = np.zeros_like(model.filt[w])
            for j in range(w):
                words = sub[np.minimum(wins[k] + j, len(sub) - 1)]
                x = model.emb[words].sum(axis=2)
                g_filt[j * DIM : (j + 1) * DIM] = np.einsum("dfe,df->ef", x, g)
                touched.append(words.ravel())
                g_word = g[:, :, None] * model.filt[w][j * DIM : (j + 1) * DIM].T[None]
                grads.append(np.repeat(g_word.reshape(-1, DIM), len(VIEWS), axis=0))
            self._adam(f"f{w}", model.filt[w], g_filt)
            self._adam(f"b{w}", model.bias[w], g.sum(axis=0))
        uniq, inv = np.unique(np.concatenate(touched), return_inverse=True)
        g_emb = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(g_emb, inv, np.concatenate(grads))
        g_emb[uniq == 0] = 0
        self.emb_m[uniq] += 0.1 * (g_emb - self.emb_m[uniq])
        self.emb_v[uniq] += 0.001 * (g_emb * g_emb - self.emb_v[uniq])
        model.emb[uniq] -= self.rate * (self.emb_m[uniq] / (1 - 0.9**self.steps)) / (np.sqrt(self.emb_v[uniq] / (1 - 0.999**self.steps)) + 1e-8)
        self.touched[uniq] += 1
        self._adam("out", model.out, g_out)
        self._adam("bias", bias, g_bias)
        model.out_bias = float(bias[0])


@dataclass
class Shares:
    """Sums over shards of what was learned: embedding rows by their steps, all else by rows."""

    rows: int
    touched: np.ndarray
    emb: np.ndarray
    rest: list[np.ndarray]

    @staticmethod
    def of(t: Trainer, words: np.ndarray) -> Shares:
        m = t.model
        rest = [*(m.filt[w] for w in WIDTHS), *(m.bias[w] for w in WIDTHS), m.out, np.array([m.out_bias]), words]
        return Shares(t.rows, t.touched, m.emb * t.touched[:, None], [x * float(t.rows) for x in rest])

    def add(self, o: Shares) -> None:
        self.rows += o.rows
        self.touched = self.touched + o.touched
        self.emb = self.emb + o.emb
        self.rest = [a + b for a, b in zip(self.rest, o.rest)]

    def mean(self, start: TextCNN) -> tuple[TextCNN, np.ndarray]:
        """The mean model, with the rows of ``start`` where none was learned, and the mean language weights."""
        emb = np.where(self.touched[:, None] > 0, self.emb / np.maximum(self.touched, 1)[:, None], start.emb).astype(np.float32)
        r = [x / self.rows for x in self.rest]
        k = len(WIDTHS)
        filt, bias = ({w: x.astype(np.float32) for w, x in zip(WIDTHS, part)} for part in (r[:k], r[k : 2 * k]))
        return TextCNN(emb, filt, bias, r[2 * k], float(r[2 * k + 1][0])), r[2 * k + 2]


def _blocks(batches):
    """(texts, labels, languages) of up to BLOCK_ROWS rows and BLOCK_CHARS characters, or one longer text."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (len(held) == BLOCK_ROWS or size + len(row[0]) > BLOCK_CHARS):
                yield [list(x) for x in zip(*held)]
                held, size = [], 0
            held.append(row)
            size += len(row[0])
    if held:
        yield [list(x) for x in zip(*held)]


def _sum_of_shards(rows: DataFrame, n_shards: int, start, names: list[str], idf, epochs: int, weight: tuple[float, float], rate: float) -> Shares:
    """Each of up to ``n_shards`` shards of ``rows`` (text, label, lang, key) is learned from ``start`` on, in the
    order of its keys."""
    shared = rows.sparkSession.sparkContext.broadcast((start, idf))  # a fixed size

    def learn(batches):
        model, own_idf = shared.value
        t, langs = Trainer(model, weight=weight, rate=rate), langid.Ftrl(len(names), own_idf)
        for texts, y, lang in _blocks(batches):
            t.learn(texts, np.array(y, dtype=np.float64), epochs)
            for (nz, c), name in zip(langid.counts_per_text(texts) if names else (), lang):
                if name is not None:
                    langs.step(nz, c / max(1, c.sum()), names.index(name))
        if t.rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Shares.of(t, langs.weights()))], pa.binary())], names=["learned"])

    def add(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                own = pickle.loads(x.as_py())
                total = total.add(own) or total if total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["learned"])

    # the rows lie by hashes of ids in their files already: only a single shard, of bounded size, is gathered
    dealt = rows.repartition(1) if n_shards == 1 else rows.coalesce(n_shards)
    learned = dealt.sortWithinPartitions("key").select("text", "label", "lang").mapInArrow(learn, "learned binary")
    got = learned.repartition(1).mapInArrow(add, "learned binary").collect()  # one row of a fixed size
    shared.unpersist()
    return pickle.loads(got[0][0])


def train(rows: DataFrame, sizes: dict[int, int], names: list[str], idf, start: TextCNN | None = None) -> tuple[TextCNN, np.ndarray]:
    """Model and language weights from all ``rows`` (text, label, lang, key).

    One shard of about SHARD_ROWS rows is learned first; the others go on from its model side by side, each
    row once, and their mean is the result.  Few rows are learned several times.
    """
    n = sizes[0] + sizes[1]
    weight = (n / (2 * max(1, sizes[0])), n / (2 * max(1, sizes[1])))
    groups = max(1, -(-n // SHARD_ROWS))
    epochs = int(np.clip(LEAST_VISITS // n, 1, 20))
    start = start or untrained()
    own = F.pmod(F.col("key"), F.lit(groups)) == 0
    first = _sum_of_shards(rows.where(own) if groups > 1 else rows, 1, start, names, idf, epochs, weight, 0.01)
    model, words = first.mean(start)
    if groups == 1:
        return model, words
    more = _sum_of_shards(rows.where(~own), min(groups - 1, MAX_SHARDS), model, names, idf, 1, weight, 0.003)
    both, other_words = more.mean(model)
    return both, (words * first.rows + other_words * more.rows) / (first.rows + more.rows)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Log-odds that give the best weighted F1; the middle of the gap to the next lower value."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    tp, fp = np.cumsum(weight * y), np.cumsum(weight * (1 - y))
    total = tp[-1] if len(tp) else 0.0
    if total == 0 or fp[-1] == 0:
        return 0.0
    f1 = 2 * tp / (tp + fp + total)
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def threshold_counts(rows: DataFrame, models: list[TextCNN], languages: langid.LanguageModel) -> list[tuple[str, int, int, int]]:
    """(predicted language, bin of the log-odds, label, rows) over all ``rows``; a row is scored by the model of
    the other half.  At most 2 * 40 * BINS + 1 bins for each language and label."""
    shared = rows.sparkSession.sparkContext.broadcast((models, languages))  # a fixed size

    def run(batches):
        by, lang_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                half = np.array(part.column(2).to_pylist())
                z = np.zeros(len(half))
                for k in (0, 1):
                    mine = np.flatnonzero(half == 1 - k)
                    if len(mine):
                        z[mine] = by[k].raw(*vec.text_buffer(part.column(0).take(pa.array(mine))))
                z = np.clip(np.nan_to_num(z, nan=-40.0), -40, 40)
                pred = lang_of.predict(part.column(0).to_pylist())[0]
                yield pa.RecordBatch.from_arrays([pa.array(pred, pa.string()), pa.array(np.floor(z * BINS).astype(np.int32)), part.column(1)], names=["lang", "bin", "label"])

    found = rows.select("text", "label", "half").mapInArrow(run, "lang string, bin int, label int")
    return [tuple(r) for r in found.groupBy("lang", "bin", "label").count().collect()]


def fit(labelled: DataFrame, *, text: str = "text", label: str = "toxic", lang: str = "lang", min_positive: int = 20) -> TextCNN:
    """Train and calibrate on all rows of ``labelled`` (text, label, lang, others) with a text and a label.

    The thresholds come from all rows too: two more models learn a half of the texts each and score the other.
    """
    known = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    half = F.pmod(F.xxhash64(F.col(text)), F.lit(2)).cast("int")  # copies of a text are in one half
    key = F.xxhash64(*[F.col(c) for c in known.columns])
    rows = materialise(known.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.col(lang).alias("lang"), half.alias("half"), key.alias("key")), "labelled")
    try:
        counts = {(r.label, r.half): r["count"] for r in rows.groupBy("label", "half").count().collect()}
        sizes = {k: counts.get((k, 0), 0) + counts.get((k, 1), 0) for k in (0, 1)}
        if not sizes[0] or not sizes[1]:
            model = untrained()
            model.out = np.zeros_like(model.out)
            model.out_bias = 4.0 if sizes[1] else -4.0
            model.prior = 1.0 if sizes[1] else 0.0
            return model
        names = sorted(r[0] for r in rows.where("lang is not null").select("lang").distinct().collect())
        idf = langid.idf_of(*langid.document_frequency(rows.where("lang is not null")))
        model, words = train(rows, sizes, names, idf)
        model.prior = sizes[1] / (sizes[0] + sizes[1])
        model.languages = langid.LanguageModel(names, idf, words, 1.0)
        halves = [{k: counts.get((k, h), 0) for k in (0, 1)} for h in (0, 1)]
        # a half without one of the labels, in very small tables, is scored by the whole model
        models = [train(rows.where(F.col("half") == h), halves[h], [], idf)[0] if all(halves[h].values()) else model for h in (0, 1)]
        found = threshold_counts(rows, models, model.languages)
    finally:
        discard(rows)
    z, y, weight = ((np.array([r[1] for r in found]) + 0.5) / BINS, np.array([r[2] for r in found], dtype=np.float64), np.array([r[3] for r in found], dtype=np.float64))
    langs = np.array([r[0] for r in found])
    model.shift = {"und": best_threshold(z, y, weight)}
    for name in sorted(set(langs)):
        own = langs == name
        if (weight * y)[own].sum() >= min_positive and (weight * (1 - y))[own].sum() >= min_positive:
            model.shift[name] = best_threshold(z[own], y[own], weight[own])
    return model


def score(docs: DataFrame, model: TextCNN, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus ``score`` of the whole text.  A text without words, null or empty, has
    the share of label 1 among the labelled rows; repeated rows give repeated results; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the tables above
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    n = len(keep)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                s = shared.value.score(part.column(n))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + [pa.array(s, pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, score double")


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract of op4.  Documents without a label are scored like the others; a null doc_id
    counts as held out."""
    learned = ~langid.held_out("doc_id", 5, 0)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learned)
    usable = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a join by shuffle at any size: it leaves the rows by hashes of ids
    rows = docs.where(learned & F.col("text").isNotNull()).select("doc_id", "text", "lang").join(usable.hint("merge"), "doc_id")
    model = fit(rows.select("text", "toxic", "lang", "doc_id"))
    out = F.coalesce(langid.held_out("doc_id", 5, 0), F.lit(True))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
