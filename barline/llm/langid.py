"""Language identification: sparse multinomial logistic regression on hashed TF-IDF
character n-grams (orders 1 to 3), trained by follow-the-regularised-leader with an
elastic net, calibrated by a temperature.

Document frequencies come from every training document; the weights are fitted on at
most ``sample_per_lang`` training documents of a language (expected; chosen by a hash of
the row).  Prediction reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
SIZE = 1 << BITS
SCALE = 40.0
LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 19

_FOLD = np.arange(128, dtype=np.uint32)
for _c in range(128):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def ngram_ids(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (an array of three rows, one for each order) and the bounds of the parts.
    The n-grams that start at the last two characters of a part belong to no part."""
    arr = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    low = arr < 128
    arr[low] = _FOLD[arr[low]]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    n = len(arr) - 2
    a, b, c = arr[:n], arr[1 : n + 1], arr[2 : n + 2]
    with np.errstate(over="ignore"):
        h1 = a * np.uint32(2654435761)
        h2 = (h1 ^ (b * np.uint32(2246822519))) * np.uint32(3266489917)
        h3 = (h2 ^ (c * np.uint32(668265263))) * np.uint32(374761393)
        h1 = (h1 + np.uint32(0x5BD1E995)) * np.uint32(2246822519)
    ids = np.stack([(h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS) for h in (h1, h2, h3)])
    return ids, bounds


def pieces(texts: list[str]):
    """Groups of texts of bounded size: (indices, strings).  Every text has blanks around it, so that
    no n-gram spans two texts; a long text is cut into pieces that overlap by two characters, so that
    each of its n-grams starts in exactly one."""
    idx: list[int] = []
    out: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = f" {t.lower()}  "
        for at in range(0, len(t) - 2, _PIECE):
            part = t[at : at + _PIECE + 2]
            if size + len(part) > _PIECE + 2 and out:
                yield idx, out
                idx, out, size = [], [], 0
            idx.append(i)
            out.append(part)
            size += len(part)
    if out:
        yield idx, out


def counts_per_text(texts: list[str]):
    """(indices, counts) of the buckets of each text, for training."""
    for t in texts:
        acc = np.zeros(SIZE, dtype=np.int64)
        for _, part in pieces([t]):
            for p in part:
                acc += np.bincount(ngram_ids([p])[0].ravel(), minlength=SIZE)
        nz = np.flatnonzero(acc)
        yield nz, acc[nz]


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        table = (self.weights * self.idf[:, None] * SCALE).astype(np.float32)
        sums = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for idx, part in pieces(texts):
            ids, bounds = ngram_ids(part)
            for k in range(len(self.langs)):
                col = table[:, k]
                val = col[ids[0]] + col[ids[1]] + col[ids[2]]
                cum = np.concatenate([[0.0], np.cumsum(val, dtype=np.float64)])
                # the last two positions of a text hold its blanks only
                np.add.at(sums[:, k], idx, cum[np.maximum(bounds[1:] - 2, bounds[:-1])] - cum[bounds[:-1]])
            np.add.at(total, idx, 3.0 * np.maximum(np.diff(bounds) - 2, 0))
        return sums / np.maximum(total, 1.0)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability; ``und`` and 0 without any letter."""
        has = [t is not None and LETTER.search(t) is not None for t in texts]
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, h in enumerate(has) if h]
        if rows and self.langs:
            z = self.logits([texts[i] for i in rows]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, k, s in zip(rows, p.argmax(axis=1), p.max(axis=1)):
                pred[i], score[i] = self.langs[k], s
        return pred, np.clip(score, 0.0, 1.0)


def idf_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((1.0 + n_docs) / (1.0 + df)) + 1.0


class Ftrl:
    """Follow-the-regularised-leader on one row after another; tables of fixed size."""

    def __init__(self, k: int, idf: np.ndarray, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n, self.idf = np.zeros((SIZE, k)), np.zeros((SIZE, k)), idf
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        zi, ni = self.z[rows], self.n[rows]
        return np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2))

    def step(self, nz: np.ndarray, tf: np.ndarray, y: int) -> None:
        """One row: its buckets, their shares of its n-grams, the number of its language."""
        x = tf * self.idf[nz] * SCALE
        wi = self.weights(nz)
        s = x @ wi
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1.0
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[nz] + g * g) - np.sqrt(self.n[nz])) / self.alpha
        self.z[nz] += g - sigma * wi
        self.n[nz] += g * g


def train(texts: list[str], langs: list[str], idf: np.ndarray | None = None, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, seed: int = 7) -> LanguageModel:
    """Fit on rows in memory; one row in five sets the temperature."""
    names = sorted(set(langs))
    feats = [(nz, c / max(1, c.sum())) for nz, c in counts_per_text(texts)]
    if idf is None:
        df = np.zeros(SIZE)
        for nz, _ in feats:
            df[nz] += 1
        idf = idf_of(df, len(texts))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    k = len(names)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), dtype=bool)
    held[rng.permutation(len(y))[: len(y) // 5]] = True
    learner = Ftrl(k, idf, alpha=alpha, beta=beta, l1=l1, l2=l2)
    fit = np.flatnonzero(~held)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            learner.step(*feats[i], y[i])
    w = learner.weights()
    model = LanguageModel(names, idf, w, 1.0)
    cal = np.flatnonzero(held) if held.any() else np.arange(len(y))
    s = np.stack([(feats[i][1] * idf[feats[i][0]] * SCALE) @ w[feats[i][0]] for i in cal]) if len(cal) else np.zeros((0, k))

    def loss(t: float) -> float:
        q = s / t
        q = q - q.max(axis=1, keepdims=True)
        return float(-(q[np.arange(len(cal)), y[cal]] - np.log(np.exp(q).sum(axis=1))).mean())

    if len(cal):
        model.temperature = float(min(np.geomspace(0.1, 5.0, 60), key=loss))
    return model


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Number of documents that hold each bucket, over all rows of ``docs``.  Each task counts
    into a table of fixed size; Spark adds the tables up."""

    def count(batches):
        df = np.zeros(SIZE, dtype=np.int64)
        rows = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                seen = np.zeros(SIZE, dtype=bool)
                for _, part in pieces([t]):
                    for p in part:
                        seen[ngram_ids([p])[0].ravel()] = True
                df += seen
                rows += 1
        nz = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(nz, -1), pa.int32()), pa.array(np.append(df[nz], rows), pa.int64())], names=["bucket", "n"])

    parts = docs.select(text).mapInArrow(count, "bucket int, n long")
    df = np.zeros(SIZE)
    n_docs = 0
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # at most SIZE + 1 rows
        if r["bucket"] < 0:
            n_docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n_docs


def fit(docs: DataFrame, training: Column, *, text: str = "text", lang: str = "lang", sample_per_lang: int = 1000) -> LanguageModel:
    """Train on the rows of ``docs`` where ``training`` holds and text and language are not null."""
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return LanguageModel([], np.ones(SIZE), np.zeros((SIZE, 0)), 1.0)
    df, n_docs = document_frequency(rows, text)
    unit = 1 << 30
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(unit, int(unit * sample_per_lang / n)))).otherwise(share)
    # rows that repeat a text go in or out together: they are taken once
    sample = rows.where(F.pmod(F.xxhash64(text, lang), F.lit(unit)) < share).select(text, lang).distinct()
    got = sorted(sample.collect(), key=lambda r: (r[1], r[0]))
    return train([r[0] for r in got], [r[1] for r in got], idf_of(df, n_docs))


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` of every row.

    Null texts and texts without a letter: ``und``, score 0.  Texts are read whole, very long ones in
    pieces; ties go to the first language by name.  Repeated rows give repeated results, an empty
    table an empty result; columns not in ``keep`` are ignored.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # SIZE x number of languages
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    n = len(keep)

    def run(batches):
        for batch in batches:
            pred, score = shared.value.predict(batch.column(n).to_pylist())
            arrays = [batch.column(i) for i in range(n)] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(column: str, mod: int, rest: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod) == F.lit(rest)


def op8_langid(docs: DataFrame) -> DataFrame:
    """Contract of op8: trained where crc32(doc_id) mod 4 is not 2 (a null doc_id counts as held out)."""
    out = F.coalesce(held_out("doc_id", 4, 2), F.lit(True))
    model = fit(docs, ~out)
    scored = identify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(True)).alias("held_out"), "lang_pred", "score")
