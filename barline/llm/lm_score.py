"""Language-model scoring by cross-entropy difference.

Two word-bigram models of the same form share one vocabulary: the target model counts the
chosen documents, the background model counts all others.  The models are matched in size: the
counts of the larger are scaled to the tokens of the smaller, which is what a sample of equal size
would hold on average, so that smoothing weighs alike in both and no document is left out.  A bigram
falls back on its word by ``c(h) / (c(h) + backoff)``; words are smoothed over the vocabulary.  A
document that was counted is scored by the models of all others: its own counts are taken out
first.  Its score is the mean over its tokens of the difference between the two losses: below zero
it is nearer the target.

Counts cover every token of every document and are exact: a word, a history and a bigram are
each a key of their own (62 bits of hash and the kind).  Documents are packed into chunks.  A chunk
sends its distinct keys with their counts to ranges of the keys, which number more on larger input;
a range adds them up and answers each chunk with the sums of its keys, in the chunk's order.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import vec
from barline.llm.common import materialise, partitions

U64 = np.uint64
START = U64(0x51ED270B35A1C2D7)
BLOCKS = "part int, chunk long, at long, block binary"
SUMS = f"{BLOCKS}, words long, total long, target long"
#: Bytes of text for each range of keys, and for each chunk of documents that asks together.
RANGE, CHUNK = 1 << 24, 6 << 20


@dataclass(frozen=True)
class Shape:
    """The vocabulary that smoothing spreads over has 2**word_bits places, or as many as there are
    distinct words if these are more."""

    word_bits: int = 18
    backoff: float = 8.0
    smoothing: float = 0.5


@dataclass(frozen=True)
class Models:
    """Both models: ``table`` has the keys of each range with their counts in all and in the target
    documents; ``totals`` are the tokens of both."""

    table: DataFrame | None
    ranges: int
    totals: tuple[int, int]
    vocabulary: int
    shape: Shape


def tokens(buf: np.ndarray, offsets: np.ndarray):
    """Keys of word, history and pair of every token (three rows); bounds of the texts."""
    wide, at = vec.spaced(vec.LOWER[buf], offsets)
    h, starts, _ = vec.word_hashes(wide, vec.SPACE, seed=9)
    first = np.searchsorted(starts, at)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    opening = first[:-1][np.diff(first) > 0]
    before[opening] = START
    keys = np.stack([h, before, vec.mix64(vec.mix64(before) + h)])
    return keys & ~U64(3) | np.arange(3, dtype=U64)[:, None], first


def _slices(column):
    buf, offsets = vec.text_buffer(column)
    for a, b in vec.chunks(np.diff(offsets), 1 << 20):
        yield a, b, buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, how often each occurs, and the place of each token's keys among them
    (three rows)."""
    flat = keys.ravel()
    order = np.argsort(flat)
    flat = flat[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    edge = np.flatnonzero(new)
    names = flat[edge]
    del flat
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return names, np.diff(edge, append=len(order)), place.reshape(keys.shape)


def distinct(keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sorted distinct keys with their number in all and in chosen tokens (three rows)."""
    names, n, place = ranked(keys)
    target = sum(np.bincount(p[chosen], minlength=len(names)) for p in place)
    return np.stack([names.view(np.int64), n, target])


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of a key and its counts, added up by key and sorted."""
    rows = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), dtype=np.int64)
    order = np.argsort(rows[0].view(U64))
    rows = rows[:, order]
    edge = vec.bounds_of(rows[0])[:-1]
    return np.stack([rows[0][edge], *(np.add.reduceat(c, edge) for c in rows[1:])]) if len(edge) else rows


def _blocks(rows: np.ndarray, ranges: int, chunk: int):
    """Blocks of at most 4096 sorted keys of one range, with the place of their first key."""
    key = rows[0].view(U64)
    if not len(key):
        return
    part = ((key >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    edge = vec.bounds_of(part)
    cuts = np.concatenate([np.arange(a, b, 4096) for a, b in zip(edge[:-1], edge[1:])] + [[len(key)]]).astype(np.int64)
    for at in range(0, len(cuts) - 1, 256):
        own = cuts[at : at + 257]
        out = [vec.pack(np.diff(key[a:b], prepend=U64(0)), *(c[a:b] for c in rows[1:])) for a, b in zip(own[:-1], own[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(part[own[:-1]], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array(own[:-1]), pa.array(out, pa.binary())], names=["part", "chunk", "at", "block"])


def _opened(block: bytes) -> np.ndarray:
    rows = vec.unpack(block).copy()
    rows[0] = np.cumsum(rows[0], dtype=U64)
    return rows.view(np.int64)


def chunks(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` (keep, __text, __target) packed into (chunk, block), written out.  A chunk is one
    row, so that whoever reads it finds the same texts."""
    n = len(keep)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            sizes = np.diff(vec.text_buffer(batch.column(n))[1]) + 64
            for a, b in vec.chunks(sizes, CHUNK):
                own = int(sizes[a:b].sum())
                if held and size + own > CHUNK:
                    yield pack(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += own
        if held:
            yield pack(held)

    def pack(held):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for rows in held:
                w.write_batch(rows)
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "block"])

    return materialise(docs.select(*keep, "__text", "__target").mapInArrow(run, "chunk long, block binary"), "lm-chunks")


def _unpacked(block: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a chunk, the number of tokens of each, the tokens' keys and whether their text is chosen."""
    with pa.ipc.open_stream(block) as r:
        rows = r.read_all().combine_chunks().to_batches()[0]
    n = rows.num_columns - 2
    found, size = [np.zeros((3, 0), dtype=U64)], np.zeros(rows.num_rows, dtype=np.int64)
    for a, b, buf, offsets in _slices(rows.column(n)):
        keys, first = tokens(buf, offsets)
        found.append(keys)
        size[a:b] = np.diff(first)
    chosen = rows.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
    return rows, size, np.concatenate(found, axis=1), np.repeat(chosen, size)


def ask(packed: DataFrame, ranges: int, *, counted: bool = True) -> DataFrame:
    """Blocks of the distinct keys of each chunk, with the chunk's own counts if it is ``counted``."""

    def run(batches):
        for batch in batches:
            for chunk, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, keys, chosen = _unpacked(block.as_buffer())
                rows = distinct(keys, chosen)
                if not counted:
                    rows[1:] = 0
                yield from _blocks(rows, ranges, chunk)

    return packed.mapInArrow(run, BLOCKS)


def sums(blocks: DataFrame, ranges: int, *, answer: bool) -> DataFrame:
    """Blocks of a range added up, written out: as a table with its keys (chunk -1), or as the
    sums for each block of a chunk.  The first block of a partition also gives its distinct words
    and the tokens of both models."""

    def run(batches):
        held: list[tuple] = []
        parts, size = [], 0
        for batch in batches:
            for head in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if answer and head[1] >= 0:
                    held.append(head)
                parts.append(_opened(head[3]))
                size += parts[-1].shape[1]
                if size > max(1 << 21, 2 * parts[0].shape[1]):
                    parts = [_merge(parts)]
                    size = parts[0].shape[1]
        table = _merge(parts)
        word = (table[0] & 3) == 0
        totals = [int(word.sum()), *(int(c[word].sum()) for c in table[1:])]
        for batch in told(table, held) if answer else _blocks(table, ranges, -1):
            rest = [pa.array([t] + [0] * (batch.num_rows - 1), pa.int64()) for t in totals]
            totals = [0, 0, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, *rest], names=[*batch.schema.names, "words", "total", "target"])

    def told(table, held):
        for k in range(0, len(held), 256):
            own = held[k : k + 256]
            out = [vec.pack(*table[1:, np.searchsorted(table[0].view(U64), _opened(h[3])[0].view(U64))]) for h in own]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in own], pa.int32()), pa.array([h[1] for h in own], pa.int64()), pa.array([h[2] for h in own], pa.int64()), pa.array(out, pa.binary())], names=["part", "chunk", "at", "block"])

    return materialise(blocks.repartitionById(ranges, F.col("part")).mapInArrow(run, SUMS), "lm-sums")


def _totals(table: DataFrame, shape: Shape) -> tuple[tuple[int, int], int]:
    words, total, target = (x or 0 for x in table.agg(F.sum("words"), F.sum("total"), F.sum("target")).first())
    return (total, target), max(1 << shape.word_bits, words)


def _within(place: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often the document of each token holds the token's key."""
    code = of * (int(place.max(initial=0)) + 1) + place
    order = np.argsort(code)
    edge = vec.bounds_of(code[order])
    out = np.empty(len(code), dtype=np.int32)
    out[order] = np.repeat(np.diff(edge), np.diff(edge))
    return out


def losses(packed: DataFrame, told: DataFrame, models: Models, keep: list[str], fields: str, *, counted: bool = True) -> DataFrame:
    """Scores of the documents of each chunk by the sums of its keys; ``counted`` documents are
    scored without their own counts."""
    n, shape, vocabulary = len(keep), models.shape, models.vocabulary
    totals = models.totals[1], models.totals[0] - models.totals[1]  # target, background
    scale = [min(totals) / t if t else 0.0 for t in totals]

    def run(batches):
        held, last = [], None
        for batch in batches:
            for chunk, at, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if chunk != last:
                    held, last = [], chunk
                if at is not None:
                    held.append((at, block.as_py()))
                    continue
                rows, size, keys, chosen = _unpacked(block.as_buffer())
                names, _, place = ranked(keys)
                counts = np.zeros((2, len(names)), dtype=np.int64)
                del keys, names
                for a, b in held:
                    c = vec.unpack(b).view(np.int64)
                    counts[:, a : a + c.shape[1]] = c
                held = []
                counts[0] -= counts[1]
                of, mean = np.repeat(np.arange(len(size)), size), np.zeros((2, len(size)))
                own = [_within(p, of) if counted else 0 for p in place]
                for k in (0, 1):
                    mine = (chosen if k == 0 else ~chosen) if counted else 0
                    word, history, pair = ((counts[1 - k][p] - mine * o) * scale[k] for p, o in zip(place, own))
                    p = (word + shape.smoothing) / ((totals[k] - mine * size[of]) * scale[k] + shape.smoothing * vocabulary)
                    loss = -np.log((pair + shape.backoff * p) / (history + shape.backoff))
                    mean[k] = np.bincount(of, weights=loss, minlength=len(size)) / np.maximum(size, 1)
                none = size == 0
                arrays = [pa.array(size), pa.array(mean[0], mask=none), pa.array(mean[1], mask=none), pa.array(mean[0] - mean[1], mask=none)]
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(n)] + arrays, names=[*keep, "n_tokens", "ce_target", "ce_background", "score"])

    both = told.select("chunk", "at", "block").unionByName(packed.select("chunk", F.lit(None).cast("long").alias("at"), "block"))
    both = both.repartition(models.ranges, "chunk").sortWithinPartitions("chunk", F.col("at").isNull())
    return both.mapInArrow(run, f"{fields}, n_tokens long, ce_target double, ce_background double, score double")


def _fields(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)


def score(docs: DataFrame, models: Models, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, ce_target, ce_background and their difference ``score``.

    ``docs`` are taken for documents that the models did not count.  Texts that are null or have no
    words have 0 tokens and null scores; long texts are read whole; repeated rows give repeated
    results; an empty table gives an empty result; without any target or any other document both
    models are uniform and scores 0; columns not in ``keep`` are ignored.
    """
    packed = chunks(docs.select(*keep, F.col(text).alias("__text"), F.lit(False).alias("__target")), keep)
    told = models.table.select("part", "chunk", "at", "block").unionByName(ask(packed, models.ranges, counted=False))
    return losses(packed, sums(told, models.ranges, answer=True), models, keep, _fields(docs, keep), counted=False)


def _marked(docs: DataFrame, target_ids: DataFrame, key: str, text: str, broadcast_rows: int) -> tuple[DataFrame, int]:
    """``docs`` (key, __text, __target) and the number of ranges for them."""
    ids = target_ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__hit", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    rows = docs.select(key, F.col(text).alias("__text")).join(ids, key, "left").withColumn("__target", F.coalesce("__hit", F.lit(False)))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows, max(partitions(docs.sparkSession), size // RANGE)


def fit(docs: DataFrame, target_ids: DataFrame, *, key: str = "doc_id", text: str = "text", shape: Shape = Shape(), broadcast_rows: int = 200_000) -> Models:
    """Count both models; ``target_ids`` (key) names the target documents.  At most
    ``broadcast_rows`` ids travel to the documents, more are joined by shuffling."""
    rows, ranges = _marked(docs, target_ids, key, text, broadcast_rows)
    table = sums(ask(chunks(rows, [key]), ranges), ranges, answer=False)
    return Models(table, ranges, *_totals(table, shape), shape)


def fit_score(docs: DataFrame, target_ids: DataFrame, *, key: str = "doc_id", text: str = "text", shape: Shape = Shape(), broadcast_rows: int = 200_000) -> DataFrame:
    """As ``score`` by the models of ``fit`` on the same documents, each without its own counts; keys
    travel once.  Repeated rows count for each other."""
    rows, ranges = _marked(docs, target_ids, key, text, broadcast_rows)
    packed = chunks(rows, [key])
    told = sums(ask(packed, ranges), ranges, answer=True)
    return losses(packed, told, Models(None, ranges, *_totals(told, shape), shape), [key], _fields(docs, [key]))


def op10_lm_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents labelled as of good quality; background: all others."""
    return fit_score(docs, labels.where("quality = 1").select("doc_id"))
