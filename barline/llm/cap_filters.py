"""Near-duplicate embeddings by spherical-cap filters.

A random rotation splits a unit vector into two parts; each part has a random code of ``words``
words, and every pair of code words is a filter direction (a product code).  A vector is
list-decoded to its nearest ``NEAREST`` filters of each code: these lie among the sums of its best
words, so that a code of millions of filters costs two short lists.  Codes grow with the vectors of
a label (``code_size``), so that a vector meets about a thousand unrelated ones at any size, and
more codes make up for the finer filters.  Up to ``SMALL`` dimensions, where directions repeat,
the code stays small and a vector takes all filters of a cap.

Vectors of one label meet in a filter's bucket.  First only their ids do, with a sketch of ``SIGNS``
signs against random hyperplanes: a slot without any sketch near enough to its own ends there
(a linked pair is lost with probability ``LOSS``).  Vectors travel to the slots that are left, where
every pair is checked by its cosine in double precision.  Whether a pair shares a filter depends
on its cosine and the random rotation only; the README has the share of pairs at 0.93 that do not.

Equal vectors of a label are one class with a weight.  A pair that shares several filters
counts in the least of them.  Buckets beyond ``cut`` classes are cut into blocks, and blocks
meet pair by pair in separate groups; groups are read one at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import materialise, partitions
from barline.llm.components import connected_components

#: Filters that a vector takes of each code; up to SMALL dimensions also those whose cosine with it
#: is at least CAP, of a code of LEAST words.
NEAREST, SMALL, CAP = 16, 21, 0.45
#: Words of each part of a code.
LEAST, MOST = 32, 4096
SIGNS, LOSS = 128, 1e-10


def code_size(n: int) -> tuple[int, int]:
    """(words, codes) for ``n`` vectors of a label: at least n / 2 filters in a code, as far as MOST
    words go."""
    words = LEAST
    while words < MOST and 2 * words * words < n:
        words *= 2
    return words, 2 if words <= 64 else 3 if words <= 256 else 4 if words <= 1024 else 5


@lru_cache(maxsize=8)
def directions(dim: int, seed: int, words: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the code words of both parts."""
    rng = np.random.default_rng([dim, seed])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    half = max(1, dim // 2)
    parts = []
    for size in (half, max(1, dim - half)):
        c = rng.normal(size=(words, size))
        parts.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, parts[0], parts[1]


@lru_cache(maxsize=8)
def _ranks(nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of left and right words whose sum can be among the ``nearest`` greatest sums."""
    pairs = [(i, j) for i in range(nearest) for j in range(nearest) if (i + 1) * (j + 1) <= nearest]
    left, right = zip(*pairs)
    return np.array(left), np.array(right)


def _best(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest values of each row, greatest first."""
    top = np.argpartition(-x, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(x, top, axis=1), axis=1, kind="stable"), axis=1)


def decode(unit: np.ndarray, words: int = LEAST, codes: int = 2) -> list[np.ndarray]:
    """Ids of the filters of each row (a unit vector), ascending."""
    n, dim = unit.shape
    if dim == 1:
        return [np.zeros(1, np.int32)] * n
    half, out = dim // 2, []
    if dim <= SMALL:
        words, codes = LEAST, 2
    for code in range(codes):
        rotation, left, right = directions(dim, code, words)
        x = unit @ rotation
        a, b = x[:, :half] @ left.T, x[:, half:] @ right.T
        if dim <= SMALL:
            near = (a[:, :, None] + b[:, None, :]).reshape(n, -1)
            taken = near >= np.sqrt(2.0) * CAP
            np.put_along_axis(taken, np.argpartition(-near, NEAREST, axis=1)[:, :NEAREST], True, axis=1)
            out.append([np.flatnonzero(t) + code * words * words for t in taken])
            continue
        ia, ib = _best(a, NEAREST), _best(b, NEAREST)
        i, j = _ranks(NEAREST)
        sums = np.take_along_axis(a, ia, axis=1)[:, i] + np.take_along_axis(b, ib, axis=1)[:, j]
        top = _best(sums, NEAREST)
        filters = np.take_along_axis(ia, i[top], axis=1) * words + np.take_along_axis(ib, j[top], axis=1)
        out.append(np.sort(filters, axis=1) + code * words * words)
    return [np.concatenate(f).astype(np.int32) for f in zip(*out)]


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 99]).normal(size=(dim, SIGNS))


def sketch(unit: np.ndarray) -> np.ndarray:
    """Signs of each row against fixed random hyperplanes, as two 64-bit numbers."""
    bits = np.packbits(unit @ _planes(unit.shape[1]) >= 0, axis=1)
    return bits.view(np.uint64)


def most_signs(threshold: float) -> int:
    """Differing signs that a pair at the threshold exceeds with probability LOSS at most."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    tail, k = 0.0, SIGNS
    while k > 0 and tail + math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k) <= LOSS:
        tail += math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        k -= 1
    return k


def _rows(column) -> tuple[list, list[bool]]:
    """The vectors, and for each whether it is there without null components."""
    rows = column.to_pylist()
    ok = [v is not None and len(v) > 0 and all(c is not None for c in v) for v in rows]
    return rows, ok


def with_filters(classes: DataFrame, words: int = LEAST, codes: int = 2) -> DataFrame:
    """``classes`` (cid, weight, label, embedding) that can link, with dim, their filters and sketch."""
    kinds = dict(classes.dtypes)

    def run(batches):
        for batch in batches:
            rows, ok = _rows(batch.column(3))
            by_dim: dict[int, list[int]] = {}
            for i, good in enumerate(ok):
                if good:
                    by_dim.setdefault(len(rows[i]), []).append(i)
            for dim, idx in by_dim.items():
                x = np.array([rows[i] for i in idx], dtype=np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    top = np.abs(x).max(axis=1)
                fine = np.isfinite(top) & (top > 0)
                idx, x = np.array(idx)[fine], x[fine]
                step = max(16, (1 << 20) // max(words, LEAST * LEAST if dim <= SMALL else 1))
                for at in range(0, len(idx), step):
                    part, y = idx[at : at + step], x[at : at + step]
                    y = y / np.abs(y).max(axis=1, keepdims=True)
                    y = y / np.linalg.norm(y, axis=1, keepdims=True)
                    found, signs = decode(y, words, codes), sketch(y).view(np.int64)
                    keep = batch.take(pa.array(part))
                    more = [pa.array([dim] * len(part), pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(signs[:, 0]), pa.array(signs[:, 1])]
                    yield pa.RecordBatch.from_arrays([*keep.columns, *more], names=[*batch.schema.names, "dim", "filters", "s0", "s1"])

    fields = ", ".join(f"{c} {kinds[c]}" for c in ("cid", "weight", "label", "embedding"))
    return classes.select("cid", "weight", "label", "embedding").mapInArrow(run, f"{fields}, dim int, filters array<int>, s0 long, s1 long")


def _grouped(batches, most: int | None = None):
    """(rows, whole) of each group of equal first column in sorted batches, one at a time.  A group
    beyond ``most`` rows comes in parts that are not ``whole``."""
    held: list[pa.RecordBatch] = []
    group, size, big = None, 0, False
    for batch in batches:
        g = batch.column(0).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(g)) + 1
        for lo, hi in zip(np.append(0, edge), np.append(edge, len(g))):
            if hi == lo:
                continue
            if held and g[lo] != group:
                yield pa.Table.from_batches(held), not big
                held, size = [], 0
            if g[lo] != group:
                big = False
            group = g[lo]
            held.append(batch.slice(lo, hi - lo))
            size += hi - lo
            if most is not None and size > most:
                big = True
                yield pa.Table.from_batches(held), False
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held), not big


def _alive(signs: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """Rows of a group with some other row near enough; two rows of one block (side) don't count."""
    out = np.zeros(len(side), dtype=bool)
    for at in range(0, len(side), 512):
        far = np.zeros((len(side[at : at + 512]), len(side)), dtype=np.uint16)
        for k in range(signs.shape[1]):
            far += np.bitwise_count(signs[at : at + 512, k, None] ^ signs[None, :, k])
        near = far <= most
        near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        near &= (side[at : at + 512, None] < 0) | (side[at : at + 512, None] != side[None, :])
        out[at : at + 512] = near.any(axis=1)
    return out


def alive_slots(slots: DataFrame, most: int, cut: int | None, n: int) -> DataFrame:
    """(g, f, side, cid, s0, s1, big) of the slots with company in their group; those of groups beyond
    ``cut`` all come back as ``big``."""

    def run(batches):
        for rows, whole in _grouped(batches, cut):
            rows = rows.combine_chunks()
            if whole:
                if rows.num_rows < 2:
                    continue
                signs = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
                rows = rows.filter(pa.array(_alive(signs, rows.column("side").to_numpy(), most)))
            for batch in rows.to_batches():
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([not whole] * batch.num_rows, pa.bool_())], names=[*batch.schema.names, "big"])

    sent = slots.select("g", "f", "side", "cid", "s0", "s1").repartition(n, "g").sortWithinPartitions("g")
    return sent.mapInArrow(run, "g long, f int, side long, cid long, s0 long, s1 long, big boolean")


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common_before(flat: np.ndarray, row: np.ndarray, n: int, f: int) -> np.ndarray:
    """Bits of each row for the filters below ``f`` that several rows of the group have."""
    own = flat < f
    flat, row = flat[own], row[own]
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    some = times[place] > 1
    place, row = new[place[some]], row[some]
    bits = np.zeros((n, max(1, -(-int((times > 1).sum()) // 64))), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return bits


def _meet(batches, threshold: float):
    """(a, b, 0) of a forest of the links and (a, a, links) counts of each group (see ``near_duplicates``)."""
    for rows, _ in _grouped(batches):
        n = rows.num_rows
        if n < 2:
            continue
        rows = rows.combine_chunks()
        f = rows.column("f")[0].as_py()
        s, cid, w = (rows.column(c).to_numpy().astype(np.int64) for c in ("side", "cid", "weight"))
        x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        filters = rows.column("filters").combine_chunks()
        of = np.repeat(np.arange(n), np.diff(filters.offsets.to_numpy()))
        bits = _common_before(filters.flatten().to_numpy(zero_copy_only=False), of, n, f)
        links = np.zeros(n, dtype=np.int64)
        root = np.arange(n)
        for at in range(0, n, 512):
            dot = x[at : at + 512] @ x.T
            i, j = np.nonzero(dot >= threshold)
            i = i + at
            fit = (i < j) & ((s[i] < 0) | (s[i] != s[j]))
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            root = _roots(np.concatenate([np.arange(n), i]), np.concatenate([root, j]), n)
            for p in range(0, len(i), 1 << 16):
                a, b = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                least = ~(bits[a] & bits[b]).any(axis=1)
                np.add.at(links, a[least], w[b[least]])
                np.add.at(links, b[least], w[a[least]])
        linked, some = np.flatnonzero(root != np.arange(n)), np.flatnonzero(links)
        if len(linked):
            ends = np.concatenate([cid[root[linked]], cid[some]]), np.concatenate([cid[linked], cid[some]])
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(np.concatenate([np.zeros(len(linked), np.int64), links[some]]))], names=["a", "b", "n"])


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = 0.93, cut: int = 2048) -> DataFrame:
    """(key, n_links, component): links of each row and the least key that links reach.

    Only rows with equal, non-null labels and vectors of equal length compare.  Vectors that are
    null, empty, zero, or hold null or non-finite components have no links; repeated rows link with
    each other; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows = rows.withColumn("cid", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.xxhash64("label", "embedding", F.lit(7))))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("weight"), F.min("key").alias("least"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = materialise(classes, "caps-classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    coded = materialise(with_filters(classes, *code_size(most)), "caps-filters")
    slots = coded.select("label", "dim", "cid", "s0", "s1", F.explode("filters").alias("f"))
    slots = slots.select(F.xxhash64("label", "dim", "f").alias("g"), "f", F.lit(-1).cast("long").alias("side"), "cid", "s0", "s1")
    near = most_signs(threshold)
    first = materialise(alive_slots(slots, near, cut, n), "caps-slots")
    # big buckets: within the group of blocks (lo, hi) with lo < hi only pairs across the blocks are new
    big = first.where("big")
    cuts = big.groupBy("g").agg(F.ceil(F.count("*") / cut).alias("cuts"))
    big = big.join(cuts, "g").withColumn("block", F.pmod(F.xxhash64("cid"), "cuts"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(lo == hi, F.lit(-1).cast("long")).otherwise(F.col("block"))
    big = big.select(F.xxhash64("g", lo, hi).alias("g"), "f", side.alias("side"), "cid", "s0", "s1")
    live = first.where("not big").unionByName(alive_slots(big, near, None, n)).select("g", "f", "side", "cid")
    sent = live.join(coded.select("cid", "weight", "embedding", "filters"), "cid")
    sent = sent.select("g", "f", "side", "cid", "weight", "embedding", "filters").repartition(n, "g").sortWithinPartitions("g")
    found = materialise(sent.mapInArrow(lambda batches: _meet(batches, threshold), "a long, b long, n long"), "caps-links")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cid")
    member = connected_components(found.where("n = 0").select("a", "b"))
    usable = coded.select("cid", F.lit(True).alias("usable"))
    named = classes.select("cid", "weight", "least").join(usable, "cid").join(counts, "cid", "left").join(member.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("cid", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    out = rows.select("key", "cid").join(named, "cid", "left")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component"))


def op7_caps(vectors: DataFrame) -> DataFrame:
    found = near_duplicates(vectors)
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
