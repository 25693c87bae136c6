"""Exact detection of long repeats by a logarithmic family of sorted arrays of sampled suffixes.

A text is a sequence of symbols (bytes or words).  A *window* of ``window`` symbols is repeated
if it starts at another place too.  Of the grams of ``gram`` symbols inside a window, the one of
least hash (the last one on ties) is its *anchor*: equal windows have equal anchors at equal
offsets, so every repeat meets itself at an anchor, though only about 2 / (window - gram + 2) of
the positions are indexed.

*Entry*: the suffix that starts at an anchor, with its sort key and a hash of all the text (the
cover) that the windows of the anchor reach.  The key of a byte suffix is its first 16 bytes, then
a fingerprint of its gram, then the cover; the key of a word suffix is gram and cover.  So an
array of entries is in byte order as far as 16 bytes tell, and suffixes whose longest common
prefix reaches a gram are neighbours.

*Run*: the entries of a batch, cut by fingerprint into parts and sorted by key in each block.
*Merge-scan*: the sorted blocks of a run and of the existing levels are merged part by part, and
neighbours compared: a common cover settles all windows of both, a common prefix of a gram alone
leaves them open.  Open windows are verified one by one against the texts.  *Levels*: a run merges
with every level of its own size, as in a binary counter, equal covers are compacted to one entry,
and the merged level is written sorted; a level is never changed.

Rows travel as packed blocks of numpy columns; copies inside a block are combined before the
shuffle, so a passage held by a third of all documents costs one entry for each block.  Keys are
64-bit hashes of content: gram and cover together have 128 bits, windows are verified by two
hashes of different bases.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import vec
from barline.llm.common import materialise, partitions, row_key

U64 = np.uint64
PIECE = (1 << 18) - 1
SETTLED, UNSURE, TEXT, ANCHOR, LEVEL = 0, 1, 2, 3, 4
BLOCKS = "kind int, part int, n long, block binary"


@dataclass(frozen=True)
class Alphabet:
    """What a text is cut into, and how long a repeat must be."""

    unit: str  # "byte" or "word"
    window: int
    gram: int

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.window < 1 << 15:
            raise ValueError("a window has 1 to 32767 symbols, a gram no more than its window")

    @property
    def lead(self) -> int:
        """Number of key columns that hold the first bytes of a suffix."""
        return 2 if self.unit == "byte" else 0

    def first_bytes(self, symbols: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The first 16 bytes of the suffixes (of their grams, if these are shorter) as numbers in byte order."""
        if not self.lead:
            return []
        size = min(16, self.gram)
        out = np.zeros((len(at), 16), dtype=np.uint8)
        out[:, :size] = symbols[at[:, None] + np.arange(size)]
        return list(out.view(">u8").astype(U64).T)

    def symbols(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.unit == "byte":
            return buf, offsets
        wide, at = vec.spaced(buf, offsets)
        h, starts, _ = vec.word_hashes(wide, vec.SPACE, seed=5)
        return h, np.searchsorted(starts, at)

    def codes(self, symbols: np.ndarray, seed: int) -> np.ndarray:
        if self.unit == "byte":
            return vec.byte_codes(seed)[symbols]
        return vec.mix64(symbols + U64(seed * 0x9E3779B9))

    def pieces(self, offsets: np.ndarray):
        """(first text, last text, from, to) of slices of bounded length; slices of one long text
        overlap so that each window lies in exactly one."""
        for a, b in vec.chunks(np.diff(offsets), PIECE):
            lo, hi = int(offsets[a]), int(offsets[b])
            if hi - lo <= PIECE:
                yield a, b, lo, hi
            else:
                step = PIECE - (self.window - 1)
                for at in range(lo, max(lo + 1, hi - self.window + 1), step):
                    yield a, b, at, min(hi, at + PIECE)

    def anchors(self, symbols: np.ndarray, offsets: np.ndarray):
        """Columns (text, first window, further windows, first bytes, gram hash, cover hash)."""
        out = []
        for a, b, lo, hi in self.pieces(offsets):
            n = hi - lo
            if n < self.window:
                continue
            sym = symbols[lo:hi]
            one = vec.Rolling(self.codes(sym, 1), 1)
            grams = one.windows(self.gram)
            mask = U64(PIECE)
            place = mask - np.arange(len(grams), dtype=U64)
            low = vec.sliding_min((grams & ~mask) | place, self.window - self.gram + 1)
            inner = np.clip(offsets[a : b + 1] - lo, 0, n)
            ends = np.repeat(inner[1:], np.diff(inner))[: len(low)]
            first = np.flatnonzero(np.arange(len(low)) + self.window <= ends)
            if not len(first):
                continue
            anchor = (mask - (low[first] & mask)).astype(np.int64)
            new = np.ones(len(first), dtype=bool)
            new[1:] = (np.diff(anchor) != 0) | (np.diff(first) != 1)
            at = np.flatnonzero(new)
            start, stop = first[at], first[np.append(at[1:], len(first)) - 1]
            anchor = anchor[at]
            two = vec.Rolling(self.codes(sym, 2), 2)
            cover = two.slices(start, stop + self.window)
            shape = ((anchor - start).astype(U64) << U64(32)) | (stop - start).astype(U64)
            cover = vec.mix64(cover ^ vec.mix64(shape + U64(99)))
            text = a + np.searchsorted(inner, start, side="right") - 1
            # empty texts share their offset with the next; searchsorted on the right skips them
            # the least hashes crowd at the low end; mixed again they spread over the partitions
            out.append((text, start + lo - offsets[text], stop - start, *self.first_bytes(sym, anchor), vec.mix64(grams[anchor] ^ U64(PIECE)), cover))
        if not out:
            z = np.zeros(0, np.int64)
            return (z, z, z, *[z.astype(U64)] * (self.lead + 2))
        return tuple(np.concatenate(c) for c in zip(*out))

    def window_hashes(self, symbols: np.ndarray, start: np.ndarray, count: np.ndarray):
        """Two hashes of each of ``count`` windows from each ``start`` of one text, and their places."""
        place = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        place = np.unique(place)
        h1, h2 = np.zeros(len(place), U64), np.zeros(len(place), U64)
        at = 0
        while at < len(place):
            lo = int(place[at])
            to = int(np.searchsorted(place, lo + PIECE - self.window, side="right"))
            sym = symbols[lo : int(place[to - 1]) + self.window]
            s = place[at:to] - lo
            h1[at:to] = vec.Rolling(self.codes(sym, 3), 3).slices(s, s + self.window)
            h2[at:to] = vec.Rolling(self.codes(sym, 6), 6).slices(s, s + self.window)
            at = to
        return place, h1, h2


def _blocks(kind: int, part: np.ndarray, columns: list[np.ndarray], limit: int = 1 << 17):
    """Packed blocks of at most ``limit`` rows for each target partition, rows in the given order."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    b = vec.bounds_of(part)
    if len(b) < 2:
        return
    columns = [c[order] for c in columns]
    cuts = [(lo, min(lo + limit, hi)) for first, hi in zip(b[:-1], b[1:]) for lo in range(first, hi, limit)]
    for at in range(0, len(cuts), 64):
        own = cuts[at : at + 64]
        arrays = [pa.array([kind] * len(own), pa.int32()), pa.array([int(part[lo]) for lo, _ in own], pa.int32()), pa.array([int(hi - lo) for lo, hi in own], pa.int64()), pa.array([vec.pack(*[c[lo:hi] for c in columns]) for lo, hi in own], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "part", "n", "block"])


def _ranged(h: np.ndarray, n: int) -> np.ndarray:
    """Partition of a hash, in hash order."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _columns(found: list[bytes], k: int) -> np.ndarray:
    return np.concatenate([vec.unpack(x) for x in found], axis=1) if found else np.zeros((k, 0), U64)


def _key_order(key: list[np.ndarray]) -> np.ndarray:
    """Stable order by the columns of ``key`` in turn.  The columns become strings of bytes, whose
    stable sort in numpy merges the sorted stretches that it finds: sorted blocks laid end to end are
    merged, not sorted anew."""
    rows = np.ascontiguousarray(np.stack(key, axis=1).astype(">u8"))
    return np.argsort(rows.view(f"S{8 * len(key)}")[:, 0], kind="stable")


def make_run(docs: DataFrame, alphabet: Alphabet, n: int) -> DataFrame:
    """Sorted blocks of the entries of ``docs`` (__rk, __text); covers that recur inside a block of
    texts are settled at once and leave one entry."""

    def run(batches):
        for batch in batches:
            rk = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            buf, offsets = vec.text_buffer(batch.column(1))
            text, start, more, *key = alphabet.anchors(*alphabet.symbols(buf, offsets))
            order = np.lexsort(key[::-1])
            text, start, more, *key = (c[order] for c in (text, start, more, *key))
            b = vec.bounds_of(*key[-2:])
            size = np.diff(b)
            again = np.repeat(size > 1, size)
            first = b[:-1]
            place = (start.astype(U64) << U64(16)) | (more.astype(U64) << U64(1))
            yield from _blocks(SETTLED, (rk[text[again]] % U64(n)).astype(np.int64), [rk[text[again]], place[again]])
            entry = place[first] | again[first].astype(U64)
            yield from _blocks(ANCHOR, _ranged(key[-2][first], n), [*(c[first] for c in key), rk[text[first]], entry])

    return docs.mapInArrow(run, BLOCKS)


def merge_scan(blocks: DataFrame, alphabet: Alphabet, n: int, absorb_below: int, keep_level: bool) -> DataFrame:
    """Merge all sorted blocks of a part and compare neighbours.

    ``kind`` is ANCHOR for the new run and LEVEL + i for level i.  Yields settled ranges, unsure ones
    with a partner for each other cover of their gram, and the merged level made of the new run and
    the levels from ``absorb_below`` on, sorted.
    """
    wide = alphabet.lead + 4

    def run(batches):
        got: list[bytes] = []
        kinds: list[tuple[int, int]] = []
        for batch in batches:
            for kind, part, size, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == SETTLED:
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["kind", "part", "n", "block"])
                else:
                    got.append(block)
                    kinds.append((kind, size))
        if not got:
            return
        columns = _columns(got, wide)
        origin = np.repeat([k for k, _ in kinds], [s for _, s in kinds])
        got.clear()
        order = _key_order(list(columns[:-2]))
        columns, origin = columns[:, order], origin[order]
        gram, cover, rk, place = columns[-4:]
        # neighbours with a common prefix of a gram, and those with a common cover
        of_gram = vec.bounds_of(*columns[:-3])
        same = vec.bounds_of(*columns[:-2])
        size = np.diff(same)
        done = (place & U64(1)).astype(bool)
        weight = np.add.reduceat(1 + done, same[:-1])
        again = np.repeat(weight > 1, size)
        fresh = np.repeat(np.logical_or.reduceat(origin == ANCHOR, of_gram[:-1]), np.diff(of_gram))
        settled = again & ~done & fresh
        yield from _blocks(SETTLED, (rk[settled] % U64(n)).astype(np.int64), [rk[settled], place[settled]])
        # more than one cover for the gram, one of them open
        first = np.zeros(len(gram), dtype=bool)
        first[same[:-1]] = True
        covers = np.repeat(np.add.reduceat(first.astype(np.int64), of_gram[:-1]), np.diff(of_gram))
        open_ = ~again & fresh & (covers > 1)
        any_open = np.repeat(np.logical_or.reduceat(open_, of_gram[:-1]), np.diff(of_gram))
        partner = first & again & any_open
        ask = open_ | partner
        flagged = (place[ask] & ~U64(1)) | partner[ask].astype(U64)
        yield from _blocks(UNSURE, (rk[ask] % U64(n)).astype(np.int64), [rk[ask], flagged])
        if keep_level:
            own = (origin == ANCHOR) | (origin >= LEVEL + absorb_below)
            keep = own & (np.cumsum(own) - np.repeat(np.cumsum(own)[same[:-1]] - own[same[:-1]], size) == 1)
            entry = (place & ~U64(1)) | again.astype(U64)
            yield from _blocks(LEVEL, _ranged(gram[keep], n), [*columns[:-1, keep], entry[keep]])

    return blocks.repartitionById(n, F.col("part")).mapInArrow(run, BLOCKS)


def text_blocks(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """Texts with their keys, packed and compressed by target partition."""
    names = ["__rk", "__text", *keep]

    def run(batches):
        for batch in batches:
            rk = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            part = (rk % U64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            b = vec.bounds_of(part[order])
            for lo, hi in zip(b[:-1], b[1:]):
                rows = batch.take(pa.array(order[lo:hi]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([int(part[order[lo]])], pa.int32()), pa.array([int(hi - lo)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["kind", "part", "n", "block"])

    return docs.select(*names).mapInArrow(run, BLOCKS)


def _with_texts(small: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Both kinds of blocks of a partition together, the small ones first."""
    return small.unionByName(texts).repartitionById(n, F.col("part")).sortWithinPartitions("kind")


def _read(batches, k: int):
    """The small columns of the partition, sorted by key, then each block of texts."""
    found: list[bytes] = []
    table = None
    for batch in batches:
        for kind, block in zip(batch.column(0).to_pylist(), batch.column(3)):
            if kind != TEXT:
                found.append(block.as_py())
                continue
            if table is None:
                c = _columns(found, k)
                table = c[:, np.argsort(c[0], kind="stable")]
                found = []
            with pa.ipc.open_stream(block.as_buffer()) as r:
                for rows in r:
                    yield table, rows


def verify_windows(unsure: DataFrame, texts: DataFrame, alphabet: Alphabet, n: int) -> DataFrame:
    """Settled single windows among the unsure ranges, by two hashes of their whole text.

    Windows that recur among those a task holds are settled at once and go on as one.
    """
    limit = 1 << 19

    def hash_windows(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            h1, h2, rk, place = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((place, rk, h2, h1))
            h1, h2, rk, place = h1[order], h2[order], rk[order], place[order]
            b = vec.bounds_of(h1, h2)
            many = np.repeat(np.diff(b) > 1, np.diff(b))
            hit = many & ((place & U64(1)) == 0)
            yield from _blocks(SETTLED, (rk[hit] % U64(n)).astype(np.int64), [rk[hit], place[hit]])
            first = b[:-1]
            yield from _blocks(UNSURE, _ranged(h1[first], n), [h1[first], h2[first], rk[first], place[first] | many[first].astype(U64)])

        for table, rows in _read(batches, 2):
            rk = rows.column(0).to_numpy(zero_copy_only=False).view(U64)
            lo, hi = np.searchsorted(table[0], rk), np.searchsorted(table[0], rk, side="right")
            wanted = np.flatnonzero(hi > lo)
            if not len(wanted):
                continue
            part = rows.take(pa.array(wanted))
            symbols, offsets = alphabet.symbols(*vec.text_buffer(part.column(1)))
            for j, i in enumerate(wanted):
                place = table[1, lo[i] : hi[i]]
                own = symbols[offsets[j] : offsets[j + 1]]
                for partner in (0, 1):
                    p = place[(place & U64(1)) == partner]
                    if len(p):
                        at, h1, h2 = alphabet.window_hashes(own, (p >> U64(16)).astype(np.int64), ((p >> U64(1)) & U64(0x7FFF)).astype(np.int64) + 1)
                        held.append((h1, h2, np.full(len(at), rk[i]), (at.astype(U64) << U64(16)) | U64(partner)))
                        size += len(at)
                if size > limit:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def meet(batches):
        found = []
        for batch in batches:
            for kind, part, size, block in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == SETTLED:
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["kind", "part", "n", "block"])
                else:
                    found.append(block)
        if not found:
            return
        h1, h2, rk, place = _columns(found, 4)
        order = np.lexsort((h2, h1))
        h1, h2, rk, place = h1[order], h2[order], rk[order], place[order]
        size = np.diff(vec.bounds_of(h1, h2))
        hit = np.repeat(size > 1, size) & ((place & U64(1)) == 0)
        yield from _blocks(SETTLED, (rk[hit] % U64(n)).astype(np.int64), [rk[hit], place[hit]])

    hashed = _with_texts(unsure, texts, n).mapInArrow(hash_windows, BLOCKS)
    return hashed.repartitionById(n, F.col("part")).mapInArrow(meet, BLOCKS)


class RepeatIndex:
    """Levels of sorted entries in the shared folder; ``scan`` indexes a batch and finds what it repeats."""

    def __init__(self, spark: SparkSession, alphabet: Alphabet, n: int | None = None):
        self.spark, self.alphabet, self.n = spark, alphabet, n or partitions(spark)
        self.levels: list[tuple[int, DataFrame]] = []  # (rows, entries); sizes fall

    def scan(self, batch: DataFrame, *, rows: int | None = None, keep_level: bool = True) -> tuple[DataFrame, DataFrame]:
        """(settled, unsure) ranges of the new rows against all, and of old rows against the new.

        ``batch`` has __rk and __text, ``rows`` is its size where that is known.
        """
        run = make_run(batch.select("__rk", "__text"), self.alphabet, self.n)
        blocks = run
        for i, (_, level) in enumerate(self.levels):
            blocks = blocks.unionByName(level.withColumn("kind", F.lit(LEVEL + i)))
        absorb = len(self.levels)
        rows = batch.count() if rows is None else rows
        while keep_level and absorb and self.levels[absorb - 1][0] <= 1.5 * rows:
            absorb -= 1
            rows += self.levels[absorb][0]
        scanned = materialise(merge_scan(blocks, self.alphabet, self.n, absorb, keep_level), "repeats-scan")
        if keep_level:
            self.levels = [*self.levels[:absorb], (rows, scanned.where(F.col("kind") == LEVEL))]
        return scanned.where(F.col("kind") == SETTLED), scanned.where(F.col("kind") == UNSURE)

    def verify(self, unsure: DataFrame, corpus: DataFrame) -> DataFrame:
        """Settled windows of the unsure ranges; ``corpus`` must hold the texts of every batch so far."""
        return materialise(verify_windows(unsure, text_blocks(corpus, self.n, []), self.alphabet, self.n), "repeats-verified")

    def add(self, batch: DataFrame, corpus: DataFrame, *, rows: int | None = None, keep_level: bool = True) -> DataFrame:
        """Everything that ``batch`` repeats or makes repeated, verified."""
        settled, unsure = self.scan(batch, rows=rows, keep_level=keep_level)
        return settled.unionByName(self.verify(unsure, corpus))


def covered(docs: DataFrame, settled: DataFrame, alphabet: Alphabet, keep: list[str], n: int) -> DataFrame:
    """What is left of each text: ``keep`` columns, n_units, n_removed, spans, kept (binary)."""
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    schema = f"{fields}, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for table, rows in _read(batches, 2):
            rk = rows.column(0).to_numpy(zero_copy_only=False).view(U64)
            lo, hi = np.searchsorted(table[0], rk), np.searchsorted(table[0], rk, side="right")
            buf, offsets = vec.text_buffer(rows.column(1))
            units, removed, spans, kept = [], [], [], []
            for i in range(len(rk)):
                raw = buf[offsets[i] : offsets[i + 1]].tobytes()
                parts = raw.split() if alphabet.unit == "word" else None
                size = len(raw) if parts is None else len(parts)
                units.append(size)
                place = table[1, lo[i] : hi[i]]
                if not len(place):
                    removed.append(0)
                    spans.append([])
                    kept.append(raw if parts is None else b" ".join(parts))
                    continue
                start = (place >> U64(16)).astype(np.int64)
                end = start + ((place >> U64(1)) & U64(0x7FFF)).astype(np.int64) + alphabet.window
                depth = np.zeros(size + 1, dtype=np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                if parts is None:
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                else:
                    kept.append(b" ".join(w for w, g in zip(parts, gone) if not g))
            arrays = [pa.array(units, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column(2 + k) for k in range(len(keep))] + arrays, names=[*keep, "n_units", "n_removed", "spans", "kept"])

    return _with_texts(settled, text_blocks(docs, n, keep), n).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, alphabet: Alphabet, *, text: str = "text", keep: list[str], batches: int = 4, part_bytes: int = 1 << 28) -> DataFrame:
    """Index ``docs`` in ``batches`` and drop every symbol that a repeated window covers.

    One row for each input row: ``keep`` columns, n_units, n_removed, spans (in symbols), kept.
    Null and empty texts give no units; repeated rows repeat each other; texts shorter than a window
    stay whole, very long ones are read in overlapping pieces; an empty table gives an empty result;
    other columns are ignored.

    The batches are dealt by a hash of the row; with four of them the second run merges with the first
    and the last is scanned against two levels.  Open windows of all batches are verified together, so
    texts are shuffled twice.  There is a part for each ``part_bytes`` of text, and no fewer than
    shuffle partitions.
    """
    spark = docs.sparkSession
    cols = [F.col(c).alias(c) for c in keep]
    rows = docs.select(row_key(*dict.fromkeys([*keep, text])).alias("__rk"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *cols)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    index = RepeatIndex(spark, alphabet, max(partitions(spark), size // part_bytes))
    settled, unsure = [], []
    for b in range(batches):
        own = rows.where(F.pmod(F.shiftrightunsigned("__rk", 32), F.lit(batches)) == b)
        found = index.scan(own, rows=1, keep_level=b < batches - 1)
        settled.append(found[0])
        unsure.append(found[1])
    verified = index.verify(reduce(DataFrame.unionByName, unsure), rows)
    return covered(rows, reduce(DataFrame.unionByName, [*settled, verified]), alphabet, keep, index.n)
