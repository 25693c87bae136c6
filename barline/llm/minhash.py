"""Near-duplicate detection by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash gives every element of a set a random permutation of the ``m`` slots and a random
fraction for each step; a slot keeps the least step + fraction.  Steps run over all elements of
a set at once and stop as soon as every slot is filled below the next step.  With r = 4 values
in each of 24 bands a pair at similarity 0.8 stays unseen with probability (1 - 0.8**4)**24,
about 3e-6.

Documents with equal sets (by 128 bits of hash of the whole set) are one class.  In a bucket every class is compared with a pivot, the
class with most company over all its buckets.  Classes that the pivot does not link may still
link to others of its group: these few are compared with all members, in blocks (see
``stragglers``).  Every link is confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm import vec
from barline.llm.common import materialise, partitions, row_key
from barline.llm.components import connected_components
from barline.llm.repeats import BLOCKS, UNSURE, _blocks, _read, _with_texts, text_blocks

U64 = np.uint64
GOLD, START = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)

def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the bounds of the texts.

    A shingle is ``size`` consecutive words with A-Z lower-cased; fewer words are one shingle.
    """
    wide, at = vec.spaced(vec.LOWER[buf], offsets)
    h, starts, _ = vec.word_hashes(wide, vec.SPACE, seed=7)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    width = np.minimum(n, size)[doc]
    begins = place + width <= n[doc]
    acc = width.astype(U64) * GOLD
    for j in range(size):
        word = h[np.minimum(np.arange(len(h)) + j, max(0, len(h) - 1))]
        acc = np.where(j < width, vec.mix64(acc + word), acc)
    acc, doc = acc[begins], doc[begins]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    b = vec.bounds_of(doc, acc)[:-1]
    return acc[b], np.searchsorted(doc[b], np.arange(len(n) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of each set (rows; step in the high, fraction in the low 32 bits)."""
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    full = np.full(n_docs * m, np.iinfo(np.uint64).max, dtype=U64)
    elem, perm = sets, None
    for j in range(m):
        if not len(elem):
            break
        x = vec.mix64(elem + U64((j + 1) * int(GOLD) % (1 << 64)))
        k = j + (((x & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            row = np.arange(len(elem))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(full, doc * m + slot, (U64(j) << U64(32)) | (x >> U64(32)))
        open_ = full.reshape(n_docs, m).max(axis=1) >= (U64(j + 1) << U64(32))
        stay = open_[doc]
        if j == 0:
            elem, doc, k = elem[stay], doc[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elem), 1))
            # the first step swapped slots 0 and k
            perm[np.arange(len(elem)), k] = 0
        elif not stay.all():
            elem, doc, perm = elem[stay], doc[stay], perm[stay]
    return full.reshape(n_docs, m)


def sketch(docs: DataFrame, *, bands: int = 24, rows: int = 4, size: int = 2) -> DataFrame:
    """(__rk, doc, n_shingles, set, more, bands) of ``docs`` (__rk, doc, __text): ``set`` and ``more`` are
    two independent 64-bit hashes of the shingle set."""
    kind = dict(docs.dtypes)["doc"]

    def run(batches):
        for batch in batches:
            buf, offsets = vec.text_buffer(batch.column(2))
            count = np.zeros(batch.num_rows, dtype=np.int64)
            name = np.zeros((2, batch.num_rows), dtype=U64)
            keys = np.zeros((batch.num_rows, bands), dtype=U64)
            for a, b in vec.chunks(np.diff(offsets)):
                part = buf[offsets[a] : offsets[b]]
                sets, bounds = shingle_sets(part, offsets[a : b + 1] - offsets[a], size)
                count[a:b] = np.diff(bounds)
                for k, salt in enumerate((GOLD, START)):
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(vec.mix64(sets ^ salt), dtype=U64)])
                    name[k, a:b] = vec.mix64(sums[bounds[1:]] - sums[bounds[:-1]] + count[a:b].astype(U64))
                sig = signatures(sets, bounds, bands * rows).reshape(b - a, bands, rows)
                acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * GOLD, (b - a, bands))
                for r in range(rows):
                    acc = vec.mix64(acc + sig[:, :, r])
                keys[a:b] = acc
            offs = np.arange(batch.num_rows + 1, dtype=np.int32) * bands
            key_col = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), *(pa.array(x.view(np.int64)) for x in name), key_col], names=["__rk", "doc", "n_shingles", "set", "more", "bands"])

    return docs.select("__rk", "doc", "__text").mapInArrow(run, f"__rk long, doc {kind}, n_shingles long, set long, more long, bands array<long>")


def _salt(member: str, places: int) -> Column:
    """Place of a member of a group, one for each shuffle partition, so that a hot group spreads over all
    tasks; what is said of the group is sent to the places in use, never more than it has members."""
    return F.pmod(F.xxhash64(member), F.lit(places))


def verify(pairs: DataFrame, texts: DataFrame, *, percent: int, size: int, group: int = 256) -> DataFrame:
    """Each of ``pairs`` (a, b), row keys: linked, n_a, n_b and diff, the hashes in one set only (where
    b has several partners).

    Pairs of one b are cut into groups of about ``group``; the texts travel to the groups.  The number of
    cuts meets the pairs of a hot b in salted places.
    """
    n = partitions(pairs.sparkSession)
    pairs = pairs.withColumn("salt", _salt("a", n))
    sizes = pairs.groupBy("b", "salt").agg(F.count("*").alias("n")).groupBy("b").agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))
    sizes = sizes.select("b", F.ceil(F.col("n") / group).alias("cuts"), (F.col("n") > 1).cast("long").alias("many"), F.explode("salts").alias("salt"))
    cut = pairs.join(sizes, ["b", "salt"]).select("a", "b", (F.pmod(F.xxhash64("a"), "cuts") * 2 + F.col("many")).alias("cut"))
    asks = cut.select(F.col("a").alias("rk"), "b", "cut").unionByName(cut.select(F.col("b").alias("rk"), "b", "cut").distinct())

    def pack_asks(batches):
        for batch in batches:
            rk, b, c = (batch.column(i).to_numpy(zero_copy_only=False).view(U64) for i in range(3))
            yield from _blocks(UNSURE, (rk % U64(n)).astype(np.int64), [rk, b, c])

    names = ["kind", "part", "n", "block"]

    def send(batches):
        for table, rows in _read(batches, 3):
            rk = rows.column(0).to_numpy(zero_copy_only=False).view(U64)
            lo, hi = np.searchsorted(table[0], rk), np.searchsorted(table[0], rk, side="right")
            count = hi - lo
            if not count.sum():
                continue
            row = np.repeat(np.arange(len(rk)), count)
            at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            b, c = table[1, at], table[2, at]
            part = (vec.mix64(b + c * GOLD) % U64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = vec.bounds_of(part[order])
            for x, y in zip(edge[:-1], edge[1:]):
                own = order[x:y]
                block = pa.RecordBatch.from_arrays([pa.array(b[own]), pa.array(c[own]), pa.array(rk[row[own]]), rows.column(1).take(pa.array(row[own]))], names=["b", "c", "rk", "t"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(block)
                yield pa.RecordBatch.from_arrays([pa.array([UNSURE], pa.int32()), pa.array([int(part[order[x]])], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)

    def compare(batches):
        sets: dict[int, np.ndarray] = {}
        groups: dict[tuple[int, int], set[int]] = {}
        for batch in batches:
            for block in batch.column(3):
                with pa.ipc.open_stream(block.as_buffer()) as r:
                    for rows in r:
                        b, c, rk = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                        found, bounds = shingle_sets(*vec.text_buffer(rows.column(3)), size)
                        for i in range(len(rk)):
                            groups.setdefault((int(b[i]), int(c[i])), set()).add(int(rk[i]))
                            if int(rk[i]) not in sets:
                                sets[int(rk[i])] = found[bounds[i] : bounds[i + 1]].copy()
        out: list[tuple] = []
        for (b, c), members in groups.items():
            base = sets[b]
            for a in members:
                if a == b:
                    continue
                other = sets[a]
                if c & 1:
                    diff = np.setxor1d(base, other, assume_unique=True)
                    both = (len(base) + len(other) - len(diff)) // 2
                else:
                    diff, both = None, len(np.intersect1d(base, other, assume_unique=True))
                linked = 100 * both >= percent * (len(base) + len(other) - both)
                out.append((a, b, linked, len(other), len(base), None if diff is None else diff.view(np.int64)))
                if len(out) >= 4096:
                    yield result(out)
                    out = []
        if out:
            yield result(out)

    def result(out: list[tuple]) -> pa.RecordBatch:
        a, b, linked, n_a, n_b, diff = zip(*out)
        keys = [pa.array(np.array(k, dtype=U64).view(np.int64)) for k in (a, b)]
        rest = [pa.array(linked, pa.bool_()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(diff, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*keys, *rest], names=["a", "b", "linked", "n_a", "n_b", "diff"])

    asked = asks.select("rk", "b", F.col("cut").cast("long").alias("cut")).mapInArrow(pack_asks, BLOCKS)
    sent = _with_texts(asked, texts, n).mapInArrow(send, BLOCKS)
    return sent.repartitionById(n, F.col("part")).mapInArrow(compare, "a long, b long, linked boolean, n_a long, n_b long, diff array<long>")


def stragglers(checked: DataFrame, *, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) between the partners of a pivot when one at least is not linked to the pivot.

    The difference of two sets is that of their differences to the pivot, so no text is read again.
    The unlinked members of a group are the queries, all members the rows; both are cut into blocks, and a block of queries
    meets a block of rows in one group of at most about 2 * ``block`` rows, which returns links only.
    The sizes of a group meet its members in salted places.
    """
    some = checked.where("diff is not null").select("b", "a", "linked", F.col("n_a").alias("n"), "diff").withColumn("salt", _salt("a", partitions(checked.sparkSession)))
    part = some.groupBy("b", "salt").agg(F.count("*").alias("rows"), F.count_if(~F.col("linked")).alias("asks"))
    sizes = part.groupBy("b").agg(F.ceil(F.sum("rows") / block).alias("rows"), F.ceil(F.sum("asks") / block).alias("asks"), F.collect_set("salt").alias("salts")).where("asks > 0")
    some = materialise(some.join(sizes.withColumn("salt", F.explode("salts")).drop("salts"), ["b", "salt"]).drop("salt"), "minhash-diffs")
    own = F.xxhash64("a", F.lit(3))
    asks = some.where("not linked").withColumns({"i": F.pmod(own, "asks"), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))})
    rows = some.withColumns({"j": F.pmod(own, "rows"), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))})
    both = asks.withColumn("ask", F.lit(True)).unionByName(rows.withColumn("ask", F.lit(False)))
    both = both.select(F.xxhash64("b", "i", "j").alias("g"), "ask", "a", "n", "diff")

    def meet(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        ask, a, n = (table.column(c).to_numpy() for c in ("ask", "a", "n"))
        if not ask.any() or ask.all():
            return
        diff = table.column("diff").combine_chunks()
        size = np.diff(diff.offsets.to_numpy())
        row = np.repeat(np.arange(len(a)), size)
        _, place, times = np.unique(diff.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times > 1
        new = np.cumsum(shared) - 1
        row, place = row[shared[place]], new[place[shared[place]]]
        index = np.cumsum(ask) - 1, np.cumsum(~ask) - 1
        overlap = np.zeros((int(ask.sum()), int((~ask).sum())), dtype=np.float32)
        for at in range(0, int(shared.sum()), 8192):
            now = (place >= at) & (place < at + 8192)
            sides = []
            for mine, idx in zip((ask, ~ask), index):
                own = now & mine[row]
                m = np.zeros((int(mine.sum()), 8192), dtype=np.float32)
                m[idx[row[own]], place[own] - at] = 1
                sides.append(m)
            overlap += sides[0] @ sides[1].T
        total = n[ask][:, None] + n[~ask][None, :]
        gap = size[ask][:, None] + size[~ask][None, :] - 2 * overlap.astype(np.int64)
        inner = (total - gap) // 2
        i, j = np.nonzero((100 * inner >= percent * (total - inner)) & (a[ask][:, None] != a[~ask][None, :]))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(a[ask][i]), pa.array(a[~ask][j])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            g = batch.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(g)) + 1
            for lo, hi in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(g)]])):
                if hi == lo:
                    continue
                if held and g[lo] != group:
                    yield from meet(held)
                    held = []
                group = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from meet(held)

    n = partitions(checked.sparkSession)
    return both.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 80, size: int = 2, bands: int = 24, rows: int = 4) -> DataFrame:
    """(key, __rk, n_shingles, component, __group): component is the least key that links reach;
    ``__group`` tells groups apart whatever their keys (null: no words).

    Documents without words, empty or null texts have no shingles and are their own component;
    very long texts have all their shingles; repeated rows fall into one class; of pivots with equal
    company the greatest row key serves; nulls among the keys count as greatest; an empty table gives
    an empty result; other columns are ignored.
    """
    src = docs.select(F.col(key).alias("doc"), row_key(key, text).alias("__rk"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sig = materialise(sketch(src, bands=bands, rows=rows, size=size), "minhash-sketch")
    named = sig.where("n_shingles > 0")
    classes = named.groupBy("set", "more").agg(F.min(F.struct("__rk", "bands")).alias("m"), F.min("doc").alias("least"))
    classes = materialise(classes.select("set", "more", F.col("m.__rk").alias("rep"), F.col("m.bands").alias("bands"), "least"), "minhash-classes")
    slots = classes.select("rep", F.explode("bands").alias("slot"))
    full = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    live = materialise(slots.join(full, "slot"), "minhash-buckets")
    company = live.groupBy("rep").agg(F.sum("n").alias("company"))
    known = live.select("slot", "rep").join(company, "rep")
    pivots = known.groupBy("slot").agg(F.max(F.struct("company", "rep")).alias("top"))
    star = live.select("slot", "rep").join(pivots, "slot").select(F.col("rep").alias("a"), F.col("top.rep").alias("b")).where("a <> b").distinct()
    texts = text_blocks(src, partitions(docs.sparkSession), [])
    checked = materialise(verify(star, texts, percent=percent, size=size), "minhash-checked")
    links = checked.where("linked").select("a", "b").unionByName(stragglers(checked, percent=percent))
    member = connected_components(links)
    # only linked classes need a name; a hot group meets its name in salted places
    linked = classes.select("set", "more", "rep", "least").join(member.withColumnRenamed("node", "rep"), "rep")
    linked = linked.withColumn("salt", _salt("rep", partitions(docs.sparkSession)))
    part = linked.groupBy("root", "salt").agg(F.min("least").alias("least"))
    name = part.groupBy("root").agg(F.min("least").alias("component"), F.collect_set("salt").alias("salts")).withColumn("salt", F.explode("salts")).drop("salts")
    placed = linked.join(name, ["root", "salt"]).select("set", "more", "root", "component")
    alone = classes.join(member.select(F.col("node").alias("rep")), "rep", "left_anti").select("set", "more", F.col("rep").alias("root"), F.col("least").alias("component"))
    named_set = materialise(placed.unionByName(alone), "minhash-names")
    some = F.col("n_shingles") > 0
    out = sig.select("doc", "__rk", "n_shingles", F.when(some, F.col("set")).alias("set"), F.when(some, F.col("more")).alias("more")).join(named_set, ["set", "more"], "left")
    return out.select(F.col("doc").alias(key), "__rk", "n_shingles", F.when(some, F.col("component")).otherwise(F.col("doc")).alias("component"), F.col("root").alias("__group"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group (the least key, then row key); rows without words stay."""
    found = groups(docs, key=key, text=text, **options)
    first = found.where("n_shingles > 0").groupBy("__group").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key), F.col("__rk"))).alias("m"))
    keep = first.select(F.col("m.__rk").alias("__rk"), F.lit(True).alias("__one"))
    keep = keep.unionByName(found.where("n_shingles = 0").select("__rk").distinct().withColumn("__one", F.lit(False)))
    rows = docs.withColumn("__rk", row_key(key, text)).join(keep, "__rk")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__rk").orderBy("__one")))
    return rows.where("not __one or __n = 1").select(*docs.columns)


def op9_minhash(docs: DataFrame) -> DataFrame:
    found = groups(docs)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
