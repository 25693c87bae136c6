"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``block`` words.  Slot n lands on the golden-ratio point
frac((n + 1/2) * phi); the cumulative target weights map it to a source.  Slots are ranked
per source, and the k-th slot of a source takes the k-th block of that source's stream:
its documents in hash order, cut into blocks of equal size, begun again when it ends.
The schedule sets the order only: a source's last slot ends at its target, rounded to words,
and a source without a slot gets one by its hash.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import materialise

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
_NULL = "\x00null"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Target of each source (source, source_size -> target), in closed form.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Capped sources are those
    with the smallest size / weight; after the k smallest are capped the others share what is
    left by weight.  The first k at which nobody is above the cap is the answer.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("limit", cap * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    t = t.withColumn("k", F.row_number().over(by))
    t = t.withColumn("capped", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("w_left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left"))
    # source k and all after it are free if even source k stays below its limit
    t = t.withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    first = F.min(F.when(F.col("free"), F.col("k"))).over(everything)
    t = t.withColumn("first_free", first)
    level = F.max(F.when(F.col("k") == F.col("first_free"), F.col("level"))).over(everything)
    t = t.withColumn("share", level)
    target = F.when(F.col("k") < F.coalesce(F.col("first_free"), F.lit(1 << 30)), F.col("limit")).otherwise(F.col("share") * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def schedule(goal: DataFrame, block: int, total: int) -> DataFrame:
    """Slots of each source: (source, rank) for every slot of the mix; ``goal`` has (source, target)."""
    spark = goal.sparkSession
    n_slots = max(1, -(-total // block))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    edges = goal.withColumn("hi", F.sum("target").over(order)).withColumn("lo", F.col("hi") - F.col("target"))
    scale = F.sum("target").over(Window.partitionBy())
    edges = edges.withColumn("lo", F.col("lo") / scale).withColumn("hi", F.when(F.col("hi") == scale, 2.0).otherwise(F.col("hi") / scale)).where("target > 0")
    # One row holds the sorted edges; a binary search by bucketed lookup would serve millions of
    # sources, a sequence of intervals joined on a grid serves any number without nested loops.
    grid = 4096
    cells = edges.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.floor(F.least(F.col("hi"), F.lit(1.0 - 1e-12)) * grid))).alias("cell"))
    x = (F.col("id") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumn("x", x - F.floor(x))
    slots = slots.withColumn("cell", F.floor(F.col("x") * grid))
    return slots.join(cells, "cell").where("x >= lo and x < hi").select("id", "source")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", block: int | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Words that the mix takes from each document.

    Returns (key, source, size, source_size, target, taken, first_slot), one row for each input
    row.  ``block`` words make a slot (by default 256, fewer in a mix of few words and more where
    there would be over 2**26 slots).  ``first_slot`` is the place of the document in the mix (null: not taken).  Null texts
    have size 0 and take nothing; a null source is a source of its own; repeated rows are separate
    documents; an empty table gives an empty result.  Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text), F.col(source)).alias("h"))
    rows = materialise(rows, "mix-sizes")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or max(1, min(256, total // 5000), total >> 26)
    # Streams: documents of a source by hash.  A source is cut into bins of the hash, so that no task
    # orders a whole source, and bins are laid end to end; the square root keeps both steps small.
    bins = max(1, math.isqrt(n_rows) // 2)
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(_NULL))).withColumn("bin", F.pmod(F.shiftrightunsigned("h", 20), F.lit(bins)))
    per_bin = rows.groupBy("src", "bin").agg(F.sum("size").alias("bin_size"), F.first("source", ignorenulls=True).alias("source"))
    per_bin = per_bin.withColumn("before", F.sum("bin_size").over(Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
    sizes = per_bin.groupBy("src").agg(F.sum("bin_size").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    goal = materialise(targets(sizes.select("source", "source_size"), weights, cap), "mix-goal")
    goal = goal.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(_NULL)))
    slots = schedule(goal.select("source", "target"), block, total) if total else None
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("src", "bin").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inner", offset).join(per_bin.select("src", "bin", F.coalesce("before", F.lit(0)).alias("before")), ["src", "bin"])
    placed = placed.select("key", "source", "src", "size", (F.col("before") + F.col("inner")).alias("at"))
    if slots is None:
        out = placed.join(goal.select("src", "source_size", "target"), "src")
        return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    # Ranks of slots: the k-th slot of a source (from 0), numbered bin by bin like the rows.
    stripe = max(1, 2 * math.isqrt(total // block))
    slots = slots.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(_NULL))).withColumn("stripe", F.floor(F.col("id") / stripe))
    per_stripe = slots.groupBy("src", "stripe").count()
    per_stripe = per_stripe.withColumn("ahead", F.coalesce(F.sum("count").over(Window.partitionBy("src").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("r", F.row_number().over(Window.partitionBy("src", "stripe").orderBy("id")) - 1)
    ranked = ranked.join(per_stripe.select("src", "stripe", "ahead"), ["src", "stripe"]).select("src", "id", (F.col("r") + F.col("ahead")).alias("rank"))
    # A slot reads stream words [rank * block, (rank + 1) * block) of the source, the last one to its
    # target, modulo the size of the source: one or more pieces inside blocks of the stream.
    g = goal.select("src", "source_size", "target")
    own = g.join(per_stripe.groupBy("src").agg(F.sum("count").alias("slots")), "src", "left")
    late = own.where("slots is null").select("src", F.pmod(F.xxhash64("src"), F.lit(max(1, -(-total // block)))).alias("id"), F.lit(0).cast("long").alias("rank"))
    piece = ranked.unionByName(late).join(own, "src").where("source_size > 0")
    begin, goal_words = F.col("rank") * block, F.round("target").cast("long")
    end = F.when(F.col("rank") + 1 == F.coalesce("slots", F.lit(1)), goal_words).otherwise(F.least(begin + block, goal_words))
    piece = piece.select("src", "id", "source_size", begin.alias("a"), end.alias("b")).where("a < b")
    lap = F.explode(F.sequence(F.expr("a div source_size"), F.expr("(b - 1) div source_size"))).alias("lap")
    piece = piece.select("src", "id", "source_size", "a", "b", lap)
    piece = piece.select("src", "id", F.greatest(F.col("a") - F.col("lap") * F.col("source_size"), F.lit(0)).alias("a"), F.least(F.col("b") - F.col("lap") * F.col("source_size"), F.col("source_size")).alias("b"))
    piece = piece.select("src", "id", "a", "b", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))).alias("block"))
    piece = piece.select("src", "block", "id", F.greatest("a", F.col("block") * block).alias("a"), F.least("b", (F.col("block") + 1) * block).alias("b"))
    # A block is read by few slots (the cap, and twice that where laps don't meet blocks).
    reads = piece.groupBy("src", "block").agg(F.collect_list(F.struct("a", "b", "id")).alias("reads"))
    spans = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"greatest(at, at + size - 1) div {block}"))))
    spans = spans.join(reads, ["src", "block"], "left")
    overlap = F.expr("aggregate(coalesce(reads, array()), 0L, (s, r) -> s + greatest(0L, least(r.b, at + size) - greatest(r.a, at)))")
    slot = F.expr("array_min(transform(filter(coalesce(reads, array()), r -> least(r.b, at + size) > greatest(r.a, at)), r -> r.id))")
    spans = spans.select("key", "source", "src", "size", "at", overlap.alias("taken"), slot.alias("slot"), "block")
    # Rows of one document differ in block only; (src, at, size, key) names a document, and empty
    # repeated rows are told apart by a number.
    whole = spans.withColumn("n", F.when(F.col("size") == 0, F.monotonically_increasing_id()))
    taken = whole.groupBy("key", "source", "src", "size", "at", "n").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    out = taken.join(g, "src")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "first_slot")


def op6_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
