"""Benchmark decontamination by a prefix-filtered join.

A benchmark window (``width`` consecutive words of an item, or a whole shorter item) occurs in
a document only if its rarest word does: the overlap must be complete, so the necessary prefix
in rarity order is one token.  Document words that are some window's prefix token give
candidates; length and position bounds prune them; the surviving places are compared word by
word.  Rarity is the count over all documents.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import materialise, row_key

#: The contract's class after lower-casing, as what it holds: digits, a-z, all beyond ASCII.  Java's
#: matcher is several times faster on it than on the negated form.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    low = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, *, width: int = 10, text: str = "text", key: str = "item_id") -> DataFrame:
    """Distinct windows with the items that hold them: (win_id, win, item_ids)."""
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.slice(w, i, width))).otherwise(F.array().cast("array<array<string>>"))

    each = F.element_at(F.transform(F.array(words(F.col(text))), cut), 1)
    win = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("item"), F.explode(each).alias("win"))
    win = win.groupBy("win").agg(F.collect_set("item").alias("items"))
    return win.select(F.sha2(F.concat_ws(" ", "win").cast("binary"), 256).alias("win_id"), "win", "items")


def _count(docs: DataFrame, vocabulary: DataFrame, text: str, small: bool) -> DataFrame:
    tokens = docs.select(F.explode(words(F.col(text))).alias("token"))
    if small:
        return tokens.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token")


def find(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """Benchmark windows in each document: (key, __rk, n_words, hits, items).

    ``hits`` are the places (start, len) of windows in words, ``items`` the sorted ids of the items
    they belong to.  Null and empty texts have no words, items without words no window; repeated rows
    give equal results; null item ids count as the item ``null``; empty tables give no hits.  At most
    ``broadcast_rows`` tokens and windows travel to the documents; more are joined by shuffling.
    """
    win = materialise(windows(benchmark, width=width, text=item_text, key=item_key), "decon-windows")
    vocabulary = win.select(F.explode("win").alias("token")).distinct()
    small = max(vocabulary.count(), win.count()) <= broadcast_rows
    count = materialise(_count(docs, vocabulary, text, small), "decon-counts")
    # The rarest word of each window; a window with a word that no document has cannot occur.
    each = win.select("win_id", F.size("win").alias("len"), F.posexplode("win").alias("off", "token"))
    rank = each.join(F.broadcast(count) if small else count, "token", "left")
    rare = rank.groupBy("win_id", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("r"))
    prefix = materialise(rare.where("r.n > 0").select("win_id", "len", "r.token", "r.off"), "decon-prefix")
    rows = docs.select(F.col(key).alias(key), row_key(key, text).alias("__rk"), F.col(text).alias("__text"))
    own = rows.select("__rk", words(F.col("__text")).alias("w"))
    own = own.select("__rk", F.size("w").alias("n"), F.posexplode("w").alias("pos", "token"))
    found = own.join(F.broadcast(prefix) if small else prefix, "token")
    start = F.col("pos") - F.col("off")
    found = found.where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("__rk", "win_id", start.alias("start"))
    found = found.join(F.broadcast(win) if small else win, "win_id").select("__rk", F.struct("start", "win", "items").alias("c"))
    candidates = found.groupBy("__rk").agg(F.collect_set("c").alias("cands"))
    both = rows.join(candidates, "__rk", "left")

    def check(w: Column) -> Column:
        here = F.filter("cands", lambda c: F.slice(w, c["start"] + 1, F.size(c["win"])) == c["win"])
        return F.struct(F.size(w).alias("n_words"), here.alias("h"))

    # The words are bound to a lambda variable: named as a column the optimizer may write their
    # expression into the filter, and a text would be cut anew for each candidate.
    both = both.select(key, "__rk", F.element_at(F.transform(F.array(words(F.col("__text"))), check), 1).alias("x")).select(key, "__rk", "x.n_words", "x.h")
    hits = F.array_distinct(F.transform("h", lambda c: F.struct(c["start"].alias("start"), F.size(c["win"]).alias("len"))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda c: c["items"]))))
    none = F.array().cast("array<struct<start:int,len:int>>")
    return both.select(key, "__rk", F.col("n_words").cast("long").alias("n_words"), F.coalesce(hits, none).alias("hits"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))


def n_hit(hits: Column) -> Column:
    """Number of words covered by the windows."""
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1))))
    return F.coalesce(F.size(covered), F.lit(0)).cast("long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", max_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the rows whose share of hit words is above ``max_share``."""
    found = find(docs, benchmark, text=text, key=key, **options).where(F.size("hits") > 0)
    bad = found.where(n_hit(F.col("hits")) > max_share * F.col("n_words")).select("__rk").distinct()
    return docs.withColumn("__rk", row_key(key, text)).join(bad, "__rk", "left_anti").select(*docs.columns)


def op2_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
