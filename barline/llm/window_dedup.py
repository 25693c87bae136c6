"""Substring deduplication by a log-structured index of word-window fingerprints.

Sorted immutable runs hold the fingerprints of the sampled windows of past batches (see
``repeats``); a new batch is merge-joined with them, matches are verified on the texts, and
runs are compacted as they merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.repeats import Alphabet, remove_repeats


def alphabet(length: int = 35) -> Alphabet:
    return Alphabet("word", length, max(1, (length + 1) // 2))


def dedup(docs: DataFrame, *, length: int = 35, key: str = "doc_id", text: str = "text", batches: int = 4) -> DataFrame:
    """(key, n_words, n_removed, spans, kept): words left, joined by blanks, when every word of a
    repeated window of ``length`` words goes.  Edge cases: see ``remove_repeats``."""
    out = remove_repeats(docs, alphabet(length), text=text, keep=[key], batches=batches)
    return out.withColumnRenamed("n_units", "n_words")


def op5_window_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
