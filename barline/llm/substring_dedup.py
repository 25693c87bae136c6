"""Suffix-array deduplication of byte strings, on a logarithmic family of indexes.

A level is a sparse suffix array: of all suffixes, those that start at an anchor (see
``repeats``), in the order of their first 16 bytes and, where these are equal, of a fingerprint of
their first ``length`` / 2 bytes, so that suffixes with a common prefix of that length are
neighbours.  A new batch gets its own array, is merge-scanned against the levels for common strings
of ``length`` bytes, and equal-sized levels merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.repeats import Alphabet, remove_repeats


def alphabet(length: int = 200) -> Alphabet:
    return Alphabet("byte", length, max(1, length // 2))


def dedup(docs: DataFrame, *, length: int = 200, key: str = "doc_id", text: str = "text", batches: int = 4) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept): bytes left when every byte of a repeated string of
    ``length`` bytes goes.  Nulls, empty texts and repeated rows: see ``remove_repeats``."""
    out = remove_repeats(docs, alphabet(length), text=text, keep=[key], batches=batches)
    return out.withColumnRenamed("n_units", "n_bytes")


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    found = dedup(docs)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
