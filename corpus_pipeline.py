"""Corpus preparation: language, near duplicates, benchmark leaks, personal data, mixing.

Every stage reads whole texts of any length, takes an empty table to an empty one, keeps columns that
it doesn't know (whatever their names) and returns repeated rows as often as its rule says.  A null or empty text
goes in the first stage; in the others it has no words: it is nobody's near duplicate, holds no
benchmark window and no personal data, and takes no words of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontaminate, langid, minhash, mixing, pii
from barline.llm.common import WRITTEN, materialise, release, ship, table


#: Least probability of the best language.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: without a letter (null texts too), or without a
    language of more than even odds.  The declared ``lang`` is a label to learn from, which may be null
    or wrong, so that a document is not judged by it.  Repeated rows stay or go together."""
    ship(spark)
    held = F.coalesce(langid.held_out("doc_id", 4, 2), F.lit(True))
    model = langid.fit(docs, ~held)
    told = langid.identify(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), model, keep=[f"_{c}" for c in docs.columns], text="_text")
    told = told.where(F.col("lang_pred") != "und")
    if len(model.langs) > 1:
        told = told.where(F.col("score") >= CERTAIN)
    return told.select(*(F.col(f"_{c}").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: 5-word shingles, similarity 0.8.  The least
    doc_id stays, on ties the least hash of the row; null ids come last; repeated rows are copies."""
    ship(spark)
    return minhash.keep_one(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, repeated rows all of them."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in place; no row goes."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, with its place; no row goes, repeated rows are
    documents of their own."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", privacy),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again; what a stage wrote on its way is
    deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        since = len(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
            release(spark, since, docs)
    return docs


#: Language identification and the union-find grouping are beyond SQL.
ORACLE_SQL = None
