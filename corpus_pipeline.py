"""The corpus pipeline: five operators of ``riskloom.llm``, one after the other.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps; its
result is written as Parquet and read back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, langid, line_dedup, mixing, ngram_join
from riskloom.llm.shared import fold, materialize, restrict, table

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose text is near no language: null, without letters, or rejected."""
    return langid.accepted(docs, langid.fit(docs.filter(fold() != 1)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that an earlier document holds already, and the documents that had
    words before and have none left. A text without words stays as it is."""
    had = "had_words"
    while had in docs.columns:
        had = "_" + had
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return line_dedup.line_dedup(docs.withColumn(had, words)).filter(words | ~F.col(had)).drop(had)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of each group of near duplicates: five words a
    shingle, a similarity of 0.8 or more."""
    found = ngram_join.jaccard_join(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    return restrict(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
]

# Language ID and decontamination cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
