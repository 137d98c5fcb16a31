"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import (
    bpe_count,
    decontaminate,
    exact_dedup,
    fim,
    hard_negatives,
    html_main,
    langid,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    simhash,
)
from riskloom.llm.shared import fold, table

# The fold that is held out of every fit: crc32 of the id as text, modulo 3.
HELD_OUT = 1

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: which document of its text group stays."""
    return exact_dedup.absorb(exact_dedup.fresh_index(spark), table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the byte-level vocabulary."""
    return bpe_count.token_counts(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base spans and what the model adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines, dropped lines and the digest of what is left."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds a benchmark item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _with_fold(found: DataFrame) -> DataFrame:
    return found.withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(False)))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: size of its shingle set and its group of near duplicates."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the words the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold() != HELD_OUT))
    found = _with_fold(langid.predict(docs, model))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold() != HELD_OUT)
    found = _with_fold(quality.score(docs, quality.fit(docs, labels)))
    return found.select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form and of the text restored from it."""
    return fim.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and its group of near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_pii": op3_pii,
        "op4_line_dedup": op4_line_dedup,
        "op5_html_main": op5_html_main,
        "op6_decontaminate": op6_decontaminate,
        "op7_ngram_join": op7_ngram_join,
        "op8_mixing": op8_mixing,
        "op9_langid": op9_langid,
        "op10_quality": op10_quality,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_simhash": op13_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op11_fill_in_middle": fim.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
