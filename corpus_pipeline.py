"""A corpus pipeline: language ID, exact dedup, near-duplicate removal, secret redaction, packing.

In each stage a row is told by its id and its text, so other texts with its id keep their own verdict.
Rows with a null id are judged by their text alone. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import checkpoint
from tideline.llm.exact_dedup import drop_exact
from tideline.llm.language_id import keep_identified
from tideline.llm.near_duplicates import drop_near
from tideline.llm.packing import pack_sequences, word_encoder
from tideline.llm.secret_scan import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language; null, empty and letterless texts are such."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the largest id (of rows that repeat both, all)."""
    return drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, keeps the smallest id.

    Rows with a null id, and null texts, link with nothing and stay.
    """
    return drop_near(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays, null texts as they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens: one row for each piece. A null text is one token."""
    from public_tokenizers import path

    return pack_sequences(docs, word_encoder(path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packing)]

#: Trained likelihoods and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, with a checkpoint between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else checkpoint(docs), sf_dir)
    return docs
