"""A corpus pipeline over `documents`: known languages, no exact and near copies, sources mixed to
their weights, tokens. Each stage is written as Parquet and read back as the next one's input.

In all stages a null text counts as empty, texts are read whole whatever their length, further columns
keep their names and values whatever they are called, rows with a null doc_id take part, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, exact_dedup, language_id, mixing, simhash_dedup
from lodestone.llm.common import discard, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (so null and empty ones) and those of no language with any certainty.
    Repeated rows are judged alike; a null lang isn't learned from; without any lang all documents go."""
    return language_id.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest doc_id stays. Of repeated rows one
    stays; of several texts of that doc_id the one with the smallest hash; one with a null doc_id only
    where no other is equal."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints link the row with the smallest doc_id stays. Of repeated rows
    and of several texts of that doc_id one stays; texts without words have one fingerprint and so form a group."""
    return simhash_dedup.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, three at most. A null source is a source; documents without
    words stay once; repeated rows are taken alike; equal fractions are told apart by a hash of doc_id."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, repeated ones too."""
    return bpe.encode(docs, with_ids=False, with_digests=True)


STAGES = [
    ("language", known_language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("mix", source_mix),
    ("tokens", tokens),
]

#: Languages, near copies and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
