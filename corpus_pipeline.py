"""A corpus from raw documents to token ids, in five stages.

Each stage takes all that the one before has kept, written as Parquet and read
again, so a lost executor or a restart costs one stage at most. In every stage null texts count as empty, rows
may share an id or have none, further columns stay as they are up to the last stage, and an
empty table gives an empty one. Texts are read whole, however long. Of equal or similar texts the smallest id stays; rows that repeat both id
and text are one document to the deduplication, of which one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from unblend.llm import bpe, digest_tree, minmax, mixing, weak
from unblend.llm.shared import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return weak.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return digest_tree.keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the one with the smallest id stays."""
    return minmax.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is as many rows as the mix takes it."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, their number, and whether they decode to the text's own bytes."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), path, pattern, exact_col="exact")
    return coded.selectExpr("doc_id", "lang", "source", "cast(size(ids) as long) as n_tokens", "ids", "exact")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: Models, hash orders and merges aren't SQL; tests hold every stage, and run(), against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
