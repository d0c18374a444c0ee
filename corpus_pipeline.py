"""A corpus from raw documents to token ids: quality rules, near copies, repeated passages, mixture, encoding.

Defined cases: null, empty and blank texts go with the quality rules; rows that repeat ``doc_id`` and text leave one; a null
``doc_id`` takes part and comes out null; a null language goes by script and a null source is one of its own; the longest texts
go through whole; an empty table gives no rows; other columns pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaica.llm import bpe, fertility, mixing, simhash, suffix
from mosaica.llm.common import new_path
from mosaica.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tokeniser fertility is outside their language's bands go."""
    ship(spark)
    return fertility.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return simhash.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay only where they first occur."""
    ship(spark)
    return suffix.drop_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the blocks that the sources' quotas take stay."""
    ship(spark)
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, round_trip)`` of every document."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("repeated passages", repeats), ("mixture", mixture), ("encoding", encoding)]
#: SQL has no such tokenisers, fingerprints and suffixes; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
