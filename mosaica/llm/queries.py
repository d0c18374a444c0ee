"""Queries of the operators over the whole test tables, with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fertility, langid, licenses, mixing, shards, simhash, suffix, topk, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.pages_to_warc(table(spark, sf_dir, "pages"), path)
    return warc.responses(spark, path)


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.accepted(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.spans(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_fertility": op3_fertility,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_licenses": op5_licenses,
    "op6_suffix_array": op6_suffix_array,
    "op7_language_id": op7_language_id,
    "op8_top_k": op8_top_k,
    "op9_simhash": op9_simhash,
    "op10_token_shards": op10_token_shards,
}
SQL: dict[str, str] = {"op1_mixing": mixing.MIXTURE_SQL, "op2_warc": warc.PAGES_SQL, "op5_licenses": licenses.scan_sql(), "op6_suffix_array": suffix.SPANS_SQL, "op8_top_k": topk.TOP_K_SQL}
