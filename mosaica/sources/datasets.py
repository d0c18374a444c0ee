"""The tables of a folder as named data sets, raw or prepared: ``register_tables(folder)``, then ``files.by_name("customers")``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.encoders import HashingEncoder
from ..modality import MultiFrame
from ..plans.prep import Builder
from .blobs import blobs
from .files import Fetcher, register


def _customers(df: DataFrame) -> MultiFrame:
    return Builder(df, class_col="c_mktsegment").tabular("account", ["c_acctbal"]).tabular("place", ["c_nationkey"]).create()


def _parts(df: DataFrame) -> MultiFrame:
    return Builder(df, class_col="p_brand").tabular("kind", ["p_type", "p_size"]).tabular("price", ["p_retailprice"]).text("p_name", HashingEncoder(32), distance="cosine").create()


def _lines(df: DataFrame) -> MultiFrame:
    return Builder(df, class_col="l_linestatus").tabular("amounts", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], distance="manhattan").tabular("flag", ["l_returnflag"]).create()


def _embeddings(df: DataFrame) -> MultiFrame:
    return Builder(df, class_col="label").vector("embedding").create()


def _documents(df: DataFrame) -> MultiFrame:
    return Builder(df, class_col="lang").text("text", HashingEncoder(64), distance="cosine").tabular("length", ["n_chars"]).create()


TABLES: dict[str, tuple[str, Callable[[DataFrame], MultiFrame]]] = {"customers": ("customer", _customers), "parts": ("part", _parts), "lines": ("lineitem", _lines), "embeddings": ("embeddings", _embeddings), "documents": ("documents", _documents)}


def register_tables(folder: str) -> list[str]:
    """Registers a data set for each table of ``folder``, and ``blobs``; gives their names."""

    def reader(table: str) -> Callable[[SparkSession], DataFrame]:
        return lambda spark: spark.read.parquet(f"{folder}/{table}.parquet")

    for name, (table, prepare) in TABLES.items():
        register(Fetcher(name, reader(table), prepare))
    made: dict[int, MultiFrame] = {}

    def raw(spark: SparkSession) -> DataFrame:
        made[0] = blobs(spark, 10_000, 5)
        return made[0].df

    register(Fetcher("blobs", raw, lambda df: made[0].like(df)))
    return [*TABLES, "blobs"]
