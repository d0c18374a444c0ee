"""Files in and out: delimited text, Parquet, paths and bytes, pandas, aligned frames, and named data sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..modality import MultiFrame
from ..session import numbered


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    """Without ``header`` columns are ``_c0``, ``_c1``...; without ``schema`` types are inferred by another pass over the file."""
    r = spark.read.options(sep=sep, header=header)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def from_rows(spark: SparkSession, rows: list, names: list[str] | str) -> DataFrame:
    return spark.createDataFrame(rows, names)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(pdf)


def save(frame: MultiFrame, path: str) -> None:
    """The frame as Parquet, its modalities as one JSON text beside it."""
    frame.df.write.mode("overwrite").parquet(f"{path}/rows")
    frame.df.sparkSession.createDataFrame([(json.dumps(frame.modal_dict),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/modalities")


def load(spark: SparkSession, path: str) -> MultiFrame:
    return MultiFrame.restore(spark.read.parquet(f"{path}/rows"), json.loads(spark.read.text(f"{path}/modalities").first().value))


def list_files(spark: SparkSession, path: str, pattern: str = "*", name: str = "img_path") -> DataFrame:
    """Paths below a folder; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(F.col("path").alias(name))


def read_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, content)`` of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Two frames side by side, row by row in the given orders; rows without a partner go."""
    return numbered(left, left_order, "__row").join(numbered(right, right_order, "__row"), "__row").drop("__row")


def clean(df: DataFrame, trims: list[str] = (), ints: list[str] = (), splits: dict[str, tuple[str, str, int]] | None = None, joins: dict[str, list] | None = None, holding: dict[str, str] | None = None, renames: dict[str, str] | None = None) -> DataFrame:
    """The usual tidying before modalities are joined, in this order.

    ``trims`` lose blanks at their ends; ``ints`` become whole numbers, null where they are none; ``splits`` gives new columns from
    ``(column, separator, number of the part)``, null beyond the last, and ``joins`` from columns and literals (``F.lit``) put together, null
    if one is; of ``holding`` only rows whose column contains the string stay; ``renames`` come last.
    """
    df = df.withColumns({c: F.trim(c) for c in trims} | {c: F.trim(F.col(c).cast("string")).try_cast("int") for c in ints})
    df = df.withColumns({name: F.get(F.split(F.col(c), f"\\Q{sep}\\E"), part) for name, (c, sep, part) in (splits or {}).items()})
    df = df.withColumns({name: F.concat(*parts) for name, parts in (joins or {}).items()})
    for c, held in (holding or {}).items():
        df = df.where(F.col(c).contains(held))
    return df.withColumnsRenamed(renames or {})


@dataclass(frozen=True)
class Fetcher:
    """A named data set: how to read it, and how to prepare it."""

    name: str
    raw: Callable[[SparkSession], DataFrame]
    prepare: Callable[[DataFrame], MultiFrame]

    def preprocessed(self, spark: SparkSession, cache: str | None = None) -> MultiFrame:
        """Prepared, from ``cache`` if it is there already, which it is from then on."""
        if cache:
            from pyspark.errors import AnalysisException

            try:
                return load(spark, f"{cache}/{self.name}")
            except AnalysisException:
                save(self.prepare(self.raw(spark)), f"{cache}/{self.name}")
                return load(spark, f"{cache}/{self.name}")
        return self.prepare(self.raw(spark))


_FETCHERS: dict[str, Fetcher] = {}


def register(fetcher: Fetcher) -> Fetcher:
    _FETCHERS[fetcher.name] = fetcher
    return fetcher


def by_name(name: str) -> Fetcher:
    if name not in _FETCHERS:
        raise ValueError(f"no data set {name!r}; there are: {', '.join(sorted(_FETCHERS)) or 'none'}")
    return _FETCHERS[name]
