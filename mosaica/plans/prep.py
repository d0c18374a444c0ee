"""From a raw frame to a prepared one.

A :class:`Builder` is told which columns make which modality; ``create`` drops rows with nulls in those, numbers the
rows, codes the class, turns each modality into one vector column scaled to [-1, 1], works out weights and norms, and
writes the frame to the shared folder. What was fitted stays in ``stages``, so ``Prepared.apply`` treats other rows alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, MinMaxScaler, OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, NumericType, StringType

from ..functions.distances import matrix
from ..functions.encoders import Encoder, encode_column
from ..functions.norms import with_norms
from ..modality import CLASS, ID, METRICS, Modality, MultiFrame
from ..session import cut
from .report import Level, timed, warn

_NAME = re.compile(r"[a-z]\w*", re.ASCII)
NOT_GIVEN = "N/A"
#: PCA keeps the shortest prefix of components that explains this share, of sqrt(2 dim) at most.
EXPLAINED = 0.9


# ---- single stages ------------------------------------------------------------------------------------------------


def code_classes(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_class`` in place of ``column``, numbers by sorted value, and the table ``(value, _class)``."""
    values = [r[0] for r in df.select(column).distinct().where(F.col(column).isNotNull()).orderBy(column).collect()]
    kind = df.schema[column].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"__v {kind}, {CLASS} int")
    return df.join(table, df[column] == table["__v"]).drop("__v", column), table.withColumnRenamed("__v", column)


def used_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the used columns, only rows without nulls in them."""
    return df.select(*columns).dropna()


def add_ids(df: DataFrame) -> DataFrame:
    """Leaves an ``_id`` that is there; else numbers that grow but have gaps."""
    return df if ID in df.columns else df.withColumn(ID, F.monotonically_increasing_id())


def partitioned(df: DataFrame, how: int | str | None) -> DataFrame:
    """``None``: as it is; a number; ``'auto'``: by the number of rows; ``'default'``: the default parallelism."""
    if how is None:
        return df
    if how == "auto":
        n = max(2, df.count())
        how = int(math.sqrt(n) / math.log10(n)) + 1
    elif how == "default":
        how = df.sparkSession.sparkContext.defaultParallelism
    if not isinstance(how, int) or how < 1:
        raise ValueError(f"partitions: {how!r}")
    return df.repartition(how)


def dim_of(df: DataFrame, name: str) -> int:
    """Width of an array column, the same in all rows."""
    r = df.select(F.size(name).alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if r.lo is None or r.lo != r.hi:
        raise ValueError(f"the vectors of {name!r} are {r.lo} to {r.hi} wide")
    return r.lo


@dataclass
class Ranges:
    """Min-max scaling of an array column to [-1, 1]; a constant dimension becomes 0."""

    name: str
    low: list[float]
    high: list[float]

    @staticmethod
    def fit(df: DataFrame, name: str, dim: int) -> Ranges:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi = np.full(dim, np.nan), np.full(dim, np.nan)
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0), dim)
                    lo, hi = np.fmin(lo, np.fmin.reduce(x)), np.fmax(hi, np.fmax.reduce(x))
            yield pa.RecordBatch.from_arrays([pa.array([lo.tobytes()]), pa.array([hi.tobytes()])], names=["lo", "hi"])

        rows = df.select(F.col(name).cast("array<double>").alias(name)).mapInArrow(run, "lo binary, hi binary").collect()
        lo, hi = (np.nan_to_num(f.reduce([np.frombuffer(bytes(r[c])) for r in rows] or [np.zeros(dim)])) for f, c in ((np.fmin, "lo"), (np.fmax, "hi")))
        return Ranges(name, lo.tolist(), hi.tolist())

    def apply(self, df: DataFrame) -> DataFrame:
        parts = [F.lit(0.0) if lo == hi else F.lit(2.0) * (F.col(self.name)[i] - lo) / (hi - lo) - 1 for i, (lo, hi) in enumerate(zip(self.low, self.high))]
        return df.withColumn(self.name, F.array(*parts) if parts else F.col(self.name))


def scale_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scalar columns scaled to [-1, 1] in one pass for the bounds."""
    r = df.agg(*(f(c).alias(f"{t}{c}") for c in columns for t, f in (("lo", F.min), ("hi", F.max)))).first()
    return df.withColumns({c: F.lit(0.0) if r[f"lo{c}"] == r[f"hi{c}"] else F.lit(2.0) * (F.col(c) - r[f"lo{c}"]) / (r[f"hi{c}"] - r[f"lo{c}"]) - 1 for c in columns})


def auto_weights(modalities: Sequence[Modality], weights: dict[str, float | None]) -> list[Modality]:
    """Given weights over their sum, or raw features over theirs; some given and some not is an error."""
    given = [weights.get(m.name) is not None for m in modalities]
    if any(given) and not all(given):
        raise ValueError("give weights for all modalities or for none")
    w = [weights[m.name] if all(given) else m.features for m in modalities]
    return [replace(m, weight=x / sum(w)) for m, x in zip(modalities, w)]


def vector_schema(kind) -> bool:
    from pyspark.mllib.linalg import VectorUDT as OldVectorUDT

    return isinstance(kind, (VectorUDT, OldVectorUDT)) or isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)


def as_array(df: DataFrame, name: str) -> DataFrame:
    """Vectors of either ML library and numeric arrays as ``array<double>``."""
    kind = df.schema[name].dataType
    c = F.col(name).cast("array<double>") if isinstance(kind, ArrayType) else vector_to_array(name)
    return df.withColumn(name, c)


# ---- embeddings of one modality -----------------------------------------------------------------------------------


@dataclass
class VectorStage:
    """A vector column as it is, scaled."""

    name: str
    ranges: Ranges | None = None
    dim: int = 0
    w_dim: int = 0

    def fit(self, df: DataFrame) -> DataFrame:
        df = as_array(df, self.name)
        self.dim = self.w_dim = dim_of(df, self.name)
        self.ranges = Ranges.fit(df, self.name, self.dim)
        return self.ranges.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.ranges.apply(as_array(df, self.name))


@dataclass
class TabularStage:
    """Numbers scaled, then each string column one-hot, by falling frequency; columns in the order of their names."""

    name: str
    features: Sequence[str]
    numeric: list[str] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    encoder: Transformer | None = None
    dim: int = 0
    w_dim: int = 0

    def fit(self, df: DataFrame) -> DataFrame:
        kinds = {f: df.schema[f].dataType for f in sorted(self.features)}
        self.numeric = [f for f, k in kinds.items() if isinstance(k, NumericType)]
        self.strings = [f for f, k in kinds.items() if isinstance(k, StringType)]
        if self.numeric:
            r = df.agg(*(f(F.col(c).cast("double")).alias(f"{t}{c}") for c in self.numeric for t, f in (("lo", F.min), ("hi", F.max)))).first()
            self.bounds = {c: (r[f"lo{c}"] or 0.0, r[f"hi{c}"] or 0.0) for c in self.numeric}
        if self.strings:
            filled = self._filled(df)
            index = StringIndexer(inputCols=self.strings, outputCols=[f"__i_{c}" for c in self.strings], handleInvalid="keep").fit(filled)
            hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"__h_{c}" for c in self.strings], dropLast=False, handleInvalid="error").fit(index.transform(filled))
            self.encoder = PipelineModel([index, hot])
            self.sizes = [len(x) for x in index.labelsArray]
        else:
            self.sizes = []
        self.dim, self.w_dim = len(self.numeric) + sum(self.sizes), len(self.features)
        return self.apply(df)

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(c) == "", NOT_GIVEN).otherwise(F.col(c)) for c in self.strings})

    def apply(self, df: DataFrame) -> DataFrame:
        """A category that was not there when fitted has no place: all of its column's are 0."""
        parts = [F.array(*(F.lit(0.0) if lo == hi else F.lit(2.0) * (F.col(c).cast("double") - lo) / (hi - lo) - 1 for c, (lo, hi) in self.bounds.items()))] if self.numeric else []
        if self.strings:
            df = self.encoder.transform(self._filled(df))
            parts += [F.slice(vector_to_array(f"__h_{c}"), 1, n) for c, n in zip(self.strings, self.sizes)]
        extra = [f"{t}{c}" for c in self.strings for t in ("__i_", "__h_")]
        return df.withColumn(self.name, F.concat(*parts)).drop(*extra, *(f for f in self.features if f != self.name))


@dataclass
class DeepStage:
    """Texts or image paths through an encoder, scaled; with ``reduce_dim`` then PCA, scaled again."""

    name: str
    encoder: Encoder
    reduce_dim: bool = True
    batch_size: int = 32
    first: Ranges | None = None
    pca: Any = None
    second: Ranges | None = None
    keep: int = 0
    dim: int = 0
    w_dim: int = 0

    def _encoded(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, encode_column(self.encoder, self.name, self.batch_size))

    def fit(self, df: DataFrame) -> DataFrame:
        df = cut(self._encoded(df), "encoded")  # the encoder runs once
        self.dim = dim_of(df, self.name)
        self.first = Ranges.fit(df, self.name, self.dim)
        df = self.first.apply(df)
        if self.reduce_dim:
            k = max(1, min(self.dim, int(math.sqrt(2 * self.dim))))
            self.pca = PCA(k=k, inputCol="__v", outputCol="__p").fit(df.withColumn("__v", array_to_vector(self.name)))
            share, self.keep = 0.0, k
            for i, v in enumerate(self.pca.explainedVariance.toArray().tolist()):
                share += v
                if share >= EXPLAINED:
                    self.keep = i + 1
                    break
            df = self._reduced(df)
            self.dim = self.keep
            self.second = Ranges.fit(df, self.name, self.dim)
            df = self.second.apply(df)
            if share < EXPLAINED:
                warn(f"{self.name}: {self.keep} components explain only {share:.3f} of the variance", shares=self.pca.explainedVariance.toArray().round(4).tolist())
        self.w_dim = self.dim
        return df

    def _reduced(self, df: DataFrame) -> DataFrame:
        out = self.pca.transform(df.withColumn("__v", array_to_vector(self.name)))
        return out.withColumn(self.name, F.slice(vector_to_array("__p"), 1, self.keep)).drop("__v", "__p")

    def apply(self, df: DataFrame) -> DataFrame:
        df = self.first.apply(self._encoded(df))
        return self.second.apply(self._reduced(df)) if self.reduce_dim else df


# ---- builder ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Prepared(MultiFrame):
    """A prepared frame with the stages that made it."""

    stages: tuple = ()

    def apply(self, df: DataFrame) -> MultiFrame:
        """Other rows through the same stages."""
        columns = {c for s in self.stages for c in (s.features if isinstance(s, TabularStage) else [s.name])}
        df = add_ids(used_rows(df, [*sorted(columns), *(c for c in (ID,) if c in df.columns)]))
        for s in self.stages:
            df = s.apply(df)
        return MultiFrame.of(df.select(ID, *(m.name for m in self.modalities)), list(self.modalities))


class Builder:
    """Declares modalities one by one; ``create`` prepares the frame."""

    def __init__(self, df: DataFrame | pd.DataFrame, class_col: str | None = None, partitions: int | str | None = None):
        if isinstance(df, pd.DataFrame):
            df = SparkSession.builder.getOrCreate().createDataFrame(df)
        if not isinstance(df, DataFrame):
            raise ValueError("expected a Spark or pandas frame")
        self.df, self.class_col, self.partitions = df, class_col, partitions
        self.kinds = {f.name: f.dataType for f in df.schema.fields}
        self.stages: dict[str, Any] = {}
        self.metrics: dict[str, str] = {}
        self.weights: dict[str, float | None] = {}
        self.used: set[str] = set()
        if class_col is not None:
            self._typed(class_col, (IntegralType, StringType))

    def _typed(self, column: str, kinds: tuple) -> None:
        if column not in self.kinds:
            raise ValueError(f"there is no column {column!r}")
        if not isinstance(self.kinds[column], kinds):
            raise ValueError(f"column {column!r} is {self.kinds[column].simpleString()}")

    def _add(self, stage, metric: str, weight: float | None, columns: set[str]) -> Builder:
        if not _NAME.fullmatch(stage.name):
            raise ValueError(f"{stage.name!r} is no name of a modality")
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        if stage.name in self.stages or columns & self.used:
            raise ValueError(f"{stage.name!r} or one of its columns is used already")
        if weight is not None and weight <= 0:
            raise ValueError("a weight must be positive")
        if self.weights and (weight is None) != (None in self.weights.values()):
            raise ValueError("give weights for all modalities or for none")
        self.stages[stage.name], self.metrics[stage.name], self.weights[stage.name] = stage, metric, weight
        self.used |= columns
        return self

    def vector(self, name: str, distance: str = "euclidean", weight: float | None = None) -> Builder:
        if name not in self.kinds or not vector_schema(self.kinds[name]):
            raise ValueError(f"{name!r} is no vector column")
        return self._add(VectorStage(name), distance, weight, {name})

    def tabular(self, name: str, features: Sequence[str], distance: str = "euclidean", weight: float | None = None) -> Builder:
        for f in features:
            self._typed(f, (NumericType, StringType))
        return self._add(TabularStage(name, sorted(features)), distance, weight, set(features))

    def text(self, name: str, model: Encoder, distance: str = "euclidean", reduce_dim: bool = True, batch_size: int = 32, weight: float | None = None) -> Builder:
        self._typed(name, (StringType,))
        return self._add(DeepStage(name, model, reduce_dim, batch_size), distance, weight, {name})

    def image(self, name: str, model: Encoder, root_path: str = "", distance: str = "euclidean", reduce_dim: bool = True, batch_size: int = 32, weight: float | None = None) -> Builder:
        """``name`` has paths relative to ``root_path``; the encoder gets the files' bytes."""
        from ..functions.encoders import FileEncoder

        self._typed(name, (StringType,))
        return self._add(DeepStage(name, FileEncoder(model, root_path), reduce_dim, batch_size), distance, weight, {name})

    def create(self) -> Prepared:
        if not self.stages:
            raise ValueError("no modalities")
        with timed("preparation"):
            return self._created()

    def _created(self) -> Prepared:
        columns = sorted(self.used) + [c for c in (self.class_col, ID) if c and c in self.kinds and c not in self.used]
        df = used_rows(self.df, columns)
        if self.class_col:
            if self.class_col in self.used:
                df = df.withColumn("__class", F.col(self.class_col))
            df, _ = code_classes(df, "__class" if self.class_col in self.used else self.class_col)
        df = cut(partitioned(add_ids(df), self.partitions), "rows")
        ms = []
        for name in sorted(self.stages):
            s = self.stages[name]
            with timed(f"stage {name}", Level.FULL, Level.INFO, kind=type(s).__name__) as found:
                df = s.fit(df)
                found["dim"] = s.dim
            ms.append(Modality(name, s.dim, self.metrics[name], w_dim=s.w_dim))
        df = cut(df.select(ID, *([CLASS] if self.class_col else []), *(m.name for m in ms)), "prepared")
        ms = with_norms(df, auto_weights(ms, self.weights))
        return Prepared(df, tuple(ms), df.count(), tuple(self.stages[m.name] for m in ms))
