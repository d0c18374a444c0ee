"""Labels a stream of prepared rows with a fitted model. Prediction has no state, so it is a plain map of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import Model, label_with


def score(stream: DataFrame, model: Model) -> DataFrame:
    """The stream with ``_label``."""
    return label_with(stream, model.modalities, model.labels_of)


def score_to_parquet(stream: DataFrame, model: Model, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing the labelled stream, exactly once, as Parquet."""
    return score(stream, model).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)
