"""Which internal measure to optimise, from a data set's meta-features.

The recommender is a random forest over the nineteen meta-features. The one in ``recommender.json`` was fitted by
:mod:`mosaica.plans.train_recommender` to generated data sets of known classes, on each of which the best measure is that whose
optimum agrees best with the classes. :func:`train` fits another one to any table of meta-features and names of measures,
and cross-validates its size.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from ..modality import MultiFrame
from ..operators.internal import Internal
from ..operators.metafeatures import NAMES, meta_features
from .report import timed

FILE = str(Path(__file__).with_name("recommender.json"))
MEASURES = (Internal.CALINSKI_HARABASZ, Internal.SILHOUETTE_APPROX, Internal.SF, Internal.GD41_APPROX)


def train(table: DataFrame, label: str = "measure", folds: int = 4, seed: int = 0) -> PipelineModel:
    """Fits to a table of :data:`NAMES` and ``label``."""
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(table)
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, [20, 60]).addGrid(forest.maxDepth, [3, 6]).build()
    best = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="__y", metricName="weightedRecall"), numFolds=folds, seed=seed)
    stages = [VectorAssembler(inputCols=NAMES, outputCol="__x"), index, best, IndexToString(inputCol="prediction", outputCol="recommended", labels=index.labels)]
    return Pipeline(stages=stages).fit(table)


class Forest:
    """Trees of ``[feature, threshold, left, right]`` nodes and leaves of shares; the label with most of them wins, of equal ones the first."""

    def __init__(self, labels: list[str], trees: list[list]):
        self.labels, self.trees = labels, trees

    def shares(self, features: list[float]) -> np.ndarray:
        total = np.zeros(len(self.labels))
        for nodes in self.trees:
            at = nodes[0]
            while len(at) == 4 and isinstance(at[0], int):
                at = nodes[at[2] if features[at[0]] <= at[1] else at[3]]
            total += at
        return total / len(self.trees)

    def predict(self, features: list[float]) -> str:
        return self.labels[int(self.shares(features).argmax())]


@lru_cache(1)
def forest() -> Forest:
    """The forest that comes with the package."""
    about = json.loads(Path(FILE).read_text())
    return Forest(about["measures"], about["trees"])


def recommend(frame: MultiFrame, model: PipelineModel | None = None) -> Internal:
    """The measure for a frame, by the package's forest or a pipeline of :func:`train`."""
    with timed("recommendation of a measure") as found:
        f = meta_features(frame)
        found["meta_features"] = dict(zip(NAMES, f))
        if model is None:
            name = forest().predict(f)
        else:
            row = frame.df.sparkSession.createDataFrame([tuple(map(float, f))], NAMES)
            stages = [s for s in model.stages if not type(s).__name__.startswith("StringIndexer")]
            name = PipelineModel(stages).transform(row).first().recommended
        found["result"] = name
    return Internal[name]
