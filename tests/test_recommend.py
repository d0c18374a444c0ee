"""The recommender's training data against the library's own measures, and the forest that comes with the package on new data sets."""

import numpy as np
import pytest

from mosaica.functions.norms import with_norms
from mosaica.modality import ID, LABEL, Modality, MultiFrame
from mosaica.operators.internal import Internal
from mosaica.operators.metafeatures import meta_features
from mosaica.plans import train_recommender as tr
from mosaica.plans.recommend import MEASURES, Forest, forest, recommend


def framed(spark, x, labels=None):
    rows = [(i, 0 if labels is None else int(labels[i]), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, f"{ID} long, {LABEL} int, x array<double>")
    return MultiFrame(df, tuple(with_norms(df, [Modality("x", x.shape[1])])), len(x))


@pytest.mark.parametrize("seed", [1, 2])
def test_training_agrees_with_the_library(spark, seed):
    x, y = tr.data_set(np.random.default_rng(seed))
    f = framed(spark, x, y)
    assert tr.features(x) == pytest.approx(list(meta_features(f)), rel=1e-6, abs=1e-9)
    own = dict(zip(MEASURES, tr.rated(x, y)))
    for m in (Internal.SILHOUETTE_APPROX, Internal.SF, Internal.GD41_APPROX, Internal.CALINSKI_HARABASZ):
        theirs = m.evaluate(f, minimise=False)
        assert own[m] == pytest.approx(theirs, rel=1e-6), m


def test_adjusted_rand():
    assert tr.adjusted_rand(np.array([0, 0, 1, 1]), np.array([1, 1, 0, 0])) == 1
    assert tr.adjusted_rand(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(-0.5)


def test_forest_on_new_data_sets():
    """What the forest recommends agrees with the classes better than a measure taken at random, and picks the best measure more often."""
    got, mean, right = [], [], 0
    for k in range(60):
        f, agree = tr.example(np.random.default_rng([977, k]))
        if max(agree) - min(agree) > 0.01:
            at = [m.name for m in MEASURES].index(forest().predict(f))
            got.append(agree[at])
            mean.append(np.mean(agree))
            right += agree[at] == max(agree)
    assert len(got) > 20 and np.mean(got) > np.mean(mean) + 0.01 and right / len(got) > 0.45


def test_leaves():
    f = Forest(["a", "b"], [[[0, 0.5, 1, 2], [0.9, 0.1], [0.2, 0.8]], [[0.4, 0.6]]])
    assert f.predict([0.5]) == "a" and f.predict([0.6]) == "b" and f.shares([0.6]) == pytest.approx([0.3, 0.7])


def test_recommend(spark):
    x, _ = tr.data_set(np.random.default_rng(5))
    f = framed(spark, x)
    assert recommend(f) is Internal[forest().predict(list(meta_features(f)))]
