"""Fits the recommender of a measure to generated data sets: ``python -m mosaica.plans.train_recommender [data sets] [seed]``.

Each data set has known classes: normal, stretched or uniform clusters, rings or a mixture, with more or less overlap and noise. It is
clustered in many ways; each measure picks the clustering that it rates best, and the measure whose pick agrees best with
the classes, by the adjusted Rand index, is the data set's label. Data sets on which all measures pick alike teach nothing and
are left out. The forest is fitted by Spark ML, and written as nodes to ``recommender.json`` beside this file.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np

from ..functions.distances import nearest, pairwise
from ..modality import Modality
from ..operators.hierarchical import Bunch, agglomerate
from ..operators.kmeans import local_kmeans
from ..operators.metafeatures import NAMES
from .recommend import FILE, MEASURES


def data_set(r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows and classes."""
    n, k, dim = int(r.integers(90, 220)), int(r.integers(2, 8)), int(r.choice([2, 2, 3, 5, 10, 20]))
    share = r.dirichlet(np.full(k, r.choice([0.8, 3.0, 30.0])))
    y = np.sort(r.choice(k, n, p=share))
    at, width = r.random((k, dim)), r.choice([0.02, 0.05, 0.1, 0.2, 0.35]) * (0.4 + r.random(k)) * np.sqrt(dim / 2)
    kind = r.choice(["normal", "stretched", "uniform", "ring", "mixed"])
    kinds = r.choice(["normal", "stretched", "uniform"], k) if kind == "mixed" else [kind] * k
    x = np.empty((n, dim))
    for c in range(k):
        m, z = int((y == c).sum()), r.standard_normal((int((y == c).sum()), dim))
        if kinds[c] == "uniform":
            z = r.random((m, dim)) * 3.4 - 1.7
        elif kinds[c] == "ring":
            z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9) * (1.5 + 0.2 * r.standard_normal((m, 1)))
        elif kinds[c] == "stretched":
            z = z * r.choice([0.3, 1.0, 2.5], dim)
        x[y == c] = at[c] + width[c] * z / np.sqrt(dim / 2)
    noise = r.random(n) < r.choice([0, 0, 0.03, 0.1])
    x[noise] = r.random((int(noise.sum()), dim)) * 1.4 - 0.2
    return x, y


def features(x: np.ndarray) -> list[float]:
    """The meta-features of :func:`mosaica.operators.metafeatures.meta_features`, of rows under one Euclidean modality."""
    one = [Modality("x", x.shape[1])]
    every = pairwise(one, x, x)
    at, norm, pair = 0, 0.0, None
    for _ in range(5):
        far = int(every[at].argmax())
        back = int(every[far].argmax())
        norm = max(norm, every[at, far], every[far, back])
        if pair == {far, back}:
            break
        pair, at = {far, back}, back
    d = every[np.triu_indices(len(x), 1)] / (norm or 1.0)
    mean, c = d.mean(), d - d.mean()
    var = (c**2).mean()
    std = np.sqrt(var)
    at = np.minimum(np.searchsorted(np.arange(11) * 0.1, d, "right") - 1, 9)
    shares = np.bincount(at[d <= 10 * 0.1], minlength=10) / len(d)
    z = np.bincount(np.minimum((c / std)[c >= 0].astype(int), 3), minlength=4) / len(d) if std else np.array([1.0, 0, 0, 0])
    return [mean, var, std, (c**3).mean() / std**3 if std else 0.0, (c**4).mean() / std**4 - 3 if std else 0.0, *shares.tolist(), *z.tolist()]


def rated(x: np.ndarray, labels: np.ndarray) -> list[float]:
    """The four measures, in the order of :data:`MEASURES`; more is better."""
    ls, own = np.unique(labels, return_inverse=True)
    n, k = len(x), len(ls)
    c = np.array([x[own == i].mean(0) for i in range(k)])
    size = np.bincount(own)
    to = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    a = to[np.arange(n), own]
    between = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(between, np.inf)
    tiny = 1e-12
    ch = (n - k) / (k - 1) * (size * np.linalg.norm(c - x.mean(0), axis=1)).sum() / max(a.sum(), tiny)
    to[np.arange(n), own] = np.inf
    b = to.min(1)
    sil = ((b - a) / np.maximum(np.maximum(a, b), tiny)).mean()
    last = sum(np.sort(a[own == i])[int(np.floor(0.9 * size[i])) :].sum() for i in range(k))
    far = [x[own == i][a[own == i].argmax()] for i in range(k)]
    wide = max(np.linalg.norm(x[own == i] - far[i], axis=1).max() for i in range(k))
    return [ch, sil, between.min(1).sum() / max(last, tiny), between.min() / max(wide, tiny)]


def adjusted_rand(y: np.ndarray, labels: np.ndarray) -> float:
    cells = np.unique(np.stack([y, labels]), axis=1, return_counts=True)[1].astype(float)
    a, b = (np.unique(v, return_counts=True)[1].astype(float) for v in (y, labels))
    two = lambda v: (v * (v - 1) / 2).sum()
    expected = two(a) * two(b) / (len(y) * (len(y) - 1) / 2)
    most = (two(a) + two(b)) / 2
    return float((two(cells) - expected) / (most - expected)) if most != expected else 1.0


def clusterings(x: np.ndarray, seed: int) -> list[np.ndarray]:
    one, out = [Modality("x", x.shape[1])], []
    for k in range(2, 10):
        out.append(nearest(one, x, local_kmeans(x, np.ones(len(x)), k, 15, one, seed, starts=1))[0])
        for most, shrink in ((1, 0.5), (6, 0.3)):
            got = agglomerate([Bunch(v[None], v[None], v, 1) for v in x], k, most, shrink, one)
            reps, of = np.concatenate([b.reps for b in got]), np.repeat(np.arange(len(got)), [len(b.reps) for b in got])
            out.append(of[nearest(one, x, reps)[0]])
    return [v for v in out if len(np.unique(v)) > 1]


def example(r: np.random.Generator) -> tuple[list[float], list[float]]:
    """Meta-features, and the adjusted Rand index of each measure's pick."""
    x, y = data_set(r)
    tries = clusterings(x, int(r.integers(1 << 30)))
    rates = np.nan_to_num(np.array([rated(x, v) for v in tries]), nan=-np.inf)
    agree = np.array([adjusted_rand(y, v) for v in tries])
    return features(x), [float(agree[i]) for i in rates.argmax(0)]


def exported(forest, labels: list[str]) -> list[list]:
    """A Spark ML forest as lists of ``[feature, threshold, left, right]`` and, for leaves, shares of the labels."""
    trees = []
    for tree in forest.trees:
        nodes: list = []

        def walk(node) -> int:
            at = len(nodes)
            nodes.append(None)
            if "Leaf" in node.getClass().getSimpleName():
                stats = np.array(list(node.impurityStats().stats()))
                nodes[at] = [round(float(v), 4) for v in stats / max(stats.sum(), 1e-12)]
            else:
                s = node.split()
                nodes[at] = [int(s.featureIndex()), round(float(s.threshold()), 6), walk(node.leftChild()), walk(node.rightChild())]
            return at

        walk(tree._java_obj.rootNode())
        trees.append(nodes)
    return trees


def main(sets: int = 900, seed: int = 11) -> None:
    from pyspark.sql import SparkSession

    from .recommend import train

    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    made = spark.sparkContext.parallelize(range(sets), min(sets, 64)).map(lambda k: example(np.random.default_rng([seed, k]))).collect()
    rows = [(*map(float, f), MEASURES[int(np.argmax(a))].name) for f, a in made if max(a) - min(a) > 0.01]
    table = spark.createDataFrame(rows, [*NAMES, "measure"]).cache()
    model = train(table, seed=seed)
    best = model.stages[2]
    labels = list(model.stages[1].labels)
    about = {"measures": labels, "data_sets": len(rows), "seed": seed, "cross_validated": round(max(best.avgMetrics), 4), "trees": exported(best.bestModel, labels)}
    Path(FILE).write_text(json.dumps(about, separators=(",", ":")))
    print({k: v for k, v in about.items() if k != "trees"}, len(about["trees"]), "trees")
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
