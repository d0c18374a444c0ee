"""Synthetic blobs with two modalities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.norms import with_norms
from ..modality import CLASS, ID, Modality, MultiFrame


def blobs(spark: SparkSession, n: int, centres: int, dims: tuple[int, int] = (30, 20), seed: int = 0) -> MultiFrame:
    """``n`` rows about random centres in the unit cube, of unequal number and width, generated on the executors from hashes of ``_id``."""
    r = np.random.default_rng(seed)
    share = np.cumsum(r.random(centres) + 0.2)
    share = (share / share[-1]).tolist()
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)
    normal = lambda k: F.sqrt(-2 * F.log(uniform(2 * k + 1))) * F.cos(2 * np.pi * uniform(2 * k + 2))
    u = uniform(0)
    cls = sum(((u > s).cast("int") for s in share[:-1]), F.lit(0))
    df = spark.range(n).select("id", F.col("id").alias(ID), cls.alias(CLASS))
    modalities = []
    for m, (name, dim, metric, weight) in enumerate((("m1", dims[0], "manhattan", 0.4), ("m2", dims[1], "euclidean", 0.6))):
        at, width = r.random((centres, dim)), 0.001 + 0.05 * r.random(centres)
        pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(CLASS) + 1)
        df = df.withColumn(name, F.array(*(pick(at[:, i]) + pick(width) * normal(m * 1000 + i) for i in range(dim))))
        modalities.append(Modality(name, dim, metric, weight))
    df = df.drop("id").persist()
    return MultiFrame(df, tuple(with_norms(df, modalities)), n)
