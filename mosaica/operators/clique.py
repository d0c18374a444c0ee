"""CLIQUE: dense units of a grid, grown level by level, and their connected groups.

Coordinates are expected in [-1, 1]. The bucket of x among s is ``floor((x s) mod s)``, the sign of x kept, so -1 and 1
fall into bucket 0. A unit of one level is dense if at least ``floor(n threshold)`` rows are in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import blocks, flatten
from ..modality import MultiFrame
from .base import Algorithm, Model, check, kept

Unit = tuple[tuple[int, int], ...]


def bucket_column(x, splits: int):
    """Spark's ``%`` keeps the sign of the dividend, as wanted here."""
    return F.floor((x * splits) % splits).cast("int")


def buckets(x: np.ndarray, splits: int) -> np.ndarray:
    return np.floor(np.fmod(x * splits, splits)).astype(np.int64)


def first_grid(frame: MultiFrame, splits: int, tau: int) -> DataFrame:
    """``(dim, bucket, n)`` of the dense units of one dimension."""
    rows = frame.df.select(F.posexplode(flatten(frame.modalities)).alias("dim", "x"))
    return rows.groupBy("dim", bucket_column(F.col("x"), splits).alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= tau)


def candidates(units: list[Unit], level: int) -> list[Unit]:
    """Joins of two units with ``level`` dimensions whose every face is dense."""
    have, out = set(units), set()
    for i, x in enumerate(units):
        dims = dict(x)
        for y in units[i + 1 :]:
            both = dims | dict(y)  # where the two disagree on a dimension, the later one's bucket stands
            if len(both) == level:
                u = tuple(sorted(both.items()))
                if all(u[:k] + u[k + 1 :] in have for k in range(level)):
                    out.add(u)
    return sorted(out)


def dense(frame: MultiFrame, units: list[Unit], splits: int, tau: int) -> list[Unit]:
    """Those of the candidates that are dense: one pass, partitions send a count each."""
    ms = frame.modalities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(units), np.int64)
        for b in batches:
            k = buckets(blocks(b, ms), splits)
            for i, u in enumerate(units):
                n[i] += np.logical_and.reduce([k[:, d] == v for d, v in u]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(units))), pa.array(n)], names=["i", "n"])

    got = frame.df.select(*(m.name for m in ms)).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= max(tau, 1)).orderBy("i").collect()
    return [units[r.i] for r in got]


def groups(units: list[Unit]) -> list[list[Unit]]:
    """Units of the same dimensions that share a face belong together; numbered by their first unit."""
    left, out = dict.fromkeys(units), []
    while left:
        todo, group = [next(iter(left))], []
        del left[todo[0]]
        while todo:
            u = todo.pop()
            group.append(u)
            for k in range(len(u)):
                for step in (-1, 1):
                    v = u[:k] + ((u[k][0], u[k][1] + step),) + u[k + 1 :]
                    if v in left:
                        del left[v]
                        todo.append(v)
        out.append(sorted(group))
    return out


class CLIQUEModel(Model):
    """The first cluster with a unit that holds the row, else noise."""

    def __init__(self, clusters: list[list[Unit]], splits: int, modalities):
        self.clusters, self.splits, self.modalities = clusters, splits, modalities

    def labels_of(self, x: np.ndarray) -> np.ndarray:
        k, out = buckets(x, self.splits), np.full(len(x), -1)
        for i, units in enumerate(self.clusters):
            for u in units:
                out[(out < 0) & np.logical_and.reduce([k[:, d] == v for d, v in u])] = i
        return out


class CLIQUE(Algorithm):
    def __init__(self, threshold: float, splits: int, levels: int = 2):
        check(threshold=0 <= threshold <= 1, splits=splits >= 1, levels=levels >= 1)
        super().__init__(threshold=threshold, splits=splits, levels=levels)

    def units(self, frame: MultiFrame) -> list[Unit]:
        p = self.params
        tau = int(frame.amount * p["threshold"])
        units: list[Unit] = sorted(((r.dim, r.bucket),) for r in first_grid(frame, p["splits"], tau).collect())
        if not units:
            raise RuntimeError("no dense units of one dimension")
        for level in range(2, p["levels"] + 1):
            units = dense(frame, candidates(units, level), p["splits"], tau)
            if not units:
                raise RuntimeError(f"no dense units of {level} dimensions")
        return units

    def fit(self, frame: MultiFrame) -> CLIQUEModel:
        with kept(frame.df) as df:
            return CLIQUEModel(groups(self.units(frame.like(df))), self.params["splits"], frame.modalities)
