"""Fifteen internal measures of a labelling.

Noise is dropped. Labels may have gaps. Linear measures take two passes: one for the centroids, one for distances to
them. Those over all pairs of rows go over pairs of tiles and send sums, least and greatest values by pair of labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import blocks, pairwise
from ..functions.tiles import over_pairs, tiles
from ..modality import ID, LABEL, NOISE, MultiFrame

TOP = 0.9


class Internal(Enum):
    """Key and whether more is better."""

    CALINSKI_HARABASZ = ("ch", True)
    DAVIES_BOULDIN = ("db", False)
    DAVIES_BOULDIN_ALTER = ("db*", False)
    DUNN = ("dunn", True)
    GD31 = ("gd31", True)
    GD33 = ("gd33", True)
    GD41 = ("gd41", True)
    GD41_APPROX = ("gd41*", True)
    GD43 = ("gd43", True)
    GD51 = ("gd51", True)
    GD51_APPROX = ("gd51*", True)
    GD53 = ("gd53", True)
    SILHOUETTE = ("sil", True)
    SILHOUETTE_APPROX = ("sil*", True)
    SF = ("sf", True)

    @property
    def key(self) -> str:
        return self.value[0]

    @property
    def increasing(self) -> bool:
        return self.value[1]

    def evaluate(self, frame: MultiFrame, minimise: bool | None = None) -> float:
        """The value; with ``minimise`` given, signed so that less (or more) is better."""
        v = evaluate(self.key, frame)
        return v if minimise is None or minimise != self.increasing else -v


def evaluate(key: str, frame: MultiFrame) -> float:
    if key not in {m.key for m in Internal}:
        raise ValueError(f"unknown measure {key!r}")
    if LABEL not in frame.df.columns:
        raise ValueError(f"the frame has no {LABEL}")
    return Clusters(frame).measure(key)


@dataclass
class Clusters:
    """What the measures of one labelling share; each part is computed when it is first asked for."""

    frame: MultiFrame
    df: DataFrame = field(init=False)

    def __post_init__(self):
        self.ms = self.frame.modalities
        self.df = self.frame.df.where(F.col(LABEL) != NOISE).select(ID, LABEL, *(m.name for m in self.ms))

    # -- parts

    @cached_property
    def centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, sizes and centroids."""
        ms = self.ms

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                x, l = blocks(b, ms), b.column(LABEL).to_numpy()
                for k in np.unique(l).tolist():
                    s = sums.setdefault(k, [0, np.zeros(x.shape[1])])
                    s[0] += int((l == k).sum())
                    s[1] += x[l == k].sum(0)
            for k, (n, s) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["k", "n", "s"])

        part = self.df.mapInArrow(partial, "k int, n long, s array<double>")
        dim = sum(m.dim for m in ms)
        rows = part.groupBy("k").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim))).orderBy("k").collect()
        if len(rows) < 2:
            raise ValueError("a measure needs at least two clusters")
        n = np.array([r.n for r in rows])
        return np.array([r.k for r in rows]), n, np.array([[r[f"s{i}"] for i in range(dim)] for r in rows]) / n[:, None]

    @cached_property
    def own(self) -> DataFrame:
        """``(_id, _label, d, s)``: distance to the own centroid, and the approximate silhouette."""
        ms, (labels, _, c) = self.ms, self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = pairwise(ms, blocks(b, ms), c)
                at, rows = np.searchsorted(labels, b.column(LABEL).to_numpy()), np.arange(b.num_rows)
                a = d[rows, at]
                d[rows, at] = np.inf
                o = d.min(1)
                top = np.maximum(a, o)
                yield pa.RecordBatch.from_arrays([b.column(ID), b.column(LABEL), pa.array(a), pa.array(np.divide(o - a, top, out=np.zeros_like(a), where=top > 0))], names=[ID, LABEL, "d", "s"])

        return self.df.mapInArrow(run, f"{ID} long, {LABEL} int, d double, s double")

    @cached_property
    def spread(self) -> tuple[np.ndarray, float]:
        """Sum of the distances to the own centroid by label, and the mean approximate silhouette."""
        rows = self.own.groupBy(LABEL).agg(F.sum("d").alias("d"), F.sum("s").alias("s")).orderBy(LABEL).collect()
        return np.array([r.d for r in rows]), sum(r.s for r in rows) / self.centres[1].sum()

    @cached_property
    def between(self) -> np.ndarray:
        """Distances of the centroids, infinite from each to itself."""
        d = pairwise(self.ms, self.centres[2], self.centres[2])
        np.fill_diagonal(d, np.inf)
        return d

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By labels (k, l): sum, least and greatest distance of all ordered pairs of rows."""
        ms, labels = self.ms, self.centres[0]
        k = len(labels)

        def run(pairs) -> Iterator[pa.RecordBatch]:
            sums, low, high = np.zeros((k, k)), np.full((k, k), np.inf), np.zeros((k, k))
            for a, b in pairs:
                d = pairwise(ms, a.x, b.x)
                i, j = np.searchsorted(labels, a.labels), np.searchsorted(labels, b.labels)
                x, y = np.argsort(i, kind="stable"), np.argsort(j, kind="stable")
                p, r = np.unique(i[x], return_index=True)
                q, c = np.unique(j[y], return_index=True)
                d = d[x[:, None], y] if len(p) > 1 or len(q) > 1 else d
                for out, f in ((sums, np.add), (low, np.minimum), (high, np.maximum)):
                    part = f.reduceat(f.reduceat(d, r, axis=0), c, axis=1)
                    out[np.ix_(p, q)] = f(out[np.ix_(p, q)], part)
                    if a.tile != b.tile:
                        out[np.ix_(q, p)] = f(out[np.ix_(q, p)], part.T)
            p, q = np.nonzero(low < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), *(pa.array(v[p, q]) for v in (sums, low, high))], names=["p", "q", "sum", "low", "high"])

        got = over_pairs(self.tiles, ms, run, "p long, q long, sum double, low double, high double", once=True)
        out = np.zeros((k, k)), np.full((k, k), np.inf), np.zeros((k, k))
        for r in got.groupBy("p", "q").agg(F.sum("sum").alias("s"), F.min("low").alias("l"), F.max("high").alias("h")).collect():
            out[0][r.p, r.q], out[1][r.p, r.q], out[2][r.p, r.q] = r.s, r.l, r.h
        return out

    @cached_property
    def tiles(self) -> DataFrame:
        return tiles(self.df, self.ms, LABEL)

    @cached_property
    def silhouette(self) -> float:
        ms, (labels, n, _) = self.ms, self.centres
        k = len(labels)

        def sums(pairs) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for a, b in pairs:
                d = pairwise(ms, a.x, b.x)
                for t, o, e in ((a, b, d), (b, a, d.T))[: 1 + (a.tile != b.tile)]:
                    s = e @ (o.labels[:, None] == labels).astype(float)
                    if t.tile in held:
                        held[t.tile][1] += s
                    else:
                        held[t.tile] = [t.labels, s]
            for tile, (l, s) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([l.tobytes()]), pa.array([s.tobytes()])], names=["tile", "labels", "s"])

        def merge(t: pa.Table) -> pa.Table:
            l = np.frombuffer(t.column("labels")[0].as_buffer(), np.int64)
            s = sum(np.frombuffer(x.as_buffer()) for x in t.column("s")).reshape(len(l), k)
            mean, own, rows = s / n, np.searchsorted(labels, l), np.arange(len(l))
            a = mean[rows, own].copy()
            mean[rows, own] = np.inf
            b = mean.min(1)
            top = np.maximum(a, b)
            return pa.table({"v": [float(np.divide(b - a, top, out=np.zeros_like(a), where=top > 0).sum())]})

        return over_pairs(self.tiles, ms, sums, "tile long, labels binary, s binary", once=True).groupBy("tile").applyInArrow(merge, "v double").agg(F.sum("v")).first()[0] / n.sum()

    @cached_property
    def approximate_diameter(self) -> np.ndarray:
        """By label: distance from the row farthest from the centroid to the row farthest from that."""
        ms, (labels, _, start) = self.ms, self.centres

        def farthest(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x, at = blocks(b, ms), np.searchsorted(labels, b.column(LABEL).to_numpy())
                    d = pairwise(ms, x, points)[np.arange(len(x)), at]
                    ids = b.column(ID).to_numpy()
                    for k in np.unique(at).tolist():
                        r = np.flatnonzero(at == k)
                        best = r[np.lexsort((ids[r], -d[r]))[0]]
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d[best]]), pa.array([ids[best]]), pa.array([x[best].tolist()], pa.list_(pa.float64()))], names=["k", "d", "id", "x"])

            got = self.df.mapInArrow(run, "k long, d double, id long, x array<double>").groupBy("k").agg(F.max_by(F.struct("d", "x"), F.struct("d", -F.col("id"))).alias("r")).orderBy("k").collect()
            return np.array([g.r.x for g in got]), np.array([g.r.d for g in got])

        return farthest(farthest(start)[0])[1]

    @cached_property
    def top_spread(self) -> float:
        """Sum over labels of the distances to the centroid from rank ``floor(0.9 n)`` on."""
        at = Window.partitionBy(LABEL).orderBy("d", ID)
        _, n, _ = self.centres
        size = F.count("*").over(Window.partitionBy(LABEL))
        ranked = self.own.select("d", LABEL, (F.row_number().over(at) - 1).alias("r"), size.alias("n"))
        return ranked.where(F.col("r") >= F.floor(F.lit(TOP) * F.col("n"))).agg(F.sum("d")).first()[0]

    # -- measures

    def measure(self, key: str) -> float:
        _, n, c = self.centres
        k, far = len(n), self.between
        if key == "ch":
            all_ = (c * n[:, None]).sum(0) / n.sum()
            up = (n * pairwise(self.ms, c, all_[None, :])[:, 0]).sum()
            return _ratio((n.sum() - k) / (k - 1) * up, self.spread[0].sum())
        if key == "db":
            s = self.spread[0] / n
            with np.errstate(divide="ignore"):
                return float(np.mean(np.max(np.where(np.isinf(far), -np.inf, (s[:, None] + s[None, :]) / far), axis=1)))
        if key == "db*":
            s = self.spread[0] / n
            both = s[:, None] + s[None, :]
            np.fill_diagonal(both, -np.inf)
            return float(np.mean(both.max(1) / far.min(1)))
        if key == "sil":
            return self.silhouette
        if key == "sil*":
            return self.spread[1]
        if key == "sf":
            return _ratio(far.min(1).sum(), self.top_spread)
        delta = {"dunn": "1", "3": "3", "4": "4", "5": "5"}[key if key == "dunn" else key[2]]
        sums, low, high = self.pairs if delta in "13" or key in ("dunn", "gd31", "gd41", "gd51") else (None, None, None)
        if delta == "1":
            near = low.copy()
        elif delta == "3":
            near = 0.5 * sums / (n[:, None] * n[None, :])
        elif delta == "4":
            near = far.copy()
        else:
            near = (self.spread[0][:, None] + self.spread[0][None, :]) / (n[:, None] + n[None, :])
        np.fill_diagonal(near, np.inf)
        if key.endswith("*"):
            wide = self.approximate_diameter
        elif key == "dunn" or key[3] == "1":
            wide = np.diag(high)
        else:
            wide = 2 * self.spread[0] / n
        return _ratio(near.min(), wide.max())


def _ratio(a: float, b: float) -> float:
    return float(a) / float(b) if b else float("nan")
