"""Spectral clustering: every modality's graph gives eigenvectors, whose rows are clustered by k-means.

One solver serves all sizes: block Krylov steps, thickly restarted, with a Rayleigh-Ritz projection of all that is kept. A step is one
product of the graph with a block of vectors, made on the executors: the nearest neighbours' graph lies there as blocks of sparse
rows; similarities are worked out from pairs of tiles in each product and never stored. The driver holds the identifiers and, for
``eigen`` = 8, up to 350 numbers for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distances import DOUBT, nearest, paired, pairwise
from ..functions.tiles import merge, over_pairs, tiles
from ..modality import ID, LABEL, Modality, MultiFrame
from ..session import cut
from .base import Algorithm, LabelledModel, check
from .kmeans import local_kmeans

#: A pair is found when its residual is below this share of the greatest eigenvalue, and below this.
TOLERANCE, RESIDUAL = 3e-10, 1e-7
MOST_STEPS = 300
#: Blocks of vectors that are kept before a restart, and rows of the graph to a block.
KEPT_BLOCKS, GRAPH_ROWS = 10, 1024
Times = Callable[[np.ndarray], np.ndarray]


def nearest_neighbours(df: DataFrame, modalities, k: int) -> DataFrame:
    """``(_id, neighbour, rank, d)``: each row's k nearest others; of equal ones those with the least ``_id``."""

    def best(held: list) -> list:
        """The k nearest of what is held for a tile: rows, neighbours and distances."""
        i, of, d = (np.concatenate(v) for v in zip(*held))
        order = np.lexsort((of, d, i))
        i, of, d = i[order], of[order], d[order]
        first = np.searchsorted(i, i)
        on = np.arange(len(i)) - first < k
        return [(i[on], of[on], d[on])]

    def run(pairs) -> Iterator[pa.RecordBatch]:
        tiles_, most = {}, {}
        for a, b in pairs:
            d = pairwise(modalities, a.x, b.x)
            own = a.ids[:, None] == b.ids[None, :]
            if own.any():
                d[own] = np.inf
            _, held, edge = tiles_.setdefault(a.tile, [a.ids, [], np.full(a.n, np.inf)])
            if b.n > k and np.isinf(edge).any():
                np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1], out=edge)
            i, j = np.nonzero((d <= edge[:, None] * (1 + DOUBT)) & (d < np.inf))
            held.append((i, b.ids[j], paired(modalities, a.x[i], b.x[j])))
            most[a.tile] = most.get(a.tile, 0) + len(i)
            if most[a.tile] > 4 * k * a.n:
                held[:] = best(held)
                most[a.tile] = len(held[0][0])
                n = np.bincount(held[0][0], minlength=a.n)
                last = np.cumsum(n) - 1
                edge[:] = np.where(n == k, held[0][2][np.maximum(last, 0)], edge)
        for ids, held, _ in tiles_.values():
            i, of, d = best(held)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(of), pa.array(d)], names=[ID, "neighbour", "d"])

    near = over_pairs(tiles(df, modalities), modalities, run, f"{ID} long, neighbour long, d double")
    rank = F.row_number().over(Window.partitionBy(ID).orderBy("d", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def affinity(df: DataFrame, modalities, gamma: float) -> DataFrame:
    """``(_id, neighbour, w)`` for all ordered pairs of rows: ``exp(-gamma d^2)``."""

    def run(pairs) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            w = np.exp(-gamma * pairwise(modalities, a.x, b.x) ** 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a.ids, b.n)), pa.array(np.tile(b.ids, a.n)), pa.array(w.ravel())], names=[ID, "neighbour", "w"])

    return over_pairs(tiles(df, modalities), modalities, run, f"{ID} long, neighbour long, w double")


def affinity_sums(df: DataFrame, modalities, gamma: float, x: str, width: int) -> DataFrame:
    """``(_id, k, y)``: of each row the sums of ``exp(-gamma d^2)`` with all rows' numbers in the array ``x``."""
    ms = [*modalities, Modality(x, width, norm=0.0, weight=0.0)]

    def run(pairs) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for a, b in pairs:
            w = np.exp(-gamma * pairwise(ms, a.x, b.x) ** 2)
            for o, y in ((a, w @ b.x[:, -width:]), (b, w.T @ a.x[:, -width:]))[: 1 + (a.tile != b.tile)]:
                merge(sums, o, (np.add, y))
        for i, y in sums.values():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, width)), pa.array(np.tile(np.arange(width), len(i)).astype(np.int32)), pa.array(y.ravel())], names=[ID, "k", "y"])

    return over_pairs(tiles(df, ms), ms, run, f"{ID} long, k int, y double", once=True).groupBy(ID, "k").agg(F.sum("y").alias("y"))


def _fresh(x: np.ndarray, q: np.ndarray, r: np.random.Generator, width: int) -> np.ndarray:
    """Up to ``width`` orthonormal columns orthogonal to ``q`` that span ``x``, made up with random ones."""
    n, out = len(x), np.zeros((len(x), 0))
    for source in (x, r.standard_normal((n, width))):
        more = min(width, n - q.shape[1]) - out.shape[1]
        if more <= 0:
            break
        size = np.linalg.norm(source, axis=0)
        y = source[:, size > 0] / size[size > 0]
        for _ in range(3):
            y -= q @ (q.T @ y)
            y -= out @ (out.T @ y)
        u, w, _ = np.linalg.svd(y, full_matrices=False)
        y = u[:, w > 1e-7][:, :more]
        for _ in range(2):
            y -= q @ (q.T @ y)
            y -= out @ (out.T @ y)
            y /= np.linalg.norm(y, axis=0)
        out = np.concatenate([out, y], axis=1)
    return out


def eigenvectors(times: Times, n: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` eigenvalues of largest absolute value of a symmetric operator, and their vectors ``(n, k)``.

    Blocks are wider than ``k``, so an eigenvalue that occurs several times is found as often, and directions that are used up
    are replaced by random ones. Raises ``RuntimeError`` if the residuals aren't small after :data:`MOST_STEPS` products.
    """
    k = min(k, n)
    width = min(n, max(2 * k, k + 4))
    r = np.random.default_rng(seed)
    q, aq = np.zeros((n, 0)), np.zeros((n, 0))
    x = _fresh(np.zeros((n, 0)), q, r, width)
    for _ in range(MOST_STEPS):
        q, aq = np.concatenate([q, x], axis=1), np.concatenate([aq, times(x)], axis=1)
        h = q.T @ aq
        w, s = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-np.abs(w), kind="stable")[: min(len(w), k + width)]
        w, s = w[order], s[:, order]
        vectors, images = q @ s, aq @ s
        rest = images - vectors * w
        if q.shape[1] == n or (np.linalg.norm(rest[:, :k], axis=0) <= max(min(TOLERANCE * np.abs(w[0]), RESIDUAL), 1e-14 * np.abs(w[0]), 1e-300)).all():
            out = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
            sign = np.sign(out[np.abs(out).argmax(0), np.arange(k)])
            return w[:k], out * np.where(sign == 0, 1, sign)
        if q.shape[1] + width > KEPT_BLOCKS * width + k:
            q, aq = vectors, images
        x = _fresh(rest[:, :width], q, r, width)
        if not x.shape[1]:
            raise RuntimeError("no direction is left")
    raise RuntimeError(f"{k} eigenvectors were not found in {MOST_STEPS} steps")


def sparse_times(entries: DataFrame, ids: np.ndarray) -> Times:
    """Products with the symmetric matrix of ``entries(_id, neighbour, v)``; repeated entries add up. Written once, as blocks of rows."""
    sc = entries.sparkSession.sparkContext
    sent = sc.broadcast(ids)

    def pack(t: pa.Table) -> pa.Table:
        i, j = (np.searchsorted(sent.value, t.column(c).to_numpy()) for c in (ID, "neighbour"))
        order = np.lexsort((j, i))
        return pa.table({"i": [i[order].tobytes()], "j": [j[order].tobytes()], "v": [t.column("v").to_numpy()[order].tobytes()]})

    number = F.floor(F.pmod(F.xxhash64(ID), F.lit(max(1, len(ids) // GRAPH_ROWS))))
    blocks = cut(entries.withColumn("b", number).groupBy("b").applyInArrow(pack, "i binary, j binary, v binary"), "matrix")

    def times(x: np.ndarray) -> np.ndarray:
        held = sc.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    i, j, v = (np.frombuffer(row[c], d) for c, d in (("i", np.int64), ("j", np.int64), ("v", float)))
                    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                    y = np.add.reduceat(held.value[j] * v[:, None], first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([i[first].tobytes()]), pa.array([y.tobytes()])], names=["i", "y"])

        out = np.zeros_like(x)
        for row in blocks.mapInArrow(run, "i binary, y binary").collect():
            out[np.frombuffer(row.i, np.int64)] = np.frombuffer(row.y).reshape(-1, x.shape[1])
        held.destroy()
        return out

    return times


def similarity_times(df: DataFrame, m, gamma: float, ids: np.ndarray) -> Times:
    """Products with ``exp(-gamma d^2)`` of all pairs of rows, worked out tile by tile."""
    sc = df.sparkSession.sparkContext
    sent, t = sc.broadcast(ids), tiles(df, [m])

    def times(x: np.ndarray) -> np.ndarray:
        held = sc.broadcast(x)

        def run(pairs) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for a, b in pairs:
                w = pairwise([m], a.x, b.x)
                w *= w
                w *= -gamma
                np.exp(w, out=w)
                for o, y in ((a, w @ held.value[np.searchsorted(sent.value, b.ids)]), (b, w.T @ held.value[np.searchsorted(sent.value, a.ids)]))[: 1 + (a.tile != b.tile)]:
                    merge(sums, o, (np.add, y))
            for tile, (i, y) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([np.searchsorted(sent.value, i).tobytes()]), pa.array([y.tobytes()])], names=["tile", "i", "y"])

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"i": [t.column("i")[0].as_buffer().to_pybytes()], "y": [sum(np.frombuffer(y.as_buffer()) for y in t.column("y")).tobytes()]})

        out = np.zeros_like(x)
        for row in over_pairs(t, [m], run, "tile long, i binary, y binary", once=True).groupBy("tile").applyInArrow(add, "i binary, y binary").collect():
            out[np.frombuffer(row.i, np.int64)] = np.frombuffer(row.y).reshape(-1, x.shape[1])
        held.destroy()
        return out

    return times


def _diameter(x: np.ndarray, m) -> float:
    """The approximate diameter of :mod:`mosaica.functions.norms`, of an array."""
    m, at, best, pair = replace(m, norm=1.0, weight=1.0), 0, 0.0, None
    for _ in range(5):
        d = pairwise([m], x, x[at][None])[:, 0]
        far = int(d.argmax())
        e = pairwise([m], x, x[far][None])[:, 0]
        back = int(e.argmax())
        best = max(best, d[far], e[back])
        if pair == {far, back}:
            break
        pair, at = {far, back}, back
    return float(best)


class _Spectral(Algorithm):
    def times(self, frame: MultiFrame, m, ids: np.ndarray) -> Times:
        raise NotImplementedError

    def eigenvectors(self, frame: MultiFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The identifiers in ascending order, and each modality's eigenvalues and eigenvectors, with rows in that order."""
        rows = frame.df.select(F.col(ID).cast("long").alias(ID)).toArrow().column(ID).to_numpy()
        ids = np.sort(rows)
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            raise ValueError(f"{ID} repeats")
        return ids, [eigenvectors(self.times(frame, m, ids), len(ids), self.params["eigen"], self.params["seed"]) for m in frame.modalities]

    def fit(self, frame: MultiFrame) -> LabelledModel:
        p = self.params
        if frame.amount < p["k"]:
            raise RuntimeError(f"not enough rows for {p['k']} clusters")
        ids, found = self.eigenvectors(frame)
        ms = []
        for m, (_, x) in zip(frame.modalities, found):
            new = replace(m, dim=x.shape[1])
            ms.append(replace(new, norm=_diameter(x, new)))
        x = np.concatenate([x for _, x in found], axis=1)
        centres = local_kmeans(x, np.ones(len(ids)), p["k"], p["max_iterations"], ms, p["seed"])
        labels = nearest(ms, x, centres)[0]
        spark = frame.df.sparkSession
        table = spark.createDataFrame(pa.table({ID: pa.array(ids), LABEL: pa.array(labels.astype(np.int32))}))
        return LabelledModel(frame.like(frame.df.join(table, ID)))


class SpectralAdjacency(_Spectral):
    """Laplacian of the nearest neighbours' graph: ``neighbours`` on the diagonal, -1 for each neighbour, made symmetric."""

    def __init__(self, neighbours: int, eigen: int, k: int, max_iterations: int = 20, seed: int = 0):
        check(neighbours=neighbours >= 1, eigen=eigen >= 1, k=k >= 2, max_iterations=max_iterations >= 1)
        super().__init__(neighbours=neighbours, eigen=eigen, k=k, max_iterations=max_iterations, seed=seed)

    def entries(self, frame: MultiFrame, m) -> DataFrame:
        """``(_id, neighbour, v)``, of which those of one pair add up."""
        one = replace(m, weight=1.0)
        near = cut(nearest_neighbours(frame.df, [one], self.params["neighbours"]).select(ID, "neighbour"), "graph")
        half = near.select(ID, "neighbour", F.lit(-0.5).alias("v"))
        other = near.select(F.col("neighbour").alias(ID), F.col(ID).alias("neighbour"), F.lit(-0.5).alias("v"))
        own = frame.df.select(F.col(ID).cast("long").alias(ID), F.col(ID).cast("long").alias("neighbour"), F.lit(float(self.params["neighbours"])).alias("v"))
        return half.unionByName(other).unionByName(own)

    def times(self, frame: MultiFrame, m, ids: np.ndarray) -> Times:
        return sparse_times(self.entries(frame, m), ids)


class SpectralSimilarity(_Spectral):
    """All pairs, ``exp(-gamma d^2)``."""

    def __init__(self, gamma: float, eigen: int, k: int, max_iterations: int = 20, seed: int = 0):
        check(gamma=gamma > 0, eigen=eigen >= 1, k=k >= 2, max_iterations=max_iterations >= 1)
        super().__init__(gamma=gamma, eigen=eigen, k=k, max_iterations=max_iterations, seed=seed)

    def times(self, frame: MultiFrame, m, ids: np.ndarray) -> Times:
        return similarity_times(frame.df, replace(m, weight=1.0), self.params["gamma"], ids)
