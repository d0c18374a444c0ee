"""The scale of a modality: an approximate diameter in a few passes, or the exact one over all pairs.

Passes are Arrow kernels that send one row a partition; all modalities go through them together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..modality import ID, Modality
from ..session import cut
from .distances import matrix, paired, pairwise, squares

ROUNDS = 5
#: Dimensions up to which cells rule out rows of a diameter; cells at a time, divisions, and rows that may stay.
FEW_DIMENSIONS, CELLS, DIVISIONS, FEW_ROWS = 4, 4096, 6, 5000


def _alone(m: Modality) -> Modality:
    return replace(m, norm=1.0, weight=1.0)


def _farthest(df: DataFrame, pivots: dict[Modality, np.ndarray]) -> dict[Modality, tuple[int, np.ndarray, float]]:
    """Of each modality the row farthest from its pivot; of equal ones that with the least identifier."""
    ms = list(pivots)
    slim = df.select(F.col(ID).cast("long").alias(ID), *(m.name for m in ms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(ID).to_numpy()
            for k, m in enumerate(ms):
                x = matrix(b.column(m.name), m.dim)
                d = pairwise([_alone(m)], x, pivots[m][None])[:, 0]
                far = np.flatnonzero(d == d.max())
                i = far[ids[far].argmin()]
                if k not in best or (-d[i], ids[i]) < (-best[k][0], best[k][1]):
                    best[k] = (float(d[i]), int(ids[i]), x[i].copy())
        for k, (d, i, x) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d]), pa.array([i]), pa.array([x.tobytes()])], names=["k", "d", "i", "x"])

    rows = slim.mapInArrow(run, "k long, d double, i long, x binary").collect()
    out: dict[Modality, tuple[int, np.ndarray, float]] = {}
    for r in sorted(rows, key=lambda r: (-r.d, r.i)):
        out.setdefault(ms[r.k], (r.i, np.frombuffer(bytes(r.x)), r.d))
    return out


def farthest(df: DataFrame, m: Modality, pivot: Sequence[float]) -> tuple[int, list[float], float] | None:
    """The row farthest from ``pivot``; of equal ones that with the least identifier."""
    got = _farthest(df, {m: np.asarray(pivot, float)}).get(m)
    return (got[0], got[1].tolist(), got[2]) if got else None


def approximate_diameters(df: DataFrame, modalities: Sequence[Modality], rounds: int = ROUNDS) -> dict[Modality, float]:
    """Lower bounds of the diameters: from the row of the least identifier, to the farthest row and on from there, until the pair repeats."""
    own = not (df.storageLevel.useMemory or df.storageLevel.useDisk)
    df = df.select(ID, *(m.name for m in modalities))
    if own:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = df.agg(F.min_by(F.struct(*(m.name for m in modalities)), ID).alias("r")).first().r
        best = dict.fromkeys(modalities, 0.0)
        if first is None:
            return best
        pair, pivot = {}, {m: np.asarray(first[m.name], float) for m in modalities}
        for _ in range(rounds):
            far = _farthest(df, pivot)
            back = _farthest(df, {m: x for m, (_, x, _) in far.items()})
            pivot = {m: back[m][1] for m in far if pair.get(m) != {far[m][0], back[m][0]}}
            for m in far:
                best[m] = max(best[m], far[m][2], back[m][2])
                pair[m] = {far[m][0], back[m][0]}
            if not pivot:
                break
        return best
    finally:
        if own:
            df.unpersist()


def approximate_diameter(df: DataFrame, m: Modality, rounds: int = ROUNDS) -> float:
    return approximate_diameters(df, [m], rounds)[m]


def _reach(m: Modality, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Greatest distance that rows of two boxes may have, of all pairs of boxes."""
    total = np.zeros((len(lo), len(lo2)))
    for d in range(m.dim):
        far = np.maximum(np.abs(hi[:, None, d] - lo2[None, :, d]), np.abs(hi2[None, :, d] - lo[:, None, d]))
        if m.metric == "chebyshev":
            np.maximum(total, far, out=total)
        else:
            total += far * far if m.metric == "euclidean" else far
    return np.sqrt(total) if m.metric == "euclidean" else total


def _outer(df: DataFrame, m: Modality, least: float) -> DataFrame:
    """``(_id, <name>)`` of the vectors that may be ends of a distance of ``least``, each once: cells that no other can be that far from are dropped, and the others divided."""
    rows, (lo, hi) = df.select(F.lit(0).cast("long").alias("cell"), F.col(ID).cast("long").alias(ID), m.name), (np.zeros((1, m.dim)), np.zeros((1, m.dim)))
    parts, before = 1, None
    for _ in range(DIVISIONS):

        def place(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi, parts=parts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, cell = matrix(b.column(m.name), m.dim), b.column("cell").to_numpy()
                width = np.where(hi > lo, hi - lo, 1.0)[cell]
                at = np.clip(((x - lo[cell]) / width * parts).astype(np.int64), 0, parts - 1)
                for d in range(m.dim):
                    cell = cell * parts + at[:, d]
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(ID), b.column(m.name)], names=["cell", ID, m.name])

        rows = cut(rows.mapInArrow(place, rows.schema), "cells")

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, cell = matrix(b.column(m.name), m.dim), b.column("cell").to_numpy()
                    order = np.argsort(cell, kind="stable")
                    x, cell = x[order], cell[order]
                    s = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                    ends = np.minimum.reduceat(x, s, axis=0), np.maximum.reduceat(x, s, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s]), pa.array(np.diff(np.append(s, len(x)))), *(pa.array(e[:, d]) for e in ends for d in range(m.dim))], names=names)

        names = ["cell", "n", *(f"{e}{d}" for e in ("lo", "hi") for d in range(m.dim))]
        part = rows.mapInArrow(bounds, ", ".join(f"{c} {'long' if c in ('cell', 'n') else 'double'}" for c in names))
        found = part.groupBy("cell").agg(F.sum("n").alias("n"), *((F.min if c[0] == "l" else F.max)(c).alias(c) for c in names[2:])).toArrow()
        if not len(found):
            return rows.select(ID, m.name)
        ends = [np.stack([found.column(f"{e}{d}").to_numpy() for d in range(m.dim)], axis=1) for e in ("lo", "hi")]
        step = max(1, 2_000_000 // len(found))
        keep = np.concatenate([_reach(m, ends[0][s : s + step], ends[1][s : s + step], *ends).max(1) >= least * (1 - 1e-9) for s in range(0, len(found), step)])
        old, n = found.column("cell").to_numpy()[keep], int(found.column("n").to_numpy()[keep].sum())
        lo, hi = ends[0][keep], ends[1][keep]
        order = np.argsort(old)
        old, lo, hi = old[order], lo[order], hi[order]

        def stay(batches: Iterator[pa.RecordBatch], old=old) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column("cell").to_numpy()
                at = np.minimum(np.searchsorted(old, cell), len(old) - 1)
                on = np.flatnonzero(old[at] == cell)
                b = b.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([pa.array(at[on]), b.column(ID), b.column(m.name)], names=["cell", ID, m.name])

        rows = rows.mapInArrow(stay, rows.schema)
        if n <= FEW_ROWS or (parts > 1 and before is not None and n > 0.8 * before) or len(old) > CELLS:
            break
        before, parts = n if parts > 1 else None, max(2, int((CELLS / len(old)) ** (1 / m.dim)))
    distinct = rows.groupBy(m.name).agg(F.min("cell").alias("cell"), F.min(ID).alias(ID))
    return distinct.repartitionByRange("cell").sortWithinPartitions("cell", ID).select(ID, m.name)


def exact_diameter(df: DataFrame, m: Modality) -> float:
    """The greatest distance of all pairs. Of vectors of few dimensions, only those that can be an end of it are compared."""
    from .tiles import over_pairs, tiles

    one, dim = [_alone(m)], m.dim
    least = approximate_diameter(df, one[0])
    bounded = m.metric in ("euclidean", "manhattan", "chebyshev")
    if bounded and dim <= FEW_DIMENSIONS:
        df = _outer(df, one[0], least)
    # a metric is at most so many times the Euclidean one
    share = {"euclidean": 1.0, "chebyshev": 1.0, "manhattan": float(np.sqrt(dim))}.get(m.metric)

    def run(pairs) -> Iterator[pa.RecordBatch]:
        best = 0.0
        for a, b in pairs:
            floor = max(least, best) * (1 - 1e-9)
            if bounded and dim <= FEW_DIMENSIONS and _reach(one[0], *(v[None] for v in (a.x.min(0), a.x.max(0), b.x.min(0), b.x.max(0))))[0, 0] < floor:
                continue
            if share:
                i, j = np.nonzero(squares(a.x, b.x) >= (floor / share) ** 2)
                if len(i) <= 0.1 * a.n * b.n:
                    for s in range(0, len(i), 1 << 14):
                        best = max(best, float(paired(one, a.x[i[s : s + (1 << 14)]], b.x[j[s : s + (1 << 14)]]).max()))
                    continue
            best = max(best, float(pairwise(one, a.x, b.x).max()))
        yield pa.RecordBatch.from_arrays([pa.array([best])], names=["d"])

    return over_pairs(tiles(df, one), one, run, "d double", once=True).agg(F.max("d")).first()[0] or 0.0


def with_norms(df: DataFrame, modalities: Sequence[Modality]) -> list[Modality]:
    found = approximate_diameters(df, modalities)
    return [replace(m, norm=found[m]) for m in modalities]


def with_norm(df: DataFrame, m: Modality) -> Modality:
    return with_norms(df, [m])[0]
