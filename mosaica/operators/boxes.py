"""Boxes of rows, split where many rows are, and the pairs of boxes that may have rows within a distance of each other.

The box of all rows is split level by level: a box with more than ``points_in_box`` rows is cut into ``axis_splits`` equal parts along the
dimension in which it is widest, as long as the parts are at least twice ``epsilon`` wide, for ``levels`` levels. A dimension's width
is what it can add to the multimodal distance at least. Modalities under cosine and Canberra give no such bound and are not split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distances import blocks
from ..modality import Modality, MultiFrame
from .base import Defaults

_BOUNDED = ("euclidean", "manhattan", "chebyshev")
#: Pairs of boxes whose gaps are worked out at a time.
STEP = 4_000_000


class Boxes:
    """``lo`` and ``hi`` of every box; the outer ones reach to infinity, so that any row is in one."""

    def __init__(self, modalities: Sequence[Modality], epsilon: float, lo: np.ndarray, hi: np.ndarray):
        self.ms, self.epsilon = tuple(modalities), epsilon
        self.scale = np.concatenate([np.full(m.dim, np.sqrt(m.weight) / m.norm if m.norm and m.metric in _BOUNDED else 0.0) for m in self.ms])
        self.bounds = lo, hi
        self.lo, self.hi = lo[None], hi[None]
        #: ``(dimension, cuts, children)`` of split nodes, the box's number of others.
        self.nodes: list[tuple | int] = [0]
        self.node_of = [0]

    def __len__(self) -> int:
        return len(self.lo)

    def split(self, boxes: Sequence[int], parts: int) -> bool:
        """Splits those of ``boxes`` that are wide enough; whether there were any."""
        lo, hi, done = list(self.lo), list(self.hi), False
        for b in boxes:
            wide = (hi[b] - lo[b]) * self.scale
            d = int(wide.argmax())
            if not wide[d] / parts >= 2 * self.epsilon:
                continue
            cuts, done = np.linspace(lo[b][d], hi[b][d], parts + 1), True
            children = []
            for k in range(parts):
                low, high = lo[b].copy(), hi[b].copy()
                low[d], high[d] = cuts[k], cuts[k + 1]
                box = b if not children else len(lo)
                self.nodes.append(box)
                children.append(len(self.nodes) - 1)
                if box == b:
                    first = (low, high)
                else:
                    lo.append(low)
                    hi.append(high)
                    self.node_of.append(children[-1])
            self.nodes[self.node_of[b]] = (d, cuts[1:-1], children)
            self.node_of[b] = children[0]
            lo[b], hi[b] = first
        self.lo, self.hi = np.array(lo), np.array(hi)
        return done

    def open(self) -> Boxes:
        low, high = self.lo.min(0), self.hi.max(0)
        self.lo, self.hi = np.where(self.lo == low, -np.inf, self.lo), np.where(self.hi == high, np.inf, self.hi)
        return self

    def of(self, x: np.ndarray) -> np.ndarray:
        """The number of each row's box."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            at = self.nodes[node]
            if isinstance(at, int):
                out[rows] = at
                continue
            d, cuts, children = at
            side = np.searchsorted(cuts, x[rows, d], "right")
            todo += [(c, rows[side == k]) for k, c in enumerate(children) if (side == k).any()]
        return out

    def near(self) -> np.ndarray:
        """``(pairs, 2)``: boxes, also a box and itself, between which no dimension rules out ``epsilon``."""
        split = np.flatnonzero((np.isfinite(self.lo) | np.isfinite(self.hi)).any(0))
        owner = np.repeat(np.arange(len(self.ms)), [m.dim for m in self.ms])
        out, rows = [], max(1, STEP // len(self))
        for s in range(0, len(self), rows):
            lo, hi = self.lo[s : s + rows, None], self.hi[s : s + rows, None]
            total = np.zeros((lo.shape[0], len(self)))
            for k, m in enumerate(self.ms):
                part = np.zeros_like(total)
                for d in split[owner[split] == k]:
                    gap = np.maximum(np.maximum(self.lo[None, :, d] - hi[:, :, d], lo[:, :, d] - self.hi[None, :, d]), 0) * self.scale[d]
                    part = {"euclidean": lambda p, g: p + g * g, "manhattan": lambda p, g: p + g, "chebyshev": np.maximum}.get(m.metric, lambda p, g: p)(part, gap)
                total += part if m.metric == "euclidean" else part * part
            i, j = np.nonzero(total <= self.epsilon**2 * (1 + 1e-9))
            out.append(np.stack([i + s, j], axis=1))
        return np.concatenate(out)

    def apart(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squares of the least and greatest distances that rows within some bounds and others may have."""
        least, most, at = np.zeros((len(lo), len(lo2))), np.zeros((len(lo), len(lo2))), 0
        for m in self.ms:
            near, far = np.zeros_like(least), np.zeros_like(least)
            if m.norm and m.weight and m.metric not in _BOUNDED:
                far += np.inf
            for d in range(at, at + m.dim) if m.metric in _BOUNDED else ():
                a, b, c, e = lo[:, None, d], hi[:, None, d], lo2[None, :, d], hi2[None, :, d]
                for total, gap in ((near, np.maximum(np.maximum(c - b, a - e), 0) * self.scale[d]), (far, np.maximum(e - a, b - c) * self.scale[d])):
                    if m.metric == "chebyshev":
                        np.maximum(total, gap, out=total)
                    else:
                        total += gap * gap if m.metric == "euclidean" else gap
            for out, part in ((least, near), (most, far)):
                out += part if m.metric == "euclidean" else part * part
            at += m.dim
        return least, most

    def pairs(self, spark: SparkSession) -> DataFrame:
        """:meth:`near` as ``(box, box_2)``; boxes are few, of the order of the root of the rows."""
        p = self.near().astype(np.int64)
        return spark.createDataFrame(pa.table({"box": p[:, 0], "box_2": p[:, 1]}))


def bounds(df: DataFrame, modalities: Sequence[Modality]) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest value of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = None, None
        for b in batches:
            if b.num_rows:
                x = blocks(b, modalities)
                lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lo.tobytes()]), pa.array([hi.tobytes()])], names=["lo", "hi"])

    rows = df.select(*(m.name for m in modalities)).mapInArrow(run, "lo binary, hi binary").collect()
    if not rows:
        return None
    return np.min([np.frombuffer(bytes(r.lo)) for r in rows], axis=0), np.max([np.frombuffer(bytes(r.hi)) for r in rows], axis=0)


def counts(df: DataFrame, boxes: Boxes) -> np.ndarray:
    """Rows of each box."""
    ms = boxes.ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(boxes), np.int64)
        for b in batches:
            n += np.bincount(boxes.of(blocks(b, ms)), minlength=len(boxes))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["box", "n"])

    got = df.select(*(m.name for m in ms)).mapInArrow(run, "box long, n long").groupBy("box").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(boxes), np.int64)
    for r in got:
        out[r.box] = r.n
    return out


def boxes_of(frame: MultiFrame, epsilon: float, points_in_box: int | None = None, levels: int | None = None, axis_splits: int = 2) -> Boxes:
    """The boxes of a frame; by default five times the root of the rows in each, and twice the logarithm of the rows of levels."""
    dim = frame.global_dim
    found = bounds(frame.df, frame.modalities)
    lo, hi = found if found else (np.zeros(dim), np.zeros(dim))
    boxes = Boxes(frame.modalities, epsilon, lo, hi)
    most = max(1, Defaults.points_in_box(frame) if points_in_box is None else points_in_box)
    for _ in range(max(1, Defaults.levels(frame)) if levels is None else levels):
        full = np.flatnonzero(counts(frame.df, boxes) > most) if found else []
        if not len(full) or not boxes.split(full.tolist(), axis_splits):
            break
    return boxes.open()
