"""Nineteen features of a data set from the distances of all pairs of its rows.

One pass over pairs of tiles gives count, mean, central power sums and the histogram of distances, as partial results that are merged; a
second one, which needs mean and deviation, gives the shares by standard score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from ..functions.distances import DOUBT, paired, pairwise
from ..functions.tiles import over_pairs, tiles
from ..modality import MultiFrame

NAMES = ["mean", "variance", "std", "skewness", "kurtosis", *(f"md{i}" for i in range(1, 11)), *(f"z{i}" for i in range(4))]


def meta_features(frame: MultiFrame) -> list[float]:
    """In the order of :data:`NAMES`. Distances beyond 1 are in no share, 1 is in the last; scores below 0 in none."""
    ms, n = frame.modalities, frame.amount
    if n < 2:
        raise ValueError("meta-features need at least two rows")
    t, pairs = tiles(frame.df, ms), n * (n - 1) / 2

    def distances(both) -> Iterator[np.ndarray]:
        for a, b in both:
            d = pairwise(ms, a.x, b.x)
            if d.max() >= 1 - DOUBT:  # whether the greatest distance is 1 or just beyond
                i, j = np.nonzero(np.abs(d - 1) <= DOUBT)
                d[i, j] = paired(ms, a.x[i], b.x[j])
            yield d[a.ids[:, None] < b.ids[None, :]] if a.tile == b.tile else d.ravel()

    def over(f) -> list[np.ndarray]:
        """``f`` of the distances of each task, those without any left out."""

        def run(both) -> Iterator[pa.RecordBatch]:
            total = f(distances(both))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["x"])

        return [np.frombuffer(bytes(r.x)) for r in over_pairs(t, ms, run, "x binary", once=True).collect()]

    edges = np.arange(11) * 0.1

    def moments(every) -> np.ndarray | None:
        total = None
        for d in every:
            if not d.size:
                continue
            mean = d.mean()
            c = d - mean
            square = c * c
            above = np.array([np.count_nonzero(d >= e) for e in edges[:10]] + [np.count_nonzero(d > edges[10])])
            now = np.concatenate([[d.size, mean, square.sum(), np.dot(square, c), np.dot(square, square)], above[:-1] - above[1:]])
            total = now if total is None else merged(total, now)
        return total

    m = reduce(merged, over(moments))
    mean, (variance, m3, m4) = m[1], m[2:5] / pairs
    std = math.sqrt(variance)

    def scores(every) -> np.ndarray:
        total = np.zeros(4)
        for d in every:
            score = (d - mean) / std
            above = np.array([np.count_nonzero(score >= k) for k in range(4)] + [0])
            total += above[:-1] - above[1:]
        return total

    z = sum(over(scores)) / pairs if std else np.array([1.0, 0, 0, 0])
    return [mean, variance, std, m3 / std**3 if std else 0.0, m4 / std**4 - 3 if std else 0.0, *(m[5:] / pairs).tolist(), *z.tolist()]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and sums of the second to fourth powers of differences from the mean, of two parts together; the rest is added."""
    n, d = a[0] + b[0], b[1] - a[1]
    out = a + b
    out[0], out[1] = n, a[1] + d * b[0] / n
    out[2] += d**2 * a[0] * b[0] / n
    out[3] += d**3 * a[0] * b[0] * (a[0] - b[0]) / n**2 + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n
    out[4] += d**4 * a[0] * b[0] * (a[0] ** 2 - a[0] * b[0] + b[0] ** 2) / n**3 + 6 * d**2 * (a[0] ** 2 * b[2] + b[0] ** 2 * a[2]) / n**2 + 4 * d * (a[0] * b[3] - b[0] * a[3]) / n
    return out
