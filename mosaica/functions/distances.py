"""The five metrics, the multimodal distance and row algebra, as column expressions and as NumPy kernels.

Expressions stay in the JVM: up to :data:`UNROLL` dimensions they are written out, beyond that they are higher-order
functions. Kernels work on blocks ``(rows, dim)`` per modality inside Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..modality import METRICS, Modality

UNROLL = 64
#: Canberra skips terms with smaller denominators; cosine is 0 for smaller products of norms.
TINY, TINY_NORMS = 1e-9, 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _terms(x: Column, y: Column, dim: int | None, term) -> list[Column] | None:
    return [term(x[i], y[i]) for i in range(dim)] if dim and dim <= UNROLL else None


def _total(x: Column, y: Column, dim: int | None, term) -> Column:
    parts = _terms(x, y, dim, term)
    if parts:
        return reduce(lambda a, b: a + b, parts)
    return F.aggregate(F.zip_with(x, y, term), F.lit(0.0), lambda a, b: a + b)


def metric(name: str, x: Column | str, y: Column | str, dim: int | None = None) -> Column:
    """Distance of two ``array<double>`` columns; with ``dim`` known and small it is written out."""
    x, y = _col(x), _col(y)
    if name == "manhattan":
        return _total(x, y, dim, lambda a, b: F.abs(a - b))
    if name == "euclidean":
        return F.sqrt(_total(x, y, dim, lambda a, b: (a - b) * (a - b)))
    if name == "chebyshev":
        parts = _terms(x, y, dim, lambda a, b: F.abs(a - b))
        return (F.greatest(*parts) if len(parts) > 1 else parts[0]) if parts else F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b))), F.lit(0.0))
    if name == "canberra":
        return _total(x, y, dim, lambda a, b: F.when(F.abs(a) + F.abs(b) > TINY, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0))
    if name == "cosine":
        norms = norm2(x, dim) * norm2(y, dim)
        return F.when(norms > TINY_NORMS, 1 - _total(x, y, dim, lambda a, b: a * b) / norms).otherwise(0.0)
    raise ValueError(f"unknown metric {name!r}")


def norm2(x: Column | str, dim: int | None = None) -> Column:
    return F.sqrt(_total(_col(x), _col(x), dim, lambda a, b: a * b))


def multimodal(modalities: Sequence[Modality], left: str = "", right: str = "_2") -> Column:
    """``sqrt(sum w (d / norm)^2)`` of the modality columns ``<left>name`` and ``name<right>``; a norm of 0 counts as no distance."""
    total = None
    for m in modalities:
        if m.norm == 0:
            continue
        d = metric(m.metric, f"{left}{m.name}", f"{m.name}{right}", m.dim) / F.lit(m.norm)
        total = d * d * F.lit(m.weight) if total is None else total + d * d * F.lit(m.weight)
    return F.sqrt(total) if total is not None else F.lit(0.0)


def one_dimension(m: Modality, x: Column, y: Column) -> Column:
    """Lower bound of the multimodal distance from one coordinate of a modality."""
    return F.lit(np.sqrt(m.weight) / m.norm if m.norm else 0.0) * F.abs(x - y)


# ---- row algebra --------------------------------------------------------------------------------------------------


def plus(x, y, a: float = 1.0, b: float = 1.0) -> Column:
    return F.zip_with(_col(x), _col(y), lambda p, q: p * F.lit(a) + q * F.lit(b))


def scale(x, a: float) -> Column:
    return F.transform(_col(x), lambda p: p * F.lit(a))


def elementwise(x, y, f) -> Column:
    """``f`` of the coordinates, as ``F.least`` and ``F.greatest``."""
    return F.zip_with(_col(x), _col(y), lambda a, b: f(a, b))


def l2(modalities: Sequence[Modality]) -> Column:
    """Weighted sum of the modalities' lengths."""
    return reduce(lambda a, b: a + b, [norm2(m.name, m.dim) * F.lit(m.weight) for m in modalities])


def zero(m: Modality) -> Column:
    return F.array_repeat(F.lit(0.0), m.dim)


def flatten(modalities: Sequence[Modality]) -> Column:
    """All modalities as one vector, in their order."""
    return F.concat(*(F.col(m.name) for m in modalities))


def wrap(modalities: Sequence[Modality], flat: Column | str) -> list[Column]:
    """The modalities of a flat vector."""
    out, at = [], 1
    for m in modalities:
        out.append(F.slice(_col(flat), at, m.dim).alias(m.name))
        at += m.dim
    return out


def by_global(modalities: Sequence[Modality], k: int) -> Column:
    """Coordinate ``k`` of the flat vector."""
    for m in modalities:
        if k < m.dim:
            return F.col(m.name)[k]
        k -= m.dim
    raise ValueError("no such dimension")


def same(modalities: Sequence[Modality], right: str = "_2", tolerance: float = 1e-12) -> Column:
    """Whether two rows' modalities agree within the tolerance in every coordinate."""
    parts = [F.forall(F.zip_with(F.col(m.name), F.col(f"{m.name}{right}"), lambda a, b: F.abs(a - b) < tolerance), lambda ok: ok) for m in modalities]
    return reduce(lambda a, b: a & b, parts)


# ---- kernels ------------------------------------------------------------------------------------------------------

#: Doubles that a block of distances may hold.
BLOCK = 4_000_000
#: Dimensions from which Euclidean distances are a matrix product.
PRODUCT = 5


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """``(rows, dim)`` of an array column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.float64).reshape(len(column), dim)


def blocks(batch: pa.RecordBatch, modalities: Sequence[Modality]) -> np.ndarray:
    """The flat vectors of a batch."""
    return np.concatenate([matrix(batch.column(m.name), m.dim) for m in modalities], axis=1)


#: Squared distances below this share of the squared lengths are worked out from differences: products would lose their digits.
CANCELLED = 1e-6
#: Rows and columns of the differences that are held at a time.
STRIP, SPAN = 8, 8192
#: Differences that are worked out at once, where that is less than the calls.
FEW = 20_000


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, as one matrix product of rows with their squared lengths; those near 0 from differences."""
    c = y.mean(0) if len(y) else 0.0
    a, b = x - c, y - c
    p, q = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    out = np.concatenate([a, p[:, None], np.ones((len(a), 1))], axis=1) @ np.concatenate([-2 * b, np.ones((len(b), 1)), q[:, None]], axis=1).T
    if not out.size:
        return out
    near = CANCELLED * (p + q.max())
    for s in np.flatnonzero(out.min(1) < near):
        j = np.flatnonzero(out[s] < near[s])
        out[s, j] = ((y[j] - x[s]) ** 2).sum(1)
    return out


def _by_dimension(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Metrics that are no product: dimension by dimension over strips that stay in the processor's cache."""
    n, k = len(x), len(y)
    if n * y.size <= FEW:
        t = np.abs(x[:, None, :] - y[None, :, :])
        if name == "canberra":
            den = np.abs(x)[:, None, :] + np.abs(y)[None, :, :]
            t = np.divide(t, den, out=np.zeros_like(t), where=den > TINY)
        elif name == "squares":
            t *= t
        return t.max(2, initial=0) if name == "chebyshev" else t.sum(2)
    out = np.zeros((n, k))
    strip = STRIP if k >= 64 else max(STRIP, min(n, 4096))
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    size = None if name != "canberra" else (np.abs(xt), np.abs(yt))
    for s in range(0, n, strip):
        for e in range(0, k, SPAN):
            o = out[s : s + strip, e : e + SPAN]
            t = np.empty(o.shape)
            den = np.empty(o.shape) if size else None
            for d in range(len(xt)):
                np.subtract(xt[d, s : s + strip, None], yt[d, None, e : e + SPAN], out=t)
                np.abs(t, out=t)
                if name == "chebyshev":
                    np.maximum(o, t, out=o)
                    continue
                if size:
                    np.add(size[0][d, s : s + strip, None], size[1][d, None, e : e + SPAN], out=den)
                    if den.min() > TINY:
                        t /= den
                    else:
                        t = np.divide(t, den, out=np.zeros_like(t), where=den > TINY)
                elif name == "squares":
                    t *= t
                o += t
    return out


def _metric(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if name == "cosine":
        norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        return np.where(norms > TINY_NORMS, 1 - np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > TINY_NORMS), 0.0)
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    if name == "euclidean":
        out = squares(x, y)
        return np.sqrt(out, out=out)
    return _by_dimension(name, x, y)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of ``x`` and ``y``."""
    return _squares(x, y) if x.shape[1] >= PRODUCT and len(x) * y.size > FEW else _by_dimension("squares", x, y)


def pairwise(modalities: Sequence[Modality], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Multimodal distances of all flat vectors of ``x`` and ``y``."""
    total, at = None, 0
    for m in modalities:
        if m.norm:
            a, b = x[:, at : at + m.dim], y[:, at : at + m.dim]
            if m.metric == "euclidean":
                d = squares(a, b)
            else:
                d = _metric(m.metric, a, b)
                d *= d
            share = m.weight / m.norm**2
            if share != 1:
                d *= share
            total = d if total is None else np.add(total, d, out=total)
        at += m.dim
    return np.zeros((len(x), len(y))) if total is None else np.sqrt(total, out=total)


def paired(modalities: Sequence[Modality], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Multimodal distances of each row of ``x`` from the same row of ``y``, from their differences."""
    total, at = np.zeros(len(x)), 0
    for m in modalities:
        if m.norm:
            a, b = x[:, at : at + m.dim], y[:, at : at + m.dim]
            t = np.abs(a - b)
            if m.metric == "euclidean":
                d = np.sqrt((t * t).sum(1))
            elif m.metric == "manhattan":
                d = t.sum(1)
            elif m.metric == "chebyshev":
                d = t.max(1, initial=0)
            elif m.metric == "canberra":
                den = np.abs(a) + np.abs(b)
                d = np.divide(t, den, out=np.zeros_like(t), where=den > TINY).sum(1)
            else:
                n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
                d = np.where(n > TINY_NORMS, 1 - np.divide((a * b).sum(1), n, out=np.zeros_like(n), where=n > TINY_NORMS), 0.0)
            d = d / m.norm
            total += m.weight * d * d
        at += m.dim
    return np.sqrt(total)


#: What two ways to work out a distance may differ by, as a share of the largest in question.
DOUBT = 1e-9


def within(modalities: Sequence[Modality], x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Which pairs are at most epsilon apart; those at its edge are decided by their differences."""
    d = pairwise(modalities, x, y)
    out = d <= epsilon
    i, j = np.nonzero(np.abs(d - epsilon) <= DOUBT * epsilon)
    if len(i):
        out[i, j] = paired(modalities, x[i], y[j]) <= epsilon
    return out


def nearest(modalities: Sequence[Modality], x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each row's nearest centre; of equal ones the first."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    step = max(1, BLOCK // max(1, len(x) or 1))
    for s in range(0, len(centres), step):
        d = pairwise(modalities, x, centres[s : s + step])
        k = d.argmin(1)
        v = d[np.arange(len(x)), k]
        less = v < best
        best[less], at[less] = v[less], k[less] + s
    return at, best


def l2_rows(modalities: Sequence[Modality], x: np.ndarray) -> np.ndarray:
    total, at = np.zeros(len(x)), 0
    for m in modalities:
        total += m.weight * np.sqrt((x[:, at : at + m.dim] ** 2).sum(1))
        at += m.dim
    return total
