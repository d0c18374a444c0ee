"""K-means, bisecting k-means and mean shift under the multimodal distance.

A round is one pass: the centres go to the executors, partitions send partial sums. Starts and samples come from hashes
of ``_id``, so results don't depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.distances import blocks, l2_rows, nearest, pairwise
from ..modality import ID, MultiFrame
from .base import Algorithm, CentreModel, Model, check, check_clusters, hash_order, kept, sums_by


def local_kmeans(x: np.ndarray, weights: np.ndarray, k: int, max_iterations: int, modalities, seed: int = 0, starts: int = 4) -> np.ndarray:
    """Weighted k-means of a few vectors: seeds drawn in proportion to weighted distance, then Lloyd rounds; the cheapest of a few starts."""
    weights = np.asarray(weights, float)
    tries = [_local_kmeans(x, weights, k, max_iterations, modalities, np.random.default_rng([seed, s])) for s in range(starts)]
    return min(tries, key=lambda c: float((nearest(modalities, x, c)[1] * weights).sum()))


def _local_kmeans(x: np.ndarray, weights: np.ndarray, k: int, max_iterations: int, modalities, r: np.random.Generator) -> np.ndarray:

    def draw(w: np.ndarray) -> int:
        return int(r.choice(len(x), p=w / w.sum())) if w.sum() > 0 else int(r.integers(len(x)))

    centres = [x[draw(weights)]]
    cost = pairwise(modalities, x, centres[0][None])[:, 0]
    while len(centres) < k:
        centres.append(x[draw(cost * weights)])
        cost = np.minimum(cost, pairwise(modalities, x, centres[-1][None])[:, 0])
    c, old = np.array(centres), None
    for _ in range(max_iterations):
        at = nearest(modalities, x, c)[0]
        if old is not None and np.array_equal(at, old):
            break
        old = at
        for j in range(k):
            w = weights[at == j]
            c[j] = (x[at == j] * w[:, None]).sum(0) / w.sum() if w.sum() > 0 else x[int(r.integers(len(x)))]
    return c


def lloyd_step(frame: MultiFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of the rows nearest to each centre, how many those are, and the sum of their distances; a centre without rows stays."""
    ms = frame.modalities

    def f(x, _):
        at, d = nearest(ms, x, centres)
        return np.arange(len(x)), at, d

    got = sums_by(frame.df, ms, f)
    out, n = centres.copy(), np.zeros(len(centres), np.int64)
    for k, (m, _, s) in got.items():
        out[k], n[k] = s / m, m
    return out, n, sum(c for _, c, _ in got.values())


def lloyd(frame: MultiFrame, centres: np.ndarray, max_iterations: int, convergence: float) -> np.ndarray:
    for _ in range(max_iterations):
        new, _, _ = lloyd_step(frame, centres)
        moved = max((pairwise(frame.modalities, a[None], b[None])[0, 0] for a, b in zip(new, centres)), default=0.0)
        centres = new
        if moved < convergence:
            break
    return centres


class KMeans(Algorithm):
    def __init__(self, k: int, max_iterations: int = 20, init_steps: int = 2, convergence: float = 1e-7, seed: int = 0):
        check(k=k >= 2, max_iterations=max_iterations >= 1, init_steps=init_steps >= 1, convergence=convergence >= 0)
        super().__init__(k=k, max_iterations=max_iterations, init_steps=init_steps, convergence=convergence, seed=seed)

    def fit(self, frame: MultiFrame) -> CentreModel:
        p = self.params
        if frame.amount < p["k"]:
            raise RuntimeError(f"not enough rows for {p['k']} clusters")
        with kept(frame.df) as df:
            f = frame.like(df)
            return CentreModel(lloyd(f, self.start(f), p["max_iterations"], p["convergence"]), frame.modalities)

    def start(self, frame: MultiFrame) -> np.ndarray:
        """Parallel seeding: rounds that keep rows in proportion to their cost, then weighted k-means of those."""
        p, ms = self.params, frame.modalities
        k, seed = p["k"], p["seed"]
        centres = hash_order(frame.df, seed, 1, ms)
        for step in range(p["init_steps"]):
            total = lloyd_step(frame, centres)[2]
            if total <= 0:
                break
            now = centres

            def pick(batches, now=now, total=total):
                for b in batches:
                    x = blocks(b, ms)
                    u = (b.column("u").to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                    keep = np.flatnonzero(u < 2.0 * nearest(ms, x, now)[1] * k / total)
                    yield pa.RecordBatch.from_arrays([b.column(ID).take(pa.array(keep)), pa.array([x[i].tolist() for i in keep], pa.list_(pa.float64()))], names=[ID, "x"])

            slim = frame.df.select(F.col(ID).cast("long").alias(ID), *(m.name for m in ms), F.xxhash64(F.col(ID), F.lit(seed), F.lit(step)).alias("u"))
            new = slim.mapInArrow(pick, f"{ID} long, x array<double>").orderBy(ID).collect()
            if new:
                centres = np.concatenate([centres, np.array([r.x for r in new])])
        centres = np.unique(centres, axis=0) if len(centres) > k else centres
        if len(centres) <= k:
            return centres
        weights = lloyd_step(frame, centres)[1]
        return local_kmeans(centres, weights, k, max(1, p["max_iterations"] // 3), ms, seed)


class TreeModel(Model):
    """Greedy descent to the nearer child; leaves are numbered depth first."""

    def __init__(self, centres: dict[int, np.ndarray], modalities):
        self.centres, self.modalities = centres, tuple(modalities)
        self.leaves: dict[int, int] = {}

        def walk(i: int) -> None:
            kids = [c for c in (2 * i, 2 * i + 1) if c in centres]
            if not kids:
                self.leaves[i] = len(self.leaves)
            for c in kids:
                walk(c)

        walk(1)

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        return descend(self.modalities, x, self.centres)

    def labels_of(self, x: np.ndarray) -> np.ndarray:
        node = self.nodes_of(x)
        out = np.zeros(len(x), np.int64)
        for n, leaf in self.leaves.items():
            out[node == n] = leaf
        return out


def descend(modalities, x: np.ndarray, centres: dict[int, np.ndarray]) -> np.ndarray:
    at, todo = np.ones(len(x), np.int64), [1]
    while todo:
        i = todo.pop()
        kids = [c for c in (2 * i, 2 * i + 1) if c in centres]
        if kids:
            rows = np.flatnonzero(at == i)
            if len(rows):
                at[rows] = np.array(kids)[nearest(modalities, x[rows], np.array([centres[c] for c in kids]))[0]]
            todo += kids
    return at


class BisectingKMeans(Algorithm):
    def __init__(self, k: int, max_iterations: int = 20, min_cluster_size: float = 1.0, convergence: float = 1e-7, seed: int = 0):
        check(k=k >= 2, max_iterations=max_iterations >= 1, min_cluster_size=0 <= min_cluster_size <= 1, convergence=convergence >= 0)
        super().__init__(k=k, max_iterations=max_iterations, min_cluster_size=min_cluster_size, convergence=convergence, seed=seed)

    def fit(self, frame: MultiFrame) -> TreeModel:
        with kept(frame.df) as df:
            return self._fit(frame.like(df))

    def _summaries(self, frame: MultiFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[int, np.ndarray, float]]:
        """Node -> rows, mean and cost, of the leaves."""
        ms = frame.modalities

        def f(x, _):
            return np.arange(len(x)), descend(ms, x, centres), l2_rows(ms, x) ** 2

        return {i: (n, s / n, max(sq - n * float(l2_rows(ms, (s / n)[None])[0]) ** 2, 0.0)) for i, (n, sq, s) in sums_by(frame.df, ms, f).items()}

    def _fit(self, frame: MultiFrame) -> TreeModel:
        p, ms, r = self.params, frame.modalities, np.random.default_rng(self.params["seed"])
        if not frame.amount:
            raise RuntimeError("no rows")
        root = sums_by(frame.df, ms, lambda x, _: (np.arange(len(x)), np.ones(len(x), np.int64), l2_rows(ms, x) ** 2))[1]
        mean = root[2] / root[0]
        centres = {1: mean}
        active = {1: (root[0], mean, max(root[1] - root[0] * float(l2_rows(ms, mean[None])[0]) ** 2, 0.0))}
        least, needed, level = int(np.ceil(p["min_cluster_size"] * root[0])), p["k"] - 1, 1
        while active and needed > 0 and level < 62:
            split = [i for i, (n, _, cost) in active.items() if n >= least and cost > 1e-12 * n]
            split = sorted(split, key=lambda i: (-active[i][0], i))[:needed]
            if not split:
                break
            trial = dict(centres)
            for i in split:
                c = active[i][1]
                noise = r.random(len(c)) * 1e-4 * float(l2_rows(ms, c[None])[0])
                trial[2 * i], trial[2 * i + 1] = c - noise, c + noise
            for _ in range(p["max_iterations"]):
                got = self._summaries(frame, trial)
                moved = 0.0
                for i in split:
                    for c in (2 * i, 2 * i + 1):
                        if c in got:
                            moved = max(moved, float(pairwise(ms, trial[c][None], got[c][1][None])[0, 0]))
                            trial[c] = got[c][1]
                if moved < p["convergence"]:
                    break
            got = self._summaries(frame, trial)
            active, done = {}, 0
            for i in split:
                kids = [c for c in (2 * i, 2 * i + 1) if c in got]
                if len(kids) == 2:  # an empty child leaves its parent whole
                    done += 1
                    for c in kids:
                        centres[c], active[c] = trial[c], got[c]
            needed -= done
            level += 1
        return TreeModel(centres, ms)


class MeanShiftModel(CentreModel):
    """Nearest mode; with noise set, rows at least the radius away are noise."""

    def __init__(self, centres, modalities, radius: float):
        super().__init__(centres, modalities)
        self.radius, self.noise = radius, False

    def set_noise(self, on: bool) -> MeanShiftModel:
        self.noise = on
        return self

    def means(self) -> np.ndarray:
        return self.centres

    def labels_of(self, x: np.ndarray) -> np.ndarray:
        at, d = nearest(self.modalities, x, self.centres)
        return np.where(d >= self.radius, -1, at) if self.noise else at


def shift_step(frame: MultiFrame, centres: np.ndarray, radius: float) -> dict[int, tuple[int, np.ndarray]]:
    """Of each centre the number and mean of the rows within the radius; centres without any are left out."""
    ms = frame.modalities

    def f(x, _):
        d = pairwise(ms, x, centres)
        rows, at = np.nonzero(d <= radius)
        return rows, at, d[rows, at]

    return {k: (n, s / n) for k, (n, _, s) in sums_by(frame.df, ms, f).items()}


class MeanShift(Algorithm):
    def __init__(self, radius: float, max_clusters: int, max_iterations: int = 20, initial: int | None = None, convergence: float = 1e-7, seed: int = 0):
        initial = 2 * max_clusters if initial is None else initial
        check(radius=radius > 0, max_clusters=max_clusters >= 2, max_iterations=max_iterations >= 1, initial=initial >= 1, convergence=convergence >= 0)
        super().__init__(radius=radius, max_clusters=max_clusters, max_iterations=max_iterations, initial=initial, convergence=convergence, seed=seed)

    def fit(self, frame: MultiFrame) -> MeanShiftModel:
        p, ms = self.params, frame.modalities
        with kept(frame.df) as df:
            f = frame.like(df)
            now, done, heavy = hash_order(df, p["seed"], p["initial"], ms), [], []
            weights = np.ones(len(now), np.int64)
            for _ in range(p["max_iterations"]):
                if not len(now):
                    break
                moved = shift_step(f, now, p["radius"])
                rest = []
                for k, (n, mean) in sorted(moved.items()):
                    far = float(pairwise(ms, now[k][None], mean[None])[0, 0])
                    (rest if far > p["convergence"] else done).append((mean, n))
                now, weights = np.array([m for m, _ in rest]).reshape(len(rest), now.shape[1]), np.array([n for _, n in rest], np.int64)
            heavy = done + list(zip(now, weights.tolist()))
        modes = []
        for mean, _ in sorted(heavy, key=lambda m: -m[1]):
            if all(float(pairwise(ms, mean[None], o[None])[0, 0]) >= p["radius"] for o in modes):
                modes.append(mean)
        check_clusters(len(modes), p["max_clusters"])
        return MeanShiftModel(np.array(modes), ms, p["radius"])
