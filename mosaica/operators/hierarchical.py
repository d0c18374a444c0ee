"""BIRCH and CURE: groups of rows are summarised on the executors, and summaries merged with others until one is left.

A row's group follows from a hash of its ``_id`` and the number of rows, so the clusters don't depend on partitions. A task holds one
group, or the summaries of a few; the driver gets the last summary only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import blocks, nearest, pairwise
from ..modality import ID, MultiFrame
from ..session import cut
from .base import Algorithm, CentreModel, check, kept
from .kmeans import lloyd, local_kmeans

#: Bytes that a CF-tree's entries may take before it is built again with a greater threshold.
TREE_MEMORY = 64 << 20
SEED = 5


def summaries(frame: MultiFrame, group_rows: int, first: Callable[[np.ndarray], pa.Table], merge: Callable[[pa.Table], pa.Table], schema: str, fan: int) -> list:
    """Rows of the last summary. ``first`` summarises the flat vectors of a group of about ``group_rows``, in the order of ``_id``; ``merge`` the summaries of ``fan`` groups, in the order of ``at``, which ``schema`` starts with."""
    ms, groups = frame.modalities, max(1, -(-frame.amount // group_rows))
    number = F.pmod(F.xxhash64(F.col(ID), F.lit(SEED)), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
    slim = frame.df.select(ID, *(m.name for m in ms), number.alias("at"))

    def ranked(t: pa.Table, at: int) -> pa.Table:
        return t.add_column(0, "at", pa.array(np.arange(len(t)) + at * (1 << 32)))

    def start(t: pa.Table) -> pa.Table:
        t = t.sort_by(ID).combine_chunks()
        return ranked(first(blocks(t.to_batches()[0], ms)), t.column("at")[0].as_py())

    def on(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return ranked(merge(t.drop_columns(["g", "at"])), t.column("g")[0].as_py())

    now = slim.groupBy("at").applyInArrow(start, schema)
    while True:
        now = cut(now, "summaries")
        if groups == 1:
            return now.orderBy("at").collect()
        groups = -(-groups // fan)
        now = now.withColumn("g", F.floor(F.shiftright("at", 32) / fan)).groupBy("g").applyInArrow(on, schema)


class CFNode:
    """Up to ``branches`` entries (rows, sum), each with a child node except in leaves."""

    def __init__(self, dim: int):
        self.n, self.sums, self.children = np.zeros(0), np.zeros((0, dim)), []

    @property
    def leaf(self) -> bool:
        return not self.children

    @property
    def means(self) -> np.ndarray:
        return self.sums / self.n[:, None]

    def append(self, n: float, s: np.ndarray, child: CFNode | None = None) -> None:
        self.n, self.sums = np.append(self.n, n), np.concatenate([self.sums, s[None]])
        if child:
            self.children.append(child)


class CFTree:
    """``most``: entries beyond which the tree is built again, with the mean distance of the leaves' closest entries as threshold, at least twice as much as before."""

    def __init__(self, modalities, branches: int, threshold: float, most: int | None = None):
        self.ms, self.branches, self.threshold = modalities, branches, threshold
        self.dim = sum(m.dim for m in modalities)
        self.most = TREE_MEMORY // (8 * (self.dim + 1)) if most is None else most
        self.root, self.size = CFNode(self.dim), 0

    def insert(self, n: float, s: np.ndarray) -> None:
        halves = self._insert(self.root, n, s)
        if halves:
            self.root = CFNode(self.dim)
            for h in halves:
                self.root.append(h.n.sum(), h.sums.sum(0), h)
        if self.size > self.most:
            self._rebuild()

    def _insert(self, node: CFNode, n: float, s: np.ndarray) -> tuple[CFNode, CFNode] | None:
        k, d = (int(v[0]) if i == 0 else float(v[0]) for i, v in enumerate(nearest(self.ms, (s / n)[None], node.means))) if len(node.n) else (-1, np.inf)
        if node.leaf:
            if d <= self.threshold:
                node.n[k] += n
                node.sums[k] += s
                return None
            node.append(n, s)
            self.size += 1
        else:
            halves = self._insert(node.children[k], n, s)
            if not halves:
                node.n[k] += n
                node.sums[k] += s
                return None
            node.children[k], node.n[k], node.sums[k] = halves[0], halves[0].n.sum(), halves[0].sums.sum(0)
            node.append(halves[1].n.sum(), halves[1].sums.sum(0), halves[1])
        return self._split(node) if len(node.n) > self.branches else None

    def _split(self, node: CFNode) -> tuple[CFNode, CFNode]:
        """By the two entries farthest from each other."""
        d = pairwise(self.ms, node.means, node.means)
        i, j = divmod(int(d.argmax()), len(d))
        left = d[i] <= d[j]
        left[i], left[j] = True, False
        out = []
        for side in (left, ~left):
            h = CFNode(self.dim)
            h.n, h.sums, h.children = node.n[side], node.sums[side], [c for c, x in zip(node.children, side) if x]
            out.append(h)
        return out[0], out[1]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        todo, n, s = [self.root], [], []
        while todo:
            node = todo.pop()
            if node.leaf:
                n.append(node.n)
                s.append(node.sums)
            todo += node.children
        return np.concatenate(n), np.concatenate(s)

    def _leaves(self) -> list[CFNode]:
        todo, out = [self.root], []
        while todo:
            node = todo.pop()
            todo += node.children
            if node.leaf and len(node.n):
                out.append(node)
        return out

    def _rebuild(self) -> None:
        closest = []
        for leaf in self._leaves():
            if len(leaf.n) > 1:
                d = pairwise(self.ms, leaf.means, leaf.means)
                closest.append(d[np.triu_indices(len(d), 1)].min())
        n, s = self.entries()
        self.threshold = max(2 * self.threshold, float(np.mean(closest)) if closest else 0.0, 1e-6)
        self.root, self.size = CFNode(self.dim), 0
        for a, b in zip(n, s):
            self.insert(a, b)


class Birch(Algorithm):
    """A CF-tree for each group of rows, trees merged with others, weighted k-means of the last one's leaf entries, then k-means rounds over the rows.

    ``group_rows``: rows of a group; ``memory``: bytes of a tree's entries, beyond which its threshold rises. Both are the same whatever the
    partitions, and with ``threshold`` 0 every row that fits is an entry of its own.
    """

    def __init__(self, k: int, max_branches: int = 50, threshold: float = 0.0, max_iterations: int = 20, seed: int = 0, group_rows: int = 10_000, memory: int = TREE_MEMORY):
        check(k=k >= 2, max_branches=max_branches >= 2, threshold=threshold >= 0, max_iterations=max_iterations >= 1, group_rows=group_rows >= 1, memory=memory >= 1024)
        super().__init__(k=k, max_branches=max_branches, threshold=threshold, max_iterations=max_iterations, seed=seed, group_rows=group_rows, memory=memory)

    def entries(self, frame: MultiFrame) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums of the leaf entries of the last tree."""
        p, ms = self.params, frame.modalities
        most = max(2 * p["k"], p["memory"] // (8 * (frame.global_dim + 1)))

        def built(n: np.ndarray, s: np.ndarray, threshold: float) -> pa.Table:
            tree = CFTree(ms, p["max_branches"], threshold, most)
            for a, x in zip(n, s):
                tree.insert(a, x)
            n, s = tree.entries()
            return pa.table({"n": n, "s": pa.array([v.tobytes() for v in s], pa.binary()), "threshold": np.full(len(n), tree.threshold)})

        def merge(t: pa.Table) -> pa.Table:
            s = np.array([np.frombuffer(x.as_buffer()) for x in t.column("s")])
            return built(t.column("n").to_numpy(), s, float(t.column("threshold").to_numpy().max()))

        rows = summaries(frame, p["group_rows"], lambda x: built(np.ones(len(x)), x, p["threshold"]), merge, "at long, n double, s binary, threshold double", 8)
        return np.array([r.n for r in rows]), np.array([np.frombuffer(r.s) for r in rows])

    def fit(self, frame: MultiFrame) -> CentreModel:
        p, ms = self.params, frame.modalities
        if frame.amount < p["k"]:
            raise RuntimeError(f"not enough rows for {p['k']} clusters")
        with kept(frame.df) as df:
            n, s = self.entries(frame.like(df))
            centres = local_kmeans(s / n[:, None], n, p["k"], p["max_iterations"], ms, p["seed"])
            return CentreModel(lloyd(frame.like(df), centres, p["max_iterations"], 1e-7), ms)


def scattered(x: np.ndarray, mean: np.ndarray, most: int, modalities) -> np.ndarray:
    """Up to ``most`` points: the farthest from the mean, then each the farthest from those."""
    at = [int(pairwise(modalities, x, mean[None])[:, 0].argmax())]
    d = pairwise(modalities, x, x[at])[:, 0]
    while len(at) < min(most, len(x)) and d.max() > 0:
        at.append(int(d.argmax()))
        d = np.minimum(d, pairwise(modalities, x, x[at[-1:]])[:, 0])
    return x[at]


class Bunch:
    """A cluster on the way: its points, its representatives, the mean and number of its rows."""

    def __init__(self, points: np.ndarray, reps: np.ndarray, mean: np.ndarray, n: int):
        self.points, self.reps, self.mean, self.n = points, reps, mean, n

    def with_(self, other: Bunch, most: int, shrink: float, modalities) -> Bunch:
        """Representatives are scattered over all points and moved towards the mean once."""
        points, n = np.concatenate([self.points, other.points]), self.n + other.n
        mean = (self.mean * self.n + other.mean * other.n) / n
        reps = scattered(points, mean, most, modalities) if len(points) > most else points
        return Bunch(points, reps + shrink * (mean - reps), mean, n)


def agglomerate(bunches: list[Bunch], k: int, most: int, shrink: float, modalities, drop_below: int = 0) -> list[Bunch]:
    """Merges the two closest clusters until ``k`` are left; with ``drop_below``, clusters of fewer representatives don't count.

    Clusters are as far apart as their closest representatives. Each has its nearest other in an array, and a heap gives the closest pair;
    of equal ones that of the earliest clusters. After a merger only those are looked at again whose nearest is gone.
    """
    c: list[Bunch | None] = list(bunches)
    slot = np.concatenate([b.reps for b in bunches])
    owner = np.repeat(np.arange(len(c)), [len(b.reps) for b in bunches])
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    m = np.minimum.reduceat(np.minimum.reduceat(pairwise(modalities, slot, slot), first, axis=0), first, axis=1)
    np.fill_diagonal(m, np.inf)
    near = m.argmin(1)
    heap = [(float(m[i, near[i]]), i, int(near[i])) for i in range(len(c))]
    heapq.heapify(heap)
    alive, counted = len(c), sum(len(b.reps) >= drop_below for b in c)
    while counted > k and alive > 1:
        d, i, j = heapq.heappop(heap)
        if c[i] is None or c[j] is None or near[i] != j or m[i, j] != d:
            continue  # from before a merger
        i, j = min(i, j), max(i, j)
        old, new = (c[i], c[j]), c[i].with_(c[j], most, shrink, modalities)
        c[i], c[j] = new, None
        alive -= 1
        counted += int(len(new.reps) >= drop_below) - sum(len(b.reps) >= drop_below for b in old)
        own = np.flatnonzero((owner == i) | (owner == j))  # at least as many as the new representatives
        owner[own] = -1
        owner[own[: len(new.reps)]] = i
        slot[own[: len(new.reps)]] = new.reps
        to = pairwise(modalities, new.reps, slot).min(0)
        row = np.full(len(c), np.inf)
        live = owner >= 0
        np.minimum.at(row, owner[live], to[live])
        row[i] = np.inf
        m[j, :] = m[:, j] = np.inf
        m[i, :] = m[:, i] = row
        there = np.array([b is not None for b in c])
        lost = there & ((near == i) | (near == j))
        closer = there & ~lost & (row < m[np.arange(len(c)), near])
        lost[i], closer[i] = alive > 1, False
        near[closer] = i
        for o in np.flatnonzero(lost).tolist():
            near[o] = m[o].argmin()
        for o in np.flatnonzero(lost | closer).tolist():
            heapq.heappush(heap, (float(m[o, near[o]]), o, int(near[o])))
    return [b for b in c if b is not None]


class CURE(Algorithm):
    """Rows are agglomerated in groups, and the groups' clusters with others' until one group is left.

    ``group_rows``: rows that are agglomerated at once (and, divided by ``k``, the groups whose clusters are); more rows find the clusters
    of all at the cost of their square. What goes on from a group is up to ``representatives`` scattered points of each cluster, its
    representatives, mean and number of rows. With ``remove_outliers`` clusters of fewer than ``representatives`` points are
    dropped when a group is down to twice ``k``, and at the end; if that leaves none, the largest stay.
    """

    def __init__(self, k: int, representatives: int = 10, shrink_factor: float = 0.3, remove_outliers: bool = False, group_rows: int = 1000):
        check(k=k >= 2, representatives=representatives >= 1, shrink_factor=0 < shrink_factor < 1, group_rows=group_rows >= 2 * k)
        super().__init__(k=k, representatives=representatives, shrink_factor=shrink_factor, remove_outliers=remove_outliers, group_rows=group_rows)

    def fit(self, frame: MultiFrame) -> CentreModel:
        p, ms, dim = self.params, frame.modalities, frame.global_dim
        k, most, shrink, drop, rows = p["k"], p["representatives"], p["shrink_factor"], p["remove_outliers"], p["group_rows"]

        def down(c: list[Bunch], last: bool) -> pa.Table:
            if drop and not last and len(c) > k:
                c = agglomerate(c, 2 * k, most, shrink, ms)
                c = [b for b in c if len(b.reps) >= most] or c
            if len(c) > k:
                c = agglomerate(c, k, most, shrink, ms, most if drop and last else 0)
            points = [scattered(b.points, b.mean, most, ms) if len(b.points) > most else b.points for b in c]
            return pa.table({"p": pa.array([x.tobytes() for x in points], pa.binary()), "r": pa.array([b.reps.tobytes() for b in c], pa.binary()), "m": pa.array([b.mean.tobytes() for b in c], pa.binary()), "n": pa.array([b.n for b in c], pa.int64())})

        def bunches(t) -> list[Bunch]:
            of = lambda x: np.frombuffer(bytes(x)).reshape(-1, dim)
            return [Bunch(of(r["p"]), of(r["r"]), of(r["m"])[0], r["n"]) for r in t]

        one = frame.amount <= rows
        got = summaries(frame, rows, lambda x: down([Bunch(v[None], v[None], v, 1) for v in x], one), lambda t: down(bunches(t.to_pylist()), True), "at long, p binary, r binary, m binary, n long", max(2, rows // k))
        c = bunches([r.asDict() for r in got])
        if not c:
            raise RuntimeError("no rows")
        if drop:
            c = sorted([b for b in c if len(b.reps) >= most] or c, key=lambda b: -b.n)[:k]
        return CentreModel(np.concatenate([b.reps for b in c]), ms, np.repeat(np.arange(len(c)), [len(b.reps) for b in c]))
