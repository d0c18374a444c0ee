"""DBSCAN by a range join of tiles.

Rows are packed into tiles by the box they are in (:mod:`mosaica.operators.boxes`), in an order that keeps near rows together. The bounds of
tiles tell the driver which pairs of them can't have rows within epsilon, of which pairs all rows are, and which have to be compared. A row is a core if at least ``min_points`` rows,
itself included, lie within epsilon; clusters are the connected components of cores within epsilon of each other. Pairs of tiles
send spanning forests, not all their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import DOUBT, blocks, paired, pairwise, within
from ..functions.tiles import ROWS, merge, over_pairs
from ..modality import ID, LABEL, NOISE, MultiFrame
from ..session import cut, numbered
from .base import Algorithm, LabelledModel, check, check_clusters
from .boxes import Boxes, boxes_of
from .components import components

SCHEMA = "tile long, box long, n int, ids binary, labels binary, x binary, first long, lo binary, hi binary"
#: Dimensions that order the rows of a box, and pairs of tiles whose bounds are worked out at a time.
ORDERED, STEP = 8, 2_000_000


def boxed(df: DataFrame, boxes: Boxes, label: str | None = None) -> DataFrame:
    """Tiles of rows of one box each."""
    modalities = boxes.ms

    widest = np.argsort(-(boxes.bounds[1] - boxes.bounds[0]) * np.maximum(boxes.scale, 1e-300), kind="stable")[:ORDERED]
    low, size = boxes.bounds[0][widest], np.maximum(boxes.bounds[1] - boxes.bounds[0], 1e-300)[widest]
    bits = 60 // max(1, len(widest)) if len(widest) > 1 else 30

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = blocks(b, modalities)
            at, z = np.clip((x[:, widest] - low) / size * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), np.zeros(len(x), np.int64)
            for k in range(bits - 1, -1, -1):  # the dimensions' bits in turn
                for d in range(len(widest)):
                    z = z << 1 | (at[:, d] >> k & 1)
            yield pa.RecordBatch.from_arrays([b.column(ID), b.column("__l"), pa.array(boxes.of(x)), pa.array(z), pa.array([v.tobytes() for v in x], pa.binary())], names=[ID, "l", "box", "z", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile = TaskContext.get().partitionId() << 32
        for b in batches:
            k = b.column("box").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            for s, e in zip(edges[:-1], edges[1:]):
                for t in range(s, e, ROWS):
                    part = b.slice(t, min(ROWS, e - t))
                    tile += 1
                    ids, x = part.column(ID).to_numpy(), b"".join(part.column("x").to_pylist())
                    v = np.frombuffer(x).reshape(len(ids), -1)
                    cols = [[tile], [int(k[t])], [len(ids)], [ids.tobytes()], [part.column("l").to_numpy().tobytes()], [x], [int(ids.min())], [v.min(0).tobytes()], [v.max(0).tobytes()]]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 2)
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, kinds)], names=["tile", "box", "n", "ids", "labels", "x", "first", "lo", "hi"])

    slim = df.select(F.col(ID).cast("long").alias(ID), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("__l"), *(m.name for m in modalities))
    rows = slim.mapInArrow(place, f"{ID} long, l long, box long, z long, x binary")
    return cut(rows.repartitionByRange("box", "z", ID).sortWithinPartitions("box", "z", ID).mapInArrow(pack, SCHEMA), "boxes")


class Bounds:
    """What the driver knows of tiles: number, rows, least ``_id`` and bounds."""

    def __init__(self, t: DataFrame, dim: int):
        got = t.select("tile", "n", "first", "lo", "hi").orderBy("tile").toArrow()
        self.tile, self.n, self.first = (got.column(c).to_numpy() for c in ("tile", "n", "first"))
        self.lo, self.hi = (np.array([np.frombuffer(v.as_buffer()) for v in got.column(c)]).reshape(len(got), dim) for c in ("lo", "hi"))


def near_tiles(a: Bounds, b: Bounds, boxes: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """``(pairs, 2)`` places of tiles: those of which some rows may be within epsilon, and those of which all are."""
    some, every = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    step = max(1, STEP // max(1, len(b.n)))
    for s in range(0, len(a.n), step):
        least, most = boxes.apart(a.lo[s : s + step], a.hi[s : s + step], b.lo, b.hi)
        near, sure = least <= boxes.epsilon**2 * (1 + 1e-9), most <= boxes.epsilon**2 * (1 - 1e-9)
        for out, on in ((some, near & ~sure), (every, sure)):
            i, j = np.nonzero(on)
            out.append(np.stack([i + s, j], axis=1))
    return np.concatenate(some), np.concatenate(every)


def near_pairs(left: DataFrame, right: DataFrame, boxes: Boxes, f, schema: str, once: bool = False, pairs: tuple[Bounds, Bounds, np.ndarray] | None = None) -> DataFrame:
    """``f`` over the pairs of tiles of which some rows may be within epsilon, or over ``pairs``."""
    if pairs is None:
        dim = sum(m.dim for m in boxes.ms)
        a = Bounds(left, dim)
        b = a if right is left else Bounds(right, dim)
        pairs = a, b, np.concatenate(near_tiles(a, b, boxes))
    a, b, at = pairs
    where = None
    if len(at) < len(a.n) * len(b.n):
        at = at[np.lexsort((at[:, 1], at[:, 0]))]
        i, first = np.unique(at[:, 0], return_index=True)
        met = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(b.tile[at[:, 1]]))
        left = left.join(F.broadcast(left.sparkSession.createDataFrame(pa.table({"tile": pa.array(a.tile[i], pa.int64()), "met": met}))), "tile")
        where = "array_contains(met, tile_2)"
        left, right = left.select("tile", "n", "ids", "labels", "x", "met"), right.select("tile", "n", "ids", "labels", "x")
    return over_pairs(left, boxes.ms, f, schema, once, right, where)


def neighbour_counts(frame: MultiFrame, epsilon: float, boxes: Boxes | None = None) -> DataFrame:
    """``(_id, neighbours)``: rows within epsilon of each row, itself included."""
    ms, boxes = frame.modalities, boxes_of(frame, epsilon) if boxes is None else boxes
    t = boxed(frame.df, boxes)
    tiles = Bounds(t, frame.global_dim)
    some, every = near_tiles(tiles, tiles, boxes)
    sure = np.zeros(len(tiles.n), np.int64)
    np.add.at(sure, every[:, 0], tiles.n[every[:, 1]])
    known = t.sparkSession.sparkContext.broadcast((tiles.tile, sure))

    def run(pairs) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for a, b in pairs:
            near = within(ms, a.x, b.x, epsilon)
            for o, axis in ((a, 1), (b, 0))[: 1 + (a.tile != b.tile)]:
                merge(held, o, (np.add, near.sum(axis)))
        for ids, n in held.values():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit].astype(np.int64))], names=["id", "n"])

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = known.value
        for b in batches:
            for tile, ids in zip(b.column("tile").to_pylist(), b.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), n[np.searchsorted(at, tile)]))], names=["id", "n"])

    counted = near_pairs(t, t, boxes, run, "id long, n long", True, (tiles, tiles, some))
    if len(every):
        counted = counted.unionByName(t.select("tile", "ids").mapInArrow(all_of, "id long, n long"))
    return counted.groupBy(F.col("id").alias(ID)).agg(F.sum("n").alias("neighbours"))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


class DBSCANModel(LabelledModel):
    """The labelled frame; new rows are labelled by their neighbours in it."""

    def __init__(self, frame: MultiFrame, boxes: Boxes, min_points: int, border_noise: bool):
        super().__init__(frame)
        self.boxes, self.epsilon, self.min_points, self.border_noise = boxes, boxes.epsilon, min_points, border_noise

    @property
    def dataframe(self) -> MultiFrame:
        return self.frame

    def predict(self, frame: MultiFrame) -> MultiFrame:
        """The majority cluster among a row's clustered neighbours if it has ``min_points - 1`` of them (or borders count); else noise."""
        ms, eps = self.modalities, self.epsilon
        new, old = boxed(frame.df, self.boxes), boxed(self.frame.df.where(F.col(LABEL) != NOISE), self.boxes, LABEL)

        def run(pairs) -> Iterator[pa.RecordBatch]:
            for a, b in pairs:
                i, j = np.nonzero(within(ms, a.x, b.x, eps))
                if len(i):
                    both, n = np.unique(np.stack([i, b.labels[j]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[both[0]]), pa.array(both[1]), pa.array(n)], names=["id", "l", "n"])

        votes = near_pairs(new, old, self.boxes, run, "id long, l long, n long").groupBy("id", "l").agg(F.sum("n").alias("n"))
        won = votes.groupBy("id").agg(F.sum("n").alias("all"), F.max_by("l", F.struct("n", -F.col("l"))).alias("l"))
        label = F.when((F.col("all") >= self.min_points - 1) | F.lit(not self.border_noise), F.col("l")).otherwise(NOISE)
        out = frame.df.join(won, F.col(ID) == F.col("id"), "left").withColumn(LABEL, F.coalesce(label, F.lit(NOISE)).cast("int"))
        return frame.like(out.drop("id", "all", "l"))


class DBSCAN(Algorithm):
    """``border_noise``: whether rows near a core that are none themselves are noise; else they go to the cluster of
    the nearest core (of equal ones the least ``_id``). ``points_in_box``, ``levels`` and ``axis_splits`` say how boxes are split; the
    clusters don't depend on them.
    """

    def __init__(self, epsilon: float, min_points: int, border_noise: bool = True, max_clusters: int | None = None, points_in_box: int | None = None, levels: int | None = None, axis_splits: int = 2):
        check(epsilon=epsilon > 0, min_points=min_points >= 1, points_in_box=points_in_box is None or points_in_box >= 1, levels=levels is None or levels >= 0, max_clusters=max_clusters is None or max_clusters >= 2, axis_splits=axis_splits >= 2)
        super().__init__(epsilon=epsilon, min_points=min_points, border_noise=border_noise, max_clusters=max_clusters, points_in_box=points_in_box, levels=levels, axis_splits=axis_splits)

    def boxes(self, frame: MultiFrame) -> Boxes:
        p = self.params
        return boxes_of(frame, p["epsilon"], p["points_in_box"], p["levels"], p["axis_splits"])

    def labels(self, frame: MultiFrame, boxes: Boxes | None = None) -> DataFrame:
        """``(_id, _label, core)``; clusters are numbered by their least core. However many there are, also one or none."""
        p, ms, eps = self.params, frame.modalities, self.params["epsilon"]
        boxes = boxes if boxes is not None else self.boxes(frame)
        counts = cut(neighbour_counts(frame, eps, boxes), "neighbours")
        core = counts.where(F.col("neighbours") >= p["min_points"]).select(ID)
        cores = boxed(frame.df.join(core, ID, "left_semi"), boxes)

        def edges(pairs) -> Iterator[pa.RecordBatch]:
            for a, b in pairs:
                i, j = np.nonzero(within(ms, a.x, b.x, eps))
                if not len(i):
                    continue
                same = a.tile == b.tile
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                order = np.argsort(ids)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                lab = _forest(rank[i], rank[j if same else j + a.n], len(ids))
                moved = np.flatnonzero(lab != np.arange(len(ids)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[order][moved]), pa.array(ids[order][lab[moved]])], names=["u", "v"])

        tiles = Bounds(cores, frame.global_dim)
        some, every = near_tiles(tiles, tiles, boxes)
        links = near_pairs(cores, cores, boxes, edges, "u long, v long", True, (tiles, tiles, some))
        if len(every):
            lab = _forest(every[:, 0], every[:, 1], len(tiles.n))
            known = cores.sparkSession.sparkContext.broadcast(tiles.tile[np.unique(every)])

            def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for tile, ids in zip(b.column("tile").to_pylist(), b.column("ids")):
                        if tile == known.value[min(np.searchsorted(known.value, tile), len(known.value) - 1)]:
                            ids = np.sort(np.frombuffer(ids.as_buffer(), np.int64))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[1:]), pa.array(np.full(len(ids) - 1, ids[0]))], names=["u", "v"])

            moved = np.flatnonzero(lab != np.arange(len(lab)))
            ends = np.sort(np.stack([tiles.first[moved], tiles.first[lab[moved]]], axis=1), axis=1)
            joined = cores.sparkSession.createDataFrame(pa.table({"u": pa.array(ends[:, 1], pa.int64()), "v": pa.array(ends[:, 0], pa.int64())}))
            links = links.unionByName(cores.select("tile", "ids").mapInArrow(together, "u long, v long")).unionByName(joined)
        comp = components(links)
        rooted = core.join(comp, F.col(ID) == F.col("node"), "left").select(ID, F.coalesce("root", ID).alias("root"))
        number = numbered(rooted.select("root").distinct(), "root", "__k")
        labelled = cut(rooted.join(number, "root").select(ID, F.col("__k").cast("int").alias(LABEL)), "cores")
        out = counts.select(ID).join(labelled.withColumn("core", F.lit(True)), ID, "left")
        if p["border_noise"]:
            near = None
        else:
            rest = boxed(frame.df.join(core, ID, "left_anti"), boxes)

            def nearest(pairs) -> Iterator[pa.RecordBatch]:
                for a, b in pairs:
                    d = pairwise(ms, a.x, b.x)
                    i, j = np.nonzero(d <= np.minimum(d.min(1), eps)[:, None] * (1 + DOUBT) + DOUBT * eps)
                    m = paired(ms, a.x[i], b.x[j])
                    order = np.lexsort((b.ids[j], m, i))
                    i, j, m = i[order], j[order], m[order]
                    hit = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])) & (m <= eps)) if len(i) else i
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(a.ids[i[hit]]), pa.array(b.ids[j[hit]]), pa.array(m[hit])], names=["id", "of", "d"])

            best = near_pairs(rest, cores, boxes, nearest, "id long, of long, d double").groupBy("id").agg(F.min_by("of", F.struct("d", "of")).alias("of"))
            near = best.join(labelled, F.col("of") == F.col(ID)).select(F.col("id").alias("__b"), F.col(LABEL).alias("__bl"))
        if near is not None:
            out = out.join(near, F.col(ID) == F.col("__b"), "left").withColumn(LABEL, F.coalesce(LABEL, "__bl"))
        return out.select(ID, F.coalesce(LABEL, F.lit(NOISE)).cast("int").alias(LABEL), F.coalesce("core", F.lit(False)).alias("core"))

    def fit(self, frame: MultiFrame) -> DBSCANModel:
        p, boxes = self.params, self.boxes(frame)
        labels = cut(self.labels(frame, boxes).drop("core"), "labels")
        check_clusters(labels.where(F.col(LABEL) != NOISE).select(LABEL).distinct().count(), p["max_clusters"])
        return DBSCANModel(frame.like(frame.df.join(labels, ID)), boxes, p["min_points"], p["border_noise"])
