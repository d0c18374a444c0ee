"""Rows packed into tiles, and all pairs of rows as pairs of tiles inside Arrow UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..modality import ID, Modality
from ..session import cut
from .distances import blocks

#: Rows of a tile, and right tiles of a task.
ROWS, RUN = 512, 64
SCHEMA = "tile long, n int, ids binary, labels binary, x binary"


def tiles(df: DataFrame, modalities: Sequence[Modality], label: str | None = None) -> DataFrame:
    """``(tile, n, ids, labels, x)`` of a prepared frame; without ``label`` all labels are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                k += 1
                cols = [[base + k], [part.num_rows], [part.column(ID).to_numpy().astype(np.int64).tobytes()], [part.column("__l").to_numpy().astype(np.int64).tobytes()], [np.ascontiguousarray(blocks(part, modalities)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["tile", "n", "ids", "labels", "x"])

    slim = df.select(F.col(ID).cast("long").alias(ID), (F.col(label).cast("long") if label else F.lit(0).cast("long")).alias("__l"), *(m.name for m in modalities))
    return cut(slim.mapInArrow(run, SCHEMA), "tiles")


class Tile:
    """One side of a pair."""

    def __init__(self, b: pa.RecordBatch, k: int, tag: str, dim: int):
        self.tile, self.n = b.column(f"tile{tag}")[k].as_py(), b.column(f"n{tag}")[k].as_py()
        self.ids, self.labels = (np.frombuffer(b.column(f"{c}{tag}")[k].as_buffer(), np.int64) for c in ("ids", "labels"))
        self.x = np.frombuffer(b.column(f"x{tag}")[k].as_buffer()).reshape(self.n, dim)


def merge(held: dict[int, list], t: Tile, *parts: tuple[np.ufunc, np.ndarray]) -> None:
    """What a task knows of a tile's rows, with another part: ``held`` has their identifiers and the parts so far, as each ufunc joins them."""
    if t.tile not in held:
        held[t.tile] = [t.ids, *(np.array(v, float) for _, v in parts)]
        return
    for old, (join, v) in zip(held[t.tile][1:], parts):
        join(old, v, out=old)


def over_pairs(t: DataFrame, modalities: Sequence[Modality], f: Callable[[Iterator[tuple[Tile, Tile]]], Iterator[pa.RecordBatch]], schema: str, once: bool = False, other: DataFrame | None = None, where: str | None = None) -> DataFrame:
    """``f`` over all pairs of tiles that a task has; ``once``: each unordered pair once, by parity so that both halves share the work.

    Tasks hold runs of the left tiles and of the right ones, so that ``f`` may add up by tile: its output then grows with the rows times
    the runs of right tiles, each of :data:`RUN`. ``where`` is a condition on both sides that the JVM checks before it sends a pair.
    """
    dim = sum(m.dim for m in modalities)
    tasks = t.sparkSession.sparkContext.defaultParallelism
    right = t if other is None else other
    left, runs = t.repartition(2 * tasks), max(1, math.ceil(right.count() / RUN))
    right = right.select(*(F.col(c).alias(f"{c}_2") for c in right.columns))
    right = right.repartition(runs) if runs > right.rdd.getNumPartitions() else right.coalesce(runs)
    pairs = left.crossJoin(right)
    if once:
        pairs = pairs.where("tile = tile_2 or ((tile < tile_2) = (abs(tile - tile_2) % 2 = 1))")
    if where:
        pairs = pairs.where(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f((Tile(b, k, "", dim), Tile(b, k, "_2", dim)) for b in batches for k in range(b.num_rows))

    return pairs.mapInArrow(run, schema)
