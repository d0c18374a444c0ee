"""Exact top-k neighbours by distributed histogram selection.

The queries are the rows whose identifier is divisible by ``every`` (100; with 1 all rows), the candidates all rows.
Vectors are packed into tiles, and each pair of a tile of queries and one of candidates is scored with one matrix
product; a score is the cosine as a whole number of 1e-9. Rounds of histograms locate each query's kth score: a round
counts the scores of the query's present range in 2048 bins, over all candidates, and the range becomes the bin in which
the kth falls. A task sends, of each query, only the bins down to its own kth score, which is no higher than the global
one. When every range holds few scores or is a single one, scores at or above it are filtered and ranked by score, then
identifier. The work is queries times rows.

Defined cases: a row without identifier (or with one that is no integer) or vector, or with a null, infinite or NaN
coordinate, is left out; rows are candidates only for queries of the same length; an empty or zero vector has cosine 0
with all; a row is no candidate for its own identifier; repeated rows are answered alike and each is a candidate; with
fewer than k candidates all are given; equal scores go by identifier; an empty table, or one without queries, gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 10
#: Rows whose identifier is divisible by this are the queries.
EVERY = 100
TILE = 1024
UNIT = 10**9
#: Scores are whole numbers below 2**SPAN; each round fixes BITS of them.
SPAN, BITS = 33, 11
BINS = 1 << BITS
#: A range is left as it is when no more scores than this many times k are in it or above. Speed only depends on it.
SLACK = 16
#: Tiles of queries whose histograms a task holds at a time.
HELD = 8


def _tiles(vectors: DataFrame, key: str, vector: str, every: int = 1) -> DataFrame:
    """``(tile, dim, n, ids, unit)``: up to :data:`TILE` vectors of unit length, of the rows whose identifier is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, held = TaskContext.get().partitionId() << 32, 0, {}

        def out(dim: int, n: int) -> pa.RecordBatch:
            nonlocal k
            ids, vs = zip(*held[dim][:n])
            held[dim] = held[dim][n:]
            v = np.array(vs, np.float64).reshape(n, dim)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([dim], pa.int32()), pa.array([n], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([v.tobytes()])], names=["tile", "dim", "n", "ids", "unit"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                held.setdefault(len(v), []).append((i, v))
            for dim in list(held):
                while len(held[dim]) >= TILE:
                    yield out(dim, TILE)
        for dim in list(held):
            if held[dim]:
                yield out(dim, len(held[dim]))

    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull()).where(fine).select(F.expr(f"try_cast(`{key}` as long)").alias("id"), v.alias("v")).where("id is not null").where(f"id % {int(every)} = 0").mapInArrow(run, "tile long, dim int, n int, ids binary, unit binary")


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores above 0 of a tile's queries (rows) with another's candidates; 0 where the identifiers are the same."""
    a, b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids2"], np.int64)
    u, v = (np.frombuffer(row[c]).reshape(len(i), row["dim"]) for c, i in (("unit", a), ("unit2", b)))
    s = np.rint(np.clip(u @ v.T, -1, 1) * UNIT).astype(np.int64) + (UNIT + 1)
    s[a[:, None] == b[None, :]] = 0
    return a, b, s


def _from_top(bins: np.ndarray, counts: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Of entries sorted by query and descending bin: those before the query's running count reached ``k``."""
    total = np.cumsum(counts)
    first = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, total - counts, 0))
    return total - counts - base < k


STATE = "tile long, low binary, above binary, level int, open long"


def _histograms(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for tile, hist in held.items():
            q, bins = np.nonzero(hist[:, ::-1])
            c = hist[:, ::-1][q, bins]
            keep = _from_top(bins, c, q, k)
            yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([q[keep].astype(np.int32).tobytes()]), pa.array([(BINS - 1 - bins[keep]).astype(np.uint16).tobytes()]), pa.array([c[keep].astype(np.int64).tobytes()])], names=["tile", "q", "bins", "counts"])
        held.clear()

    for b in batches:
        for row in b.to_pylist():
            _, _, s = _scores(row)
            low, shift = np.frombuffer(row["low"], np.int64), SPAN - BITS * (row["level"] + 1)
            x = (s - low[:, None]) >> shift
            ok = (s > 0) & (x >= 0) & (x < BINS)
            q, _ = np.nonzero(ok)
            h = np.bincount(q * BINS + x[ok], minlength=BINS * len(low)).reshape(-1, BINS)
            if row["tile"] in held:
                held[row["tile"]] += h
            else:
                if len(held) >= HELD:
                    yield from out()
                held[row["tile"]] = h
    yield from out()


def _narrow(k: int):
    def run(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1).to_pylist()[0]
        low, above, level = np.frombuffer(first["low"], np.int64).copy(), np.frombuffer(first["above"], np.int64).copy(), first["level"]
        hist = np.zeros((len(low), BINS), np.int64)
        for r in t.select(["q", "bins", "counts"]).to_pylist():
            if r["q"] is not None:
                np.add.at(hist, (np.frombuffer(r["q"], np.int32), np.frombuffer(r["bins"], np.uint16)), np.frombuffer(r["counts"], np.int64))
        down = np.cumsum(hist[:, ::-1], axis=1) + above[:, None]
        reached = down >= k
        at = np.where(reached.any(1), reached.argmax(1), BINS - 1)  # with fewer than k candidates, the lowest bin
        rows = np.arange(len(low))
        upto = down[rows, at]
        low += (BINS - 1 - at) << (SPAN - BITS * (level + 1))
        above = np.where(at > 0, down[rows, np.maximum(at - 1, 0)], above)
        return pa.table({"tile": [first["tile"]], "low": [low.tobytes()], "above": [above.tobytes()], "level": pa.array([level + 1], pa.int32()), "open": [int((upto > SLACK * k).sum())]})

    return run


def _filtered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids, ids2, s = _scores(row)
            q, c = np.nonzero((s > 0) & (s >= np.frombuffer(row["low"], np.int64)[:, None]))
            if not len(q):
                continue
            score = s[q, c]
            order = np.lexsort((ids2[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            keep = _from_top(score, np.ones(len(q), np.int64), q, k)
            q, c, score = q[keep], c[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["tile"])), pa.array(q.astype(np.int64)), pa.array(ids[q]), pa.array(ids2[c]), pa.array(score - (UNIT + 1))], names=["tile", "q", "id", "neighbour", "score"])


def top_k(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """``(<key>, neighbour_id, rank, similarity)``: every query's k most similar rows by cosine, rounded to 1e-6."""
    tiles = cut(_tiles(vectors, key, vector, every), "queries")
    every_row = cut(_tiles(vectors, key, vector), "tiles")
    other = every_row.select(*(F.col(c).alias(f"{c}2") for c in every_row.columns))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_pylist()
            zero = [np.zeros(x, np.int64).tobytes() for x in n]
            yield pa.RecordBatch.from_arrays([b.column("tile"), pa.array(zero, pa.binary()), pa.array(zero, pa.binary()), pa.array([0] * len(n), pa.int32()), b.column("n").cast(pa.int64())], names=["tile", "low", "above", "level", "open"])

    def pairs(s: DataFrame, open_only: bool) -> DataFrame:
        s = s.where("open > 0") if open_only else s
        left = tiles.join(s.drop("above", "open"), "tile")
        return left.crossJoin(other).where("dim >= dim2 and dim <= dim2")  # an equality would hash all tiles to one task

    state = cut(tiles.select("tile", "n").mapInArrow(start, STATE), "state")
    for _ in range(SPAN // BITS):  # at most three rounds over all pairs of tiles
        if not state.where("open > 0").limit(1).count():
            break
        hist = pairs(state, True).mapInArrow(lambda b: _histograms(b, k), "tile long, q binary, bins binary, counts binary")
        now = state.where("open > 0").join(hist, "tile", "left").groupBy("tile").applyInArrow(_narrow(k), STATE)
        state = cut(now.unionByName(state.where("open = 0")), "state")
    found = pairs(state, False).mapInArrow(lambda b: _filtered(b, k), "tile long, q long, id long, neighbour long, score long")
    rank = F.row_number().over(Window.partitionBy("tile", "q").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(key), F.col("neighbour").alias("neighbour_id"), "rank", F.round(F.col("score") / UNIT, 6).alias("similarity"))


#: :func:`top_k` of ``embeddings`` with its defaults, for DuckDB.
TOP_K_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS rank FROM s)
SELECT vec_id, neighbour_id, rank::INTEGER AS rank, round(score, 6) AS similarity FROM r WHERE rank <= {K}
"""
