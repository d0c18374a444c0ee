"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents, in the seeded order of ``md5(seed:doc_id)``, are one stream of white-space words, cut into
blocks of ``block_tokens``; a document belongs to the block in which it starts. Seats go to sources by the highest
quotients ``weight / (2 k + 1)``, k being the seats a source has, as far as it has blocks; equal quotients go by source
name. The seats of a shard are a run of that order, so that after every shard each source's seats are its
apportionment to so many seats. A source's seats are taken by its blocks in the seeded order of ``md5(seed:source:block)``.

Defined cases: a null source is a source of its own, named ``''`` (as an empty one is); a null or empty text has no
tokens and goes with the block it falls in; a ``doc_id`` that is null or no integer counts as the least; rows that repeat ``doc_id`` and text
are one document; sources without a weight, or with none above 0, get no seats; an empty table gives an empty result;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, KEY, cut, keyed, passing, real_id

BLOCK_TOKENS = 20_000
#: Of all blocks, the share that gets seats, when their number isn't given.
SHARE = 0.75
SHARDS = 16
SEED = 17
#: Less counts as no weight: its quotients would no longer be told apart.
LEAST_WEIGHT = 1e-200
#: Hexadecimal digits of the order key by which a source's documents are summed, and its blocks numbered, in parallel.
SLICE = 3


def seats_before(weights: np.ndarray, have: np.ndarray, bounds: list[int]) -> np.ndarray:
    """``(bounds, sources)``: of the first so many seats in the order of quotients, those of each source.

    Sources come in the order in which ties are broken. The bound on the quotient is bisected over all doubles, so the
    work doesn't depend on the number of seats.
    """
    weights, have = np.asarray(weights, float), np.asarray(have, np.int64)
    have = np.where(weights >= LEAST_WEIGHT, have, 0)

    def above(q: float, closed: bool) -> np.ndarray:
        """Seats with quotients above ``q``, or at least ``q``."""
        with np.errstate(all="ignore"):
            k = np.nan_to_num(np.floor((weights / q - 1) / 2), nan=0, posinf=2**62, neginf=-1)
        k = np.clip(k, -1, have).astype(np.int64)
        best = np.zeros(len(weights), np.int64)
        for step in (-1, 0, 1):  # the estimate may be off by rounding
            c = np.maximum(k + step, 0)
            x = weights / (2 * c + 1)
            best = np.where((x >= q) if closed else (x > q), np.maximum(best, c + 1), best)
        return np.minimum(best, have)

    out = []
    for bound in bounds:
        lo, hi = 0, int(np.array([max(weights.max(initial=0), 1.0)]).view(np.int64)[0]) + 1
        while hi - lo > 1:  # least q with at most `bound` seats above it
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if above(np.array([mid]).view(float)[0], False).sum() <= bound else (mid, hi)
        q = np.array([hi]).view(float)[0]
        got, more = above(q, False), above(q, True)
        for s in np.flatnonzero(more > got):  # quotients equal to q
            if got.sum() < bound:
                got[s] += min(more[s] - got[s], bound - got.sum())
        out.append(got)
    return np.array(out, np.int64).reshape(len(bounds), len(weights))


def _blocks(docs: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """``(__llm_id, __llm_key, source, tokens, block)`` for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = keyed(docs.select("doc_id", "text", "source")).groupBy(ID, KEY).agg(F.min(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("source"), F.max(F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))).cast("long").alias("tokens"))
    return _cut_blocks(one, block_tokens, seed)


def _cut_blocks(one: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    one = cut(one.withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string")))).withColumn("slice", F.substring("order", 1, SLICE)), "tokens")
    sums = one.groupBy("source", "slice").agg(F.sum("tokens").alias("sum"))
    before = sums.select("source", "slice", (F.sum("sum").over(Window.partitionBy("source").orderBy("slice")) - F.col("sum")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "slice").orderBy("order", ID, KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    at = one.withColumn("inside", inside).join(before, ["source", "slice"])
    return at.select(ID, KEY, "source", "tokens", F.expr(f"(before + inside) div {int(block_tokens)}").alias("block"))


def assigned(docs: DataFrame, weights: Mapping[str, float] | None = None, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS, seats: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The chosen documents ``(__llm_id, __llm_key, source, tokens, block, shard, seat)``, and the quotas ``(shard, source, quota)``.

    ``weights``: of each source; without them, the square root of its tokens. ``seats``: of all shards together;
    without it, :data:`SHARE` of all blocks. ``seat`` counts a source's seats from 0.
    """
    spark = docs.sparkSession
    rows = cut(_blocks(docs, block_tokens, seed), "blocks")
    blocks = rows.select("source", "block").distinct()
    per = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("block").alias("blocks")).orderBy("source").collect()
    have = np.array([r.blocks for r in per], np.int64)
    w = np.array([max(0.0, float(weights.get(r.source, 0))) if weights is not None else np.sqrt(float(r.tokens)) for r in per])
    have = np.where(w > 0, have, 0)
    total = min(int(have.sum()), int(np.floor(SHARE * sum(r.blocks for r in per))) if seats is None else seats)
    bounds = [total * i // shards for i in range(shards + 1)]
    upto = seats_before(w, have, bounds)
    ends = pa.ListArray.from_arrays(pa.array(np.arange(len(per) + 1, dtype=np.int32) * shards), pa.array(np.ascontiguousarray(upto[1:].T).ravel()))
    ends = spark.createDataFrame(pa.table({"source": pa.array([r.source for r in per], pa.string()), "ends": ends}))
    quota = F.transform("ends", lambda e, i: e - F.when(i > 0, F.get("ends", i - 1)).otherwise(0))
    quotas = ends.select("source", F.posexplode(quota).alias("shard", "quota")).select("shard", "source", "quota")
    chosen = _numbered(blocks, seed).join(ends, "source").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("seat")))).where(F.col("shard") < shards).select("source", "block", "seat", "shard")
    return rows.join(chosen, ["source", "block"]), quotas


def _numbered(blocks: DataFrame, seed: int) -> DataFrame:
    """``blocks`` with ``seat``: their numbers within the source in the seeded order. A source's blocks are numbered in slices of that order."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), "source", F.lit(":"), F.col("block").cast("string")))
    blocks = blocks.withColumn("order", key).withColumn("slice", F.substring("order", 1, SLICE))
    n = blocks.groupBy("source", "slice").agg(F.count("*").alias("n"))
    before = n.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "slice").orderBy("order", "block")) - 1
    return blocks.withColumn("inside", inside).join(before, ["source", "slice"]).withColumn("seat", (F.col("before") + F.col("inside")).cast("long"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, source, n_tokens, block, shard, seat)`` for every chosen document."""
    return assigned(docs, **options)[0].select(real_id().alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "block", "shard", "seat")


@passing
def mix(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows of ``docs``; of rows that repeat ``doc_id`` and text, all."""
    return keyed(docs).join(assigned(docs, **options)[0].select(ID, KEY), [ID, KEY], "left_semi").drop(ID, KEY)


#: :func:`mixture` with its defaults, for DuckDB.
MIXTURE_SQL = f"""
WITH d AS (
  SELECT coalesce(doc_id, -9223372036854775808) AS id, coalesce(text, '') AS t, min(coalesce(source, '')) AS source,
         len(regexp_extract_all(coalesce(any_value(text), ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens
  FROM documents GROUP BY 1, 2
), o AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('{SEED}:' || id::VARCHAR), id ROWS UNBOUNDED PRECEDING) - n_tokens)::BIGINT // {BLOCK_TOKENS} AS block FROM d
), b AS (
  SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || source || ':' || block::VARCHAR), block) - 1 AS seat FROM (SELECT DISTINCT source, block FROM o)
), w AS (
  SELECT source, sqrt(sum(n_tokens)::DOUBLE) AS weight FROM o GROUP BY 1
), q AS (
  SELECT b.*, row_number() OVER (ORDER BY weight / (2 * seat + 1) DESC, source, seat) - 1 AS rank FROM b JOIN w USING (source) WHERE weight > 0
), n AS (
  SELECT floor({SHARE} * (SELECT count(*) FROM b))::BIGINT AS total
), s AS (
  SELECT q.*, (SELECT count(*) FROM range(1, {SHARDS + 1}) r(i) WHERE total * i // {SHARDS} <= rank) AS shard FROM q, n WHERE rank < total
)
SELECT nullif(id, -9223372036854775808) AS doc_id, source, n_tokens, block, shard::INTEGER AS shard, seat::BIGINT AS seat FROM o JOIN s USING (source, block)
"""
