"""Token ids as binary shards in training order.

All documents are one stream, in the order of a keyed hash of ``doc_id`` and text, an end-of-text id after each; it is cut
into sequences of ``seq_len``, and the last is filled up with end-of-text. A keyed Feistel permutation of the next power of
four from N on, walked along its cycle until it falls below N, gives each of the N sequences its global slot. Shard s has
the slots from ``s * per_shard`` up to the next shard's, ``seq_len`` little-endian ids each, so a slot's place in its file is known
and readers may start anywhere. Which ids stand where depends on the documents and the key alone, not on partitions,
files or cores.

Documents are encoded once and written with their numbers of tokens. Those numbers alone are sorted and summed, which gives
every document its place in the stream; a file for each partition of the encoded documents holds the places of its rows, so
that the ids needn't be shuffled to meet them. The documents' pieces of sequences then go to their shards in one shuffle,
range-partitioned by slot. A shard is written by one task, first under another name and then renamed, so a task that is run
again does no harm, and a task counts the ids it was given. :func:`materialise` writes everything before it returns; the
manifest is written last, and shards without one are not complete.

Defined cases: null and empty texts are an end-of-text alone; repeated rows are repeated in the stream; a ``doc_id`` that
is null or no integer only leaves the order to the text; the longest texts go on over as many sequences as they need; an
empty table has no shard and gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, TOKENIZERS, cut, new_path, parts, texts_of, tidy
from .common import KEY as TEXT_KEY
from .vocab import WordEncoder

VOCABULARY = "byte_bpe_50k"
SEQ_LEN = 2048
#: Sequences of a shard: 32 MB of 16-bit ids.
PER_SHARD = 8192
KEY = 0x5EED_0F_70CE25
END = 50256
ROUNDS = 6
#: Tasks that write shards, at most; beyond, each writes several, one after the other.
MOST_TASKS = 20_000
#: Bytes of ids that are cut into pieces at a time.
PLACE_BYTES = 4 << 20


def _feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(ROUNDS):
        f = right + np.uint64((key + r * 0x9E3779B97F4A7C15) & (2**64 - 1))
        f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each number below ``n``: a bijection of ``range(n)``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(x, np.uint64), half, key)
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = _feistel(out[beyond], half, key)
    return out.astype(np.int64)


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _put(path: str, data: bytes, tag: str) -> None:
    """Writes a file under another name and renames it."""
    where, p = _fs(path)
    with where.open_output_stream(f"{p}.{tag}") as f:
        f.write(data)
    where.move(f"{p}.{tag}", p)


def encoded(docs: DataFrame, key: int = KEY, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, end: int = END) -> DataFrame:
    """``(part, row, order, __llm_id, __llm_key, n, ids)`` of every document: ``ids`` are its 16-bit ids and an end-of-text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        encoder, stop = WordEncoder(vocabulary, folder), np.array([end], "<u2").tobytes()
        for b in parts(batches):
            ids = [encoder.text(t) + stop for t in b.column("text").to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            cols = [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), b.column("order"), b.column(ID), b.column(TEXT_KEY), pa.array(n), pa.array(ids, pa.binary())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "order", ID, TEXT_KEY, "n", "ids"])

    if WordEncoder(vocabulary, folder).dtype.itemsize != 2:
        raise ValueError("ids must fit into 16 bits")
    rows = texts_of(docs).withColumn("order", F.xxhash64(F.lit(key), ID, TEXT_KEY))
    return rows.mapInArrow(tidy(run), f"part int, row long, order long, {ID} long, {TEXT_KEY} long, n long, ids binary")


def _places(rows: DataFrame, folder: str) -> int:
    """Writes for each ``part`` a file of where its rows' documents begin in the stream; the stream's length.

    Rows that repeat document and text may stand in any order among themselves, so they are spread over ranges like others.
    """
    by = ["order", ID, TEXT_KEY, "part", "row"]
    ranged = cut(rows.select(*by, "n").repartitionByRange(*by).withColumn("p", F.spark_partition_id()), "order")
    sums = ranged.groupBy("p").agg(F.sum("n").alias("sum"), F.min(F.struct(*by)).alias("first"))  # one row a partition
    before = cut(sums.select("p", "sum", (F.sum("sum").over(Window.orderBy("first")) - F.col("sum")).alias("before")), "sums")
    inside = F.sum("n").over(Window.partitionBy("p").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    at = ranged.withColumn("inside", inside).join(before, "p").select("part", "row", (F.col("before") + F.col("inside")).alias("at"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tag = str(TaskContext.get().taskAttemptId())
        part, got = None, []
        for b in batches:
            p, x = b.column("part").to_numpy(), b.column("at").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else []
            for s, e in zip(edges, np.append(edges[1:], len(p))):
                if p[s] != part and got:
                    _put(f"{folder}/{part}", np.concatenate(got).tobytes(), tag)
                    got = []
                part = int(p[s])
                got.append(x[s:e])
        if got:
            _put(f"{folder}/{part}", np.concatenate(got).tobytes(), tag)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32())], names=["done"])

    where, root = _fs(folder)
    where.create_dir(root, recursive=True)
    at.repartition("part").sortWithinPartitions("part", "row").mapInArrow(tidy(write), "done int").agg(F.count("*")).collect()
    return before.agg(F.coalesce(F.sum("sum"), F.lit(0))).first()[0]


def materialise(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, end: int = END) -> DataFrame:
    """Writes the shards to ``path``; ``(slot, shard, byte_offset, n_tokens, crc32)`` of every sequence, which is kept there as ``index``."""
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    where, root = _fs(path)
    where.create_dir(root, recursive=True)
    if where.get_file_info(f"{root}/manifest.json").is_file:
        where.delete_file(f"{root}/manifest.json")
    rows = cut(encoded(docs, key, vocabulary, folder, end), "encoded")
    places = new_path(spark, "places")
    length = _places(rows, places)
    total = -(-length // seq_len)
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, MOST_TASKS))
    last = int(permute(np.array([total - 1]), total, key)[0]) if total else -1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents' pieces; those of a batch that go to one shard travel as one compressed row."""
        z, part, held = zstandard.ZstdCompressor(level=3), None, None

        def out(at: np.ndarray, n: np.ndarray, data: bytes) -> pa.RecordBatch:
            ids = np.frombuffer(data, "<u2")
            count = (at + n - 1) // seq_len - at // seq_len + 1
            doc, first = np.repeat(np.arange(len(at)), count), np.cumsum(count) - count
            seq = at[doc] // seq_len + np.arange(len(doc)) - first[doc]
            begin = np.maximum(at[doc], seq * seq_len)
            size = np.minimum((at + n)[doc], (seq + 1) * seq_len) - begin
            source = (np.cumsum(n) - n)[doc] + begin - at[doc]
            slot = permute(seq, total, key)
            shard = slot // per_shard
            to = slot % per_shard * seq_len + begin % seq_len
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0)))
            rows = []
            for s, e in zip(edges, np.append(edges[1:], len(order))):
                o = order[s:e]
                blob = b"".join([ids[x : x + m].tobytes() for x, m in zip(source[o].tolist(), size[o].tolist())])
                rows.append((int(shard[o[0]]), int(shard[o[0]]) * tasks // shards, to[o].tobytes(), size[o].astype(np.int32).tobytes(), z.compress(blob)))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "task", "to", "n", "ids"])

        at, n, blobs, size = [], [], [], 0
        for b in batches:
            for p, r, m, blob in zip(*(b.column(c).to_pylist() for c in ("part", "row", "n", "ids"))):
                if p != part:
                    w, f = _fs(f"{places}/{p}")
                    with w.open_input_stream(f) as g:
                        part, held = p, np.frombuffer(g.read(), np.int64)
                at.append(held[r])
                n.append(m)
                blobs.append(blob)
                size += len(blob)
                if size >= PLACE_BYTES:
                    yield out(np.array(at), np.array(n), b"".join(blobs))
                    at, n, blobs, size = [], [], [], 0
        if at:
            yield out(np.array(at), np.array(n), b"".join(blobs))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        z, tag = zstandard.ZstdDecompressor(), str(TaskContext.get().taskAttemptId())

        def finish(shard: int, got: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
            slots = np.arange(shard * per_shard, min((shard + 1) * per_shard, total))
            n = np.where(slots == last, length - (total - 1) * seq_len, seq_len)
            data, filled = np.full(len(slots) * seq_len, end, "<u2"), 0
            for to, size, blob in got:
                ids, done = np.frombuffer(z.decompress(blob), "<u2"), 0
                for x, m in zip(np.frombuffer(to, np.int64).tolist(), np.frombuffer(size, np.int32).tolist()):
                    data[x : x + m] = ids[done : done + m]
                    done += m
                filled += done
            if filled != n.sum():
                raise RuntimeError(f"shard {shard} got {filled} ids of {n.sum()}")
            _put(f"{path}/shard-{shard:08d}.bin", data.tobytes(), tag)
            rows = data.reshape(-1, seq_len)
            crc = [zlib.crc32(r.tobytes()) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array((slots - slots[0]) * 2 * seq_len), pa.array(n.astype(np.int32)), pa.array(crc, pa.int64())], names=["slot", "shard", "byte_offset", "n_tokens", "crc32"])

        now, got = None, []
        for b in batches:
            for shard, to, n, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "to", "n", "ids"))):
                if shard != now and got:
                    yield finish(now, got)
                    got = []
                now = shard
                got.append((to, n, ids))
        if got:
            yield finish(now, got)

    placed = rows.select("part", "row", "n", "ids").mapInArrow(tidy(place), "shard long, task int, to binary, n binary, ids binary")
    index = placed.repartitionById(tasks, "task").sortWithinPartitions("shard").mapInArrow(tidy(write), "slot long, shard long, byte_offset long, n_tokens int, crc32 long")
    index.write.mode("overwrite").parquet(f"{path}/index")
    about = {"sequences": total, "tokens": length, "seq_len": seq_len, "per_shard": per_shard, "shards": shards, "key": key, "vocabulary": vocabulary, "end": end, "dtype": "<u2"}
    _put(f"{path}/manifest.json", json.dumps(about).encode(), "new")
    return spark.read.schema("slot long, shard long, byte_offset long, n_tokens int, crc32 long").parquet(f"{path}/index")


def manifest(path: str) -> dict:
    """What :func:`materialise` wrote: sequences, tokens, seq_len, per_shard, shards, key, vocabulary, end, dtype."""
    where, root = _fs(path)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read(path: str, start: int, n: int) -> np.ndarray:
    """Sequences ``start`` up to ``start + n`` in training order, from any file system Arrow knows."""
    about = manifest(path)
    seq_len, per_shard = about["seq_len"], about["per_shard"]
    where, root = _fs(path)
    out, n = [], min(n, about["sequences"] - start)
    while n > 0:
        shard, at = divmod(start, per_shard)
        take = min(n, per_shard - at)
        with where.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(at * 2 * seq_len)
            out.append(np.frombuffer(f.read(take * 2 * seq_len), about["dtype"]).reshape(-1, seq_len))
        start, n = start + take, n - take
    return np.concatenate(out) if out else np.zeros((0, seq_len), about["dtype"])
