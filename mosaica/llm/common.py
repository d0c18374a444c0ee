"""What the operators of this subpackage share: lineage cuts, row keys and vectorised word hashing.

Row keys. A row of a document table is known by its integer ``doc_id`` and a hash of its text. Rows that repeat both
are one document. A null ``doc_id`` takes part under :data:`NO_ID`, and so does one that is no integer, such as ``"a-1"``; a null
text is an empty text.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

ID, KEY = "__llm_id", "__llm_key"
#: Stands for a null ``doc_id`` inside the operators.
NO_ID = -(2**63)
TOKENIZERS = "/opt/tokenizers"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the plan starts afresh and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_id():
    """``doc_id`` as a long; null where it is no integer."""
    return F.expr("try_cast(doc_id as long)")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with its row key in front, under names that no input column has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(long_id(), F.lit(NO_ID)).alias(ID), F.xxhash64(text).alias(KEY), "*")


def passing(f):
    """For a function that returns rows of its first argument: columns whose names it might use itself, or with dots or quotes, have others meanwhile."""
    clashes = lambda c: c.lower().startswith(("__llm_", "__own_")) or "." in c or "`" in c

    @wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = docs.columns
        if not any(map(clashes, names)):
            return f(docs, *args, **options)
        inner = docs.toDF(*(f"__own_{k}" if clashes(c) else c for k, c in enumerate(names)))
        return f(inner, *args, **options).toDF(*names)

    return run


def texts_of(docs: DataFrame) -> DataFrame:
    """Only the row key and the text, never null."""
    return keyed(docs.select("doc_id", "text")).select(ID, KEY, F.coalesce("text", F.lit("")).alias("text"))


def real_id(name: str = ID):
    """The ``doc_id`` behind a row key."""
    return F.when(F.col(name) != NO_ID, F.col(name))


# ---- texts in Arrow batches as flat bytes -------------------------------------------------------------------------

#: Bytes of text that a kernel works on at a time: its arrays are about thirty times as large.
PART_BYTES = 1 << 19


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``most`` text bytes; a longer text is a run of its own, whole."""
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(column) if at is None else at
        off = flat(b.column(at))[1]
        s = 0
        while s < b.num_rows:
            e = max(s + 1, int(np.searchsorted(off, off[s] + most, "right")) - 1)
            yield b.slice(s, e - s)
            s = e


def tidy(run):
    """A batch function that gives its memory back when its partition is done: workers live on for other stages."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of ``values[s:e]`` for each range; the ranges ascend."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PART_BYTES, "right")))
        hi = int(ends[j - 1])
        fwd, back = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(1)) * fwd[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * back[s]
        i = j
    return mix(out)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    t[128:] = True
    return t


#: Bytes of words: ASCII letters and digits and all of UTF-8 beyond ASCII.
ALNUM = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Bytes of words between ASCII white space.
SOLID = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in flat bytes, and where each text's words start (one more than the texts)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    is_word = kind[raw]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edges = off[(off > 0) & (off < n)]
    first[edges] = is_word[edges]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[edges - 1] = is_word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)
