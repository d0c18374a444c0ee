"""Shards against the stream they are made of."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.llm import shards
from mosaica.llm.shards import END, KEY, manifest, materialise, permute, read
from mosaica.llm.vocab import WordEncoder


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(n):
    p = permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert (permute(np.arange(n), n, key=9) != p).any() and np.abs(np.diff(p)).mean() > n / 8


def stream(docs, key=KEY):
    """All documents in order, each with an end-of-text."""
    e = WordEncoder()
    text = F.coalesce("text", F.lit(""))
    of = F.coalesce(F.expr("try_cast(doc_id as long)"), F.lit(-(2**63)))
    rows = docs.select(F.xxhash64(F.lit(key), of, F.xxhash64(text)).alias("h"), of.alias("i"), F.xxhash64(text).alias("k"), text.alias("t")).collect()
    return np.frombuffer(b"".join(e.text(r.t) + np.array([END], "<u2").tobytes() for r in sorted(rows)), "<u2")


def brute(docs, seq_len, key=KEY):
    ids = stream(docs, key)
    n = -(-len(ids) // seq_len)
    full = np.concatenate([ids, np.full(n * seq_len - len(ids), END, "<u2")]).reshape(n, seq_len)
    out = np.empty_like(full)
    out[permute(np.arange(n), n, key)] = full
    return out, len(ids)


def test_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PLACE_BYTES", 3000)
    texts = ["Hello world", None, "", "of the " * 3000, "x"] * 20
    docs = spark.createDataFrame([(i % 7 or None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, slot string").repartition(5)
    path = f"file://{tmp_path}/s"
    rows = materialise(docs, path, seq_len=64, per_shard=100).collect()
    want, tokens = brute(docs, 64)
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and n == len(want) > 500
    everything = read(path, 0, n)
    assert (everything == want).all()
    assert (read(path, 95, 130) == everything[95:225]).all() and len(read(path, n - 2, 50)) == 2 and len(read(path, n, 5)) == 0
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // 100, r.slot % 100 * 128) and zlib.crc32(everything[r.slot].tobytes()) == r.crc32
    assert sum(r.n_tokens for r in rows) == tokens and sorted(r.n_tokens for r in rows)[1] == 64
    about = manifest(path)
    assert (about["sequences"], about["tokens"], about["shards"], about["seq_len"], about["key"]) == (n, tokens, -(-n // 100), 64, KEY)


def test_partitions_do_not_matter(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 20"))
    got = []
    for k in (1, 3, 8):
        rows = materialise(docs.repartition(k), f"file://{tmp_path}/{k}", seq_len=128, per_shard=50).collect()
        got.append(sorted(tuple(r) for r in rows))
    assert got[0] == got[1] == got[2] and len(got[0]) > 100
    assert (read(f"file://{tmp_path}/1", 0, 10**6) == read(f"file://{tmp_path}/8", 0, 10**6)).all()
    other = materialise(docs, f"file://{tmp_path}/1", seq_len=128, per_shard=50, key=5).collect()  # over the old ones
    assert sorted(tuple(r) for r in other) != got[0] and (read(f"file://{tmp_path}/1", 0, 10**6) == brute(docs, 128, 5)[0]).all()


def test_one_document_a_third_of_all(spark, tmp_path):
    rows = [(1, "again and again")] * 200 + [("a-1", f"text {k}") for k in range(300)] + [("7", "long " * 200_000)]
    docs = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string").repartition(4)
    materialise(docs, f"file://{tmp_path}/s", seq_len=256, per_shard=64)
    assert (read(f"file://{tmp_path}/s", 0, 10**6) == brute(docs, 256)[0]).all()


def test_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert materialise(empty, f"file://{tmp_path}/s").collect() == [] and manifest(f"file://{tmp_path}/s")["sequences"] == 0
    assert len(read(f"file://{tmp_path}/s", 0, 5)) == 0
