"""The stages against brute force, each on its predecessor's rows."""

import re

import numpy as np

import corpus_pipeline
from mosaica.llm.vocab import encoding
from mosaica.llm.fertility import PRIOR, K
from tests.llm.test_fertility import brute as brute_bands
from tests.llm.test_mixing import plain as plain_mixture
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_suffix import brute as brute_windows

from mosaica.llm.mixing import BLOCK_TOKENS, SEED, SHARDS, SHARE

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert frames[-1].columns == docs.columns, name
    start, good, apart, cut, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)

    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(good) == brute_bands([(r["doc_id"], r["text"], r["lang"]) for r in start], K, PRIOR) and 100 < len(good) < len(start)
    pairs = brute_groups([(r["doc_id"], r["text"]) for r in good])
    assert ids(apart) == ids(good) - {a for a, b in pairs if a != b} and len(apart) == len(ids(apart))

    bad = brute_windows([(r["doc_id"], r["text"]) for r in apart], 50)
    want = {}
    for r in apart:
        w, i = r["text"].split(), r["doc_id"]
        gone = {p + k for p in range(len(w)) if bad.get((i, p), (i, p)) != (i, p) for k in range(50)}
        if left := [x for k, x in enumerate(w) if k not in gone]:
            want[i] = left
    assert {r["doc_id"]: r["text"].split() for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in cut]
    every = plain_mixture(rows, BLOCK_TOKENS, 10**9, SHARDS, SEED)
    seats = int(np.floor(SHARE * len({(s, b) for _, s, b, _, _ in every})))
    assert ids(mixed) == {i for i, *_ in plain_mixture(rows, BLOCK_TOKENS, seats, SHARDS, SEED)}

    e = encoding()
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert ids(tokens) == set(texts) and all(r["tokens"] == e.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"] for r in tokens)


def plain_run(rows):
    """All stages on plain rows ``(doc_id, text, lang, source)``, none of them on what a stage returned: doc_id -> ids."""
    good = brute_bands([r[:3] for r in rows], K, PRIOR)
    rows = [r for r in rows if r[0] in good]
    gone = {a for a, b in brute_groups([r[:2] for r in rows]) if a != b}
    rows = list(dict.fromkeys(r for r in rows if r[0] not in gone))
    bad, cut = brute_windows([r[:2] for r in rows], 50), []
    for i, text, lang, source in rows:
        starts = [m.start() for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text)]
        lost = {p + k for p in range(len(starts)) if bad.get((i, p), (i, p)) != (i, p) for k in range(50)}
        if lost:
            edge = [0, *starts[1:], len(text)] if 0 not in lost else [*starts, len(text)]
            text = "".join(text[edge[k] : edge[k + 1]] for k in range(len(starts)) if k not in lost)
        if text:
            cut.append((i, text, source))
    every = plain_mixture(cut, BLOCK_TOKENS, 10**9, SHARDS, SEED)
    seats = int(np.floor(SHARE * len({(s, b) for _, s, b, _, _ in every})))
    stay, e = {i for i, *_ in plain_mixture(cut, BLOCK_TOKENS, seats, SHARDS, SEED)}, encoding()
    return {i: e.encode_ordinary(text) for i, text, _ in cut if i in stay}


def test_run(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    want = plain_run(rows)
    assert len(got) == len(want) > 50
    assert {r.doc_id: r.tokens for r in got} == want and all(r.round_trip and r.n_tokens == len(r.tokens) for r in got)


def test_run_cases(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__llm_id` long, `__llm_key` string, tile int, `order` string, digit long, `x.y` string"
    extra = ", 1L as `__llm_id`, 'k' as `__llm_key`, 2 as tile, 'o' as `order`, 3L as digit, 'z' as `x.y`"
    have = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *extra[2:].split(", "))
    long_text = " ".join(f"word{k % 977} number{k}" for k in range(60_000))
    odd = [(None, None, None, None, None), (9001, None, "en", "web", None), (9002, "", None, None, 0), (9003, " \n ", "en", None, 3), (None, "a text without an identifier, of ten words at most", "en", "web", None), (9004, long_text, "en", None, None), (9004, long_text, "en", None, None)]
    odd = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in odd], schema)
    whole = have.unionByName(odd).unionByName(have.limit(20))
    for name, rows in (("odd", whole), ("none", whole.where("false")), ("few", odd)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in got]
    assert all(r.round_trip for r in got) and len(ids) == len(set(ids)) > 50 and not {9001, 9002, 9003} & set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    assert all(r.round_trip for r in corpus_pipeline.run(spark, f"{tmp_path}/few").collect())
