"""Measures and bands against computing them text by text."""

import math
import statistics
from collections import Counter

import pytest

from mosaica.llm.fertility import FLOORS, PRIOR, K, accepted, keep_good, measures, script_of
from mosaica.llm.vocab import Pieces

PIECES = Pieces()


def plain(text):
    ids = [i for w in (text or "").split() for i in PIECES.model.encode(w)]
    if not ids:
        return None
    n = len(ids)
    return (n, sum(map(len, text.split())) / n, sum(PIECES.model.is_byte(i) for i in ids) / n, -sum(c / n * math.log2(c / n) for c in Counter(ids).values()))


def test_measures():
    texts = ["The cat sat on the mat.", "", "  ", "ok " * 300, "Ünïcödé 漢字 ☃ \U0001f40b", "a"]
    n, cpt, fb, h = measures(texts, PIECES)
    for k, t in enumerate(texts):
        want = plain(t)
        if want is None:
            assert n[k] == 0
        else:
            assert (n[k], pytest.approx(want[1]), pytest.approx(want[2]), pytest.approx(want[3], abs=1e-9)) == (want[0], cpt[k], fb[k], h[k])


def brute(rows, k, prior):
    """The rule, text by text: medians in steps of 1e-4, the class's and the language's weighted by its texts and the prior."""
    step = lambda x: int(math.floor(x * 10_000 + 0.5))
    m = {i: (lang or script_of(t or ""), int(math.log2(x[0])), [x[1], x[2], x[3]]) for i, t, lang in rows if (x := plain(t))}
    median = lambda xs: sorted(xs)[(len(xs) - 1) // 2]
    usual = {o: median([step(v[2][2]) for v in m.values() if v[1] == o]) for o in {v[1] for v in m.values()}}

    def level(key):
        out = {}
        for g in {key(v) for v in m.values()}:
            own = [[step(v[2][0]), step(v[2][1]), step(v[2][2]) - usual[v[1]]] for v in m.values() if key(v) == g]
            mid = [median([v[c] for v in own]) for c in range(3)]
            out[g] = (len(own), mid, [median([abs(v[c] - mid[c]) for v in own]) for c in range(3)])
        return out

    fine, coarse, ok = level(lambda v: v[:2]), level(lambda v: v[0]), set()
    middle = {g: median([v[1] for v in m.values() if v[0] == g]) for g in coarse}
    for i, (g, o, x) in m.items():
        (n, cm, cd), (_, lm, ld) = fine[g, o], coarse[g]
        short = math.sqrt(2 ** max(middle[g] - o, 0))
        mid = [(n * a + prior * b) / (n + prior) / 10_000 for a, b in zip(cm, lm)]
        dev = [(n * a + prior * b * short) / (n + prior) / 10_000 for a, b in zip(cd, ld)]
        mid[2] += usual[o] / 10_000
        floors = [mid[0] * FLOORS["cpt"], FLOORS["fallback"], FLOORS["entropy"]]
        w = [max(k * 1.4826 * d, f) for d, f in zip(dev, floors)]
        if abs(x[0] - mid[0]) <= w[0] and x[1] - mid[1] <= w[1] and mid[2] - x[2] <= w[2]:
            ok.add(i)
    return ok


def test_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    for k in (K, 1.5):
        want = brute(rows, k, PRIOR)
        assert {r.doc_id for r in accepted(docs, k).collect()} == want
        assert {r.doc_id for r in keep_good(docs, k).collect()} == want


def test_without_languages(spark):
    rows = [(i, " ".join(["слово", "другое", "и", "word", "the"][(i * k) % 5] for k in range(1 + i % 40)), None) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert {r.doc_id for r in accepted(docs).collect()} == brute(rows, K, PRIOR)


def test_short_texts_are_kept(spark):
    """A few clean short texts among many long ones of their language, as in a class of few texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars > 800").select("doc_id", "text", "lang")
    words = docs.orderBy("doc_id").first().text.split()
    short = [(10**6 + k, " ".join(words[3 * k : 3 * k + n]), "en") for k, n in enumerate((4, 5, 6, 8, 10, 14, 20, 25))]
    both = docs.unionByName(spark.createDataFrame(short, docs.schema))
    kept = {r.doc_id for r in keep_good(both).where("doc_id >= 1000000").collect()}
    assert len(kept) >= 7
    junk = [(2 * 10**6, "x9# " * 400, "en"), (2 * 10**6 + 1, "ok " * 3000, "en")]
    assert keep_good(both.unionByName(spark.createDataFrame(junk, docs.schema))).where("doc_id >= 2000000").count() == 0


def test_rejects_junk_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    kept = keep_good(docs).select("doc_id")
    ids = {r.doc_id for r in kept.collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert statistics.mean(i in ids for i in good) > 0.95 and statistics.mean(i in ids for i in bad) < 0.4


def test_cases(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en", 1.5) for i in range(5)] + [(5, "the quick brown fox jumps over the lazy dog " * 3, "en", 1.5), (5, "the quick brown fox jumps over the lazy dog " * 3, "en", 1.5)]
    rows += [(None, "the quick brown fox jumps over the lazy dog " * 3, "en", 1.5), (7, None, "en", 1.5), (8, "", None, 1.5), (9, " \n", "", 1.5), (10, "слово " * 5, None, 1.5), (11, "x " * 60_000, "en", 1.5)]
    docs = spark.createDataFrame([(*r, "n", "t") for r in rows], "doc_id long, text string, lang string, entropy double, __llm_n string, `__llm_Text` string")
    out = keep_good(docs)
    assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    assert kept == ["0", "1", "10", "2", "3", "4", "5", "5", "None"]
    assert {(r['__llm_n'], r['__llm_Text']) for r in out.collect()} == {("n", "t")}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert accepted(empty).collect() == [] and keep_good(empty).collect() == []
    assert script_of("слово word") == "script:cyrillic" and script_of("1 2 3") == "script:none"
