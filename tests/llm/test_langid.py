"""Held-out accuracy, and the back-off against its definition."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mosaica.llm import langid
from mosaica.llm.langid import LONGEST, Model, Scorer, best, fit, grams, identify, word_of

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = fit(docs.where(~held), per_language=60)
    rows = identify(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.language == r.lang for r in rows)
    assert len(rows) > 200 and right / len(rows) >= 0.97


def test_counts_and_bound(spark):
    rows = [(i, "aa bb aa", "x") for i in range(9)] + [(20, "bb cc cc", "y"), (21, "zz", None), (22, "zz", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = fit(docs, per_language=3, min_count=2)
    assert m.languages == ["x", "y"] and set(m.tables[0]) == {"aa", "bb", "cc"}
    total_x, kept = 9, 3
    assert math.isclose(m.tables[0]["aa"][0], math.log((6 + 0.5) / (total_x + 0.5 * (kept + 1))))


def test_back_off():
    v = lambda a, b: np.array([a, b], float)
    tables = [{"known": v(-1, -2)}, {"q": v(-5, -4)}, {}, {"abc": v(-3, -1), "bcd": v(-4, -1)}, {}, {}]
    m = Model(["p", "q"], tables)
    assert m.score("known").tolist() == [-1, -2]
    assert m.score("abcd").tolist() == [-3.5, -1]  # two of the four trigrams of <abcd>
    assert m.score("q").tolist() == [-5, -4]
    assert m.score("zzz").tolist() == [0, 0]
    assert grams("ab", 3) == ["<ab", "ab>"] and grams("ab", 1) == ["a", "b"] and LONGEST == 5
    assert word_of("«Ärger!»") == "ärger" and word_of("--42--") == ""
    for cache in (10**6, 3):  # with a cache that is cleared again and again
        s = Scorer(m)
        langid.CACHE_WORDS, before = cache, langid.CACHE_WORDS
        for _ in range(2):
            got = best(m, *s.scores(pa.array(["known, KNOWN abcd zzz", "... 12 zzz", "", "q\nq\tq"])))
            assert got[0] == ["q", "und", "und", "q"] and np.allclose(got[1], [(5.5 - 5) / 4, 0, 0, 1])
        langid.CACHE_WORDS = before
    tie = Model(["p", "q"], [{"known": v(-1, -1)}, {}, {}, {}, {}, {}])
    assert best(tie, *Scorer(tie).scores(pa.array(["known"])))[0] == ["p"]  # ties go to the alphabetically first


def brute(rows, per_language, min_count, order):
    """Everything from the definition, word by word, without arrays or caches."""
    letters = lambda w: re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w.lower())
    split = lambda t: [letters(w) for w in re.split("[ \t\n\r\x0b\x0c]+", t) if w]
    cut = lambda w, n: [("<" + w + ">")[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)
    langs = sorted({lang for _, _, lang in rows if lang})
    counts = {n: {lang: Counter() for lang in langs} for n in range(6)}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: order[r[0]])[:per_language]
        for _, t, _ in mine:
            for w in split(t or ""):
                if w:
                    counts[0][lang][w] += 1
                    for n in range(1, 6):
                        counts[n][lang].update(cut(w, n))
    kept = {n: {g for lang in langs for g, c in counts[n][lang].items() if c >= min_count} for n in range(6)}
    total = {n: {lang: sum(counts[n][lang].values()) for lang in langs} for n in range(6)}
    log = lambda n, g, lang: math.log((counts[n][lang][g] + 0.5) / (total[n][lang] + 0.5 * (len(kept[n]) + 1)))

    def score(w, lang):
        if w in kept[0]:
            return log(0, w, lang)
        for n in range(5, 0, -1):
            g = cut(w, n) if n == 1 or len(w) + 2 >= n else []
            hit = [x for x in g if x in kept[n]]
            if hit and 2 * len(hit) >= len(g):
                return sum(log(n, x, lang) for x in hit) / len(hit)
        return 0.0

    out = {}
    for i, t, _ in rows:
        ws = split(t or "")
        sums = [sum(score(w, lang) for w in ws if w) for lang in langs]
        if not any(sums):
            out[i] = ("und", 0.0)
        else:
            k = sums.index(max(sums))
            out[i] = (langs[k], (sums[k] - max(x for j, x in enumerate(sums) if j != k)) / len(ws))
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text"), "lang")
    rows = [tuple(r) for r in docs.collect()]
    order = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", "text")).collect()}
    got = {r.doc_id: (r.language, r.margin) for r in identify(docs, per_language=12, min_count=2).collect()}
    want = brute(rows, 12, 2, order)
    assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(math.isclose(got[i][1], want[i][1], rel_tol=1e-9, abs_tol=1e-12) for i in want)


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (None, "der und die", None), (6, "the and " * 60_000, None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, language string")
    got = sorted((str(r.doc_id), r.language) for r in identify(docs, min_count=1).collect())
    assert got == [("1", "en"), ("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("6", "en"), ("None", "de")]
    assert {r.language for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
