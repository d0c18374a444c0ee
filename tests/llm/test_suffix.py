"""Repeated windows against a dictionary of all windows."""

import random
from collections import defaultdict

import pytest

from mosaica.llm import suffix
from mosaica.llm.suffix import SPANS_SQL, drop_repeats, repeated_windows, spans


def brute(rows, t):
    seen = defaultdict(set)
    for i, x in rows:
        w = (x or "").split()
        for p in range(len(w) - t + 1):
            seen[tuple(w[p : p + t])].add((i, p))
    out = {}
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            out |= {p: first for p in places}
    return out


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 20, 90, 400]))]
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 11 == 0:
            w += ["same"] * 70
        if i % 5 == 4 and rows[-1][1]:
            w = rows[-1][1].split()
            if i % 2 and len(w) > 10:
                w[len(w) // 2] = "changed"
        rows.append((i, r.choice([" ", "\n"]).join(w)))
    return rows


def found(spark, rows, t):
    got = {}
    for r in repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), t).collect():
        for k in range(r.n):
            got[(r["__llm_id"], r.pos + k)] = (r.first_id, r.first_pos + k)
    return got


def test_windows_match_brute_force(spark):
    rows = corpus()
    for t in (50, 10, 23):
        assert found(spark, rows, t) == brute(rows, t)


@pytest.mark.parametrize("hot", [0, 3, 40])
def test_hot_digits_give_the_same(spark, monkeypatch, hot):
    rows = corpus(50, 8) + [(1000 + i, " ".join(f"p{k}" for k in range(70)) + f" {i}") for i in range(60)]
    monkeypatch.setattr(suffix, "HOT", hot)
    assert found(spark, rows, 50) == brute(rows, 50)
    assert spans_of(spark, rows) == brute_spans(rows, 50)


def spans_of(spark, rows, t=50):
    return {tuple(r) for r in spans(spark.createDataFrame(rows, "doc_id long, text string"), t).collect()}


def brute_spans(rows, t):
    """Runs of repeated windows that first occur in a row in one place."""
    first, out = brute(rows, t), set()
    for (i, p), (j, q) in first.items():
        if first.get((i, p - 1)) == (j, q - 1):
            continue
        n = 1
        while first.get((i, p + n)) == (j, q + n):
            n += 1
        out.add((i, p, n + t - 1, j, q))
    return out


@pytest.mark.parametrize("t", [10, 23, 50])
def test_spans_match_brute_force(spark, t):
    rows = corpus(70, 9) + [(500, "same " * 300), (501, "a b " * 90), (502, "a b " * 70)]  # long runs and ties
    assert spans_of(spark, rows, t) == brute_spans(rows, t)


def test_sql():
    duckdb = pytest.importorskip("duckdb")
    rows = [*corpus(70, 9), (500, "same " * 300), (501, "a b " * 90), (502, "a b " * 70), (503, None), (504, ""), (505, " \n\t"), (506, "\x0b".join(["v w"] * 80)), *[(507, "twice " * 60)] * 2]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert set(con.execute(SPANS_SQL).fetchall()) == brute_spans(list(dict.fromkeys(rows)), 50)


def test_long_texts_and_a_hot_document(spark):
    r = random.Random(4)
    w = [f"w{r.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[70_000:70_200])), *[(3, "again " + " ".join(w[:60]))] * 150, (4, " ".join(w[:300]))]
    assert spans_of(spark, rows) == brute_spans(list(dict.fromkeys(rows)), 50)
    odd = spark.createDataFrame([(str(i) if i != 2 else "b-2", t) for i, t in rows], "doc_id string, text string")
    assert {x.doc_id for x in spans(odd).collect()} == {None, 1, 3, 4}  # an id that is no integer counts as null


def test_batches_carry_the_open_digit(spark):
    rows = corpus(40, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows, 30) == brute(rows, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drop_keeps_first_occurrence(spark):
    rows = corpus(40, 5)
    docs = spark.createDataFrame([(i, x, len(x), "pos") for i, x in rows], "doc_id long, text string, n_chars long, pos string")
    got = {r.doc_id: r for r in drop_repeats(docs).collect()}
    bad = brute(rows, 50)
    for i, x in rows:
        w = x.split()
        gone = {p + k for p in range(len(w)) if bad.get((i, p), (i, p)) != (i, p) for k in range(50)}
        left = [a for k, a in enumerate(w) if k not in gone]
        if gone and not left:
            assert i not in got
        else:
            assert got[i].text.split() == left and got[i].n_chars == len(got[i].text) and got[i].pos == "pos"
            if not gone:
                assert got[i].text == x


def test_cases(spark):
    p = " ".join(f"p{k}" for k in range(55))
    rows = [(1, p), (1, p), (2, f"a {p} b"), (None, f"c {p}"), (4, None), (5, ""), (6, "é " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in spans(docs).collect()}
    assert got == {(None, 1, 55, None), (1, 0, 55, None), (2, 1, 55, None)}
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in drop_repeats(docs).collect() if r.text)
    assert kept == [(-1, f"c {p}"), (2, "a b"), (6, "é " * 30)]
    alone = spark.createDataFrame([(1, p), (1, p), (3, "x")], "doc_id long, text string")
    assert spans(alone).collect() == [] and drop_repeats(alone).count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans(empty).collect() == [] and drop_repeats(empty).collect() == []
