"""Exact neighbours against sorting all scores."""

import numpy as np
import pytest

from mosaica.llm import topk


def brute(rows, k):
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        cand = []
        for j, w in rows:
            if j is None or w is None or len(w) != len(v) or j == i or any(x is None or not np.isfinite(x) for x in w):
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            cand.append((-round(float(np.dot(v, w)) / n * 1e9) if n else 0, j))
        out.setdefault(i, []).append([(j, r + 1) for r, (_, j) in enumerate(sorted(cand)[:k])])
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append((r.neighbour_id, r.rank))
    return {i: sorted(x, key=lambda p: p[1]) for i, x in out.items()}


@pytest.mark.parametrize("tile", [1024, 16])
def test_matches_sorting(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)] + [(200 + i, r.standard_normal(6).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 7):
        assert got(topk.top_k(df, k, every=1)) == {i: x[0] for i, x in brute(rows, k).items()}


def test_many_rounds(spark, monkeypatch):
    """Scores so close that every round is needed, and ties beyond k."""
    monkeypatch.setattr(topk, "SLACK", 0)
    rows = [(i, [1.0, 1e-6 * i]) for i in range(40)] + [(100 + i, [1.0, 0.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(topk.top_k(df, 5, every=1)) == {i: x[0] for i, x in brute(rows, 5).items()}


def test_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.5, 0.5])]
    out = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int"), 3, every=1).collect()
    assert {r.vec_id for r in out} == {1, 2, 6, 10}
    assert [r.neighbour_id for r in sorted((r for r in out if r.vec_id == 1), key=lambda r: r.rank)] == [2, 2, 10]
    assert [r.neighbour_id for r in sorted((r for r in out if r.vec_id == 6), key=lambda r: r.rank)] == [1, 2, 2]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert topk.top_k(spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<float>")).collect() == []  # no query


def test_queries_are_the_rows_divisible_by_every(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(-30, 240)]
    df = spark.createDataFrame([(str(i), v) for i, v in rows] + [("x1", [1.0] * 5)], "vec_id string, embedding array<double>")
    for every in (7, 100):
        assert got(topk.top_k(df, 4, every=every)) == {i: x[0] for i, x in brute(rows, 4).items() if i % every == 0}
