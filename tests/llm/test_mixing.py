"""Apportionment against handing out seats one by one, and the mixture against a plain computation."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica.llm.mixing import LEAST_WEIGHT, assigned, mix, mixture, seats_before


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 9), st.floats(0, 1e6)), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 60))
def test_seats_one_by_one(sources, bound):
    w, have = np.array([s[0] for s in sources], float), np.array([s[1] if s[0] >= LEAST_WEIGHT else 0 for s in sources])
    seats = sorted((-x / (2 * k + 1), s, k) for s, x in enumerate(w) for k in range(have[s]))
    bounds = sorted({0, bound // 2, bound, int(have.sum())})
    got = seats_before(w, have, bounds)
    for b, row in zip(bounds, got):
        want = np.bincount([s for _, s, _ in seats[:b]], minlength=len(w))
        assert row.tolist() == want.tolist()


def plain(rows, block, seats, shards, seed):
    """The same mixture, document by document."""
    docs = {}
    for i, text, source in rows:
        docs[(i, text or "")] = min(source or "", docs.get((i, text or ""), source or ""))
    key = lambda s: hashlib.md5(s.encode()).hexdigest()
    streams, blocks = {}, {}
    for (i, text), s in docs.items():
        streams.setdefault(s, []).append((key(f"{seed}:{i}"), i, text))
    for s, ds in streams.items():
        at = 0
        for _, i, text in sorted(ds):
            blocks[(i, text)] = (s, at // block)
            at += len(text.split())
    weight = {s: sum(len(t.split()) for _, _, t in ds) ** 0.5 for s, ds in streams.items()}
    order = {s: sorted({b for x, b in blocks.values() if x == s}, key=lambda b, s=s: (key(f"{seed}:{s}:{b}"), b)) for s in streams}
    ranked = sorted((-weight[s] / (2 * k + 1), s, k) for s in streams for k in range(len(order[s])) if weight[s])[:seats]
    bounds = [len(ranked) * i // shards for i in range(1, shards + 1)]
    where = {(s, order[s][k]): (sum(b <= r for b in bounds), k) for r, (_, s, k) in enumerate(ranked)}
    return {(i, s, b, *where[s, b]) for (i, text), (s, b) in blocks.items() if (s, b) in where}


def test_mixture(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(x.doc_id, x.source, x.block, x.shard, x.seat) for x in mixture(docs, block_tokens=40, seats=30, shards=4, seed=3).collect()}
    assert got == plain(rows, 40, 30, 4, 3) and got
    quotas = assigned(docs, block_tokens=40, seats=30, shards=4, seed=3)[1].collect()
    assert sum(q.quota for q in quotas) == 30 and len(quotas) == 16
    seen = {(s, k, h) for _, s, _, h, k in got}
    for q in quotas:
        assert sum(1 for s, _, h in seen if (s, h) == (q.source, q.shard)) == q.quota


def test_cases(spark):
    rows = [(1, "a b", "x", 9), (1, "a b", "x", 9), (None, "c", None, 9), (3, None, "x", 9), (4, "", "y", 9), (5, "long " * 90_000, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    out = mix(docs, seats=100, block_tokens=10)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "3", "5", "None"]  # y has no tokens, so no weight
    assert {r.doc_id for r in mix(docs, weights={"y": 2.0, "other": 1.0}, seats=5).collect()} == {4}
    assert mix(docs, weights={}, seats=5).collect() == []
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixture(empty).collect() == [] and mix(empty).collect() == []
