"""Groups of near copies against comparing all fingerprints."""

import random
import re

import numpy as np
import pyarrow as pa

from mosaica.llm.simhash import RADIUS, drop_near_copies, duplicates, fingerprints_of, forest, within


M = (1 << 64) - 1


def plain_mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """256 bits from the definition, word by word and bit by bit; None for an empty text."""
    poly = lambda b: plain_mix(sum((c + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, c in enumerate(b)) & M)
    low = (text or "").lower().encode()
    ws = set(re.findall(rb"[0-9a-z\x80-\xff]+", low))
    if not ws:
        return sum(plain_mix((poly(low) + lane) & M) << (64 * lane) for lane in range(4)) if low else None
    out = 0
    for lane in range(4):
        hs = [plain_mix(poly(w) ^ (0xA5A5A5A5 * (lane + 1))) for w in ws]
        out |= sum((2 * sum((h >> k) & 1 for h in hs) > len(hs)) << k for k in range(64)) << (64 * lane)
    return out


def brute(rows, radius=RADIUS, links=False):
    rows = list(dict.fromkeys(rows))
    f = [plain_fingerprint(t) for _, t in rows]
    has = [x is not None for x in f]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and (f[i] ^ f[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    if links:
        near = [sum(has[i] and has[j] and i != j and (f[i] ^ f[j]).bit_count() <= radius for j in range(len(rows))) for i in range(len(rows))]
        return {(rows[i][0], min(rows[m][0] for m in g), near[i]) for g in members.values() if len(g) > 1 for i in g}
    return {(rows[i][0], min(rows[m][0] for m in g)) for g in members.values() if len(g) > 1 for i in g}


def corpus(n=120, seed=2):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"] + [f"wort{k}" for k in range(2000)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([5, 40, 200]))]
        if i % 3 == 2:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(len(w) // r.choice([1000, 50, 12])):
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kept_id) for r in duplicates(docs).collect()}
    assert got == brute(rows) and len(got) > 40
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert kept == {i for i, _ in rows} - {a for a, b in got if a != b}


def test_fingerprints_are_as_defined():
    texts = [t for _, t in corpus(40, 3)] + ["", "...", "?!", "Ünï cödé ÜNÏ", "a"]
    f, has = fingerprints_of(pa.array(texts))
    for t, x, ok in zip(texts, f, has):
        want = plain_fingerprint(t)
        assert (want is not None) == ok and (want is None or [int(w) for w in x] == [(want >> (64 * k)) & M for k in range(4)])


def test_links_with_a_third_copies_of_one_text(spark):
    rows = corpus(80, 7)
    rows += [(1000 + k, rows[5][1]) for k in range(60)] + [(2000 + k, "*" * (3 + k % 2)) for k in range(6)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    assert {(r.doc_id, r.kept_id, r.links) for r in duplicates(docs).collect()} == brute(rows, links=True)


def test_small_tiles(spark, monkeypatch):
    from mosaica.llm import simhash

    monkeypatch.setattr(simhash, "TILE", 7)
    rows = corpus(60, 4)
    assert {(r.doc_id, r.kept_id) for r in duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_fingerprint_is_a_majority_of_words():
    texts = ["One two three", "three TWO one one!", "", "x " * 700 + " ".join(f"w{k}" for k in range(600))]
    f, has = fingerprints_of(pa.array(texts))
    assert has.tolist() == [True, True, False, True] and (f[0] == f[1]).all()
    more, _ = fingerprints_of(pa.array([*texts[:2], None, " ".join(f"w{k}" for k in range(600)) + " x"]).fill_null(""))
    assert (more == f).all()  # how often and where a word occurs doesn't count


def test_fingerprint_depends_on_its_text_alone():
    texts = [t for _, t in corpus(70, 6)] + ["", "one", "x " * 9 + "long " + " ".join(f"w{k}" for k in range(9000))]
    alone = [fingerprints_of(pa.array([t])) for t in texts]
    for n in (2, 3, 5, 33, len(texts)):
        for s in range(0, len(texts), n):
            f, has = fingerprints_of(pa.array(texts[s : s + n]))
            assert (f == np.concatenate([a for a, _ in alone[s : s + n]])).all()
            assert has.tolist() == [bool(b[0]) for _, b in alone[s : s + n]]


def test_copies_on_both_sides_of_a_batch_border(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(300)) for _ in range(3)]
    # a partition of one text, a run of many short ones, and runs that a text longer than a part splits off
    rows = [(0, texts[0]), *((10 + k, f"kurz{k}") for k in range(600)), (1, texts[0]), (2, texts[1]), (3, "long " * 150_000), (4, texts[1]), (5, texts[2]), (6, texts[2])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows[:1], 1).union(spark.sparkContext.parallelize(rows[1:], 2)), "doc_id long, text string")
    assert {(x.doc_id, x.kept_id) for x in duplicates(docs, 0).collect()} == {(0, 0), (1, 0), (2, 2), (4, 2), (5, 5), (6, 5)}


def test_within_and_forest():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, (4, 90)).astype(np.uint64)
    b = a[:, r.permutation(90)[:50]] ^ np.uint64(5)
    for x, y, same in ((a, b, False), (a, a, True)):
        d = np.bitwise_count(x[:, :, None] ^ y[:, None, :]).sum(0)
        want = {(i, j) for i, j in zip(*np.nonzero(d <= 100)) if not same or i < j}
        assert set(zip(*map(np.ndarray.tolist, within(x, y, 100, same)))) == want
    lab = forest(np.array([0, 1, 4]), np.array([1, 2, 5]), 7)
    assert lab.tolist() == [0, 0, 0, 3, 4, 4, 6]


def test_cases(spark):
    t = "alpha beta gamma delta"
    rows = [(5, t, 1), (5, t, 1), (7, t.upper(), 2), (None, t, 3), (8, None, 4), (9, "", 5), (10, "...", 6), (11, "other " + "words here " * 50_000, 7)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, node long, __llm_key string")
    assert {(r.doc_id, r.kept_id) for r in duplicates(docs).collect()} == {(5, 5), (7, 5), (None, 5)}
    left = drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.node for r in left.collect()) == [1, 4, 5, 6, 7]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert duplicates(empty).collect() == [] and drop_near_copies(empty).collect() == []


def fingerprints_near(n, flips, centres, seed):
    r = np.random.default_rng(seed)
    c = r.integers(0, 2**64, (centres, 4), np.uint64)[r.integers(0, centres, n)]
    return np.unique(c ^ np.packbits(r.random((n, 256)) < flips / 256, axis=1).view(np.uint64), axis=0)


def block_search(f, radius, crowd=None):
    """Pairs that all blocks and pieces find, in one process."""
    from mosaica.llm.simhash import _keys, found_by

    crowd = np.full(len(f), -1) if crowd is None else crowd
    out = []
    for base, v in _keys(f, radius):
        for x in np.unique(v):
            at = np.flatnonzero(v == x)
            for i, j in found_by(f[at], None, radius, base >> 20, base >> 16 & 15, crowd[at], crowd[at]):
                out += zip(np.minimum(at[i], at[j]).tolist(), np.maximum(at[i], at[j]).tolist())
    return out


def test_block_search_finds_every_pair_once():
    f = fingerprints_near(400, 24, 6, 1)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    crowd = np.arange(len(f)) % 4 - 1
    for radius in (0, 1, 15, 16, 31, 40, 48, 63, 128, 255, 256, 300):
        want = {(i, j) for i, j in zip(*np.nonzero(d <= radius)) if i < j}
        got = block_search(f, radius)
        assert len(got) == len(set(got)) and set(got) == want, radius
    got = block_search(f, 48, crowd)  # those of one crowd are left to another comparison
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(d <= 48)) if i < j and (crowd[i] < 0 or crowd[i] != crowd[j])} and len(got) == len(set(got))


def test_block_search_compares_few_pairs(monkeypatch):
    from mosaica.llm import simhash

    f, seen, count = fingerprints_near(40_000, 128, 1, 2), [], np.bitwise_count

    def counting(x, *args, **options):
        seen.append(x.size)
        return count(x, *args, **options)

    monkeypatch.setattr(simhash.np, "bitwise_count", counting)
    assert block_search(f, RADIUS) == []
    assert sum(seen) < len(f) * (len(f) - 1) / 2  # 0.64 a pair here and 0.27 with 120,000; all with all takes two a pair, however many


def test_crowds_and_deals(spark, monkeypatch):
    """Texts near each other and few to a task: crowds are found, dealt out, and joined to what is near them."""
    from mosaica.llm import simhash

    r = random.Random(9)
    rows = corpus(60, 8)
    w = [f"crowd{k}" for k in range(150)]
    for k in range(60):
        x = list(w)
        for _ in range(r.choice([2, 6, 14])):
            x[r.randrange(len(x))] = f"new{k}"
        rows.append((3000 + k, " ".join(x)))
    f, _ = fingerprints_of(pa.array([t for _, t in rows]))
    centres, sizes = simhash.centres_of(f, RADIUS)
    assert len(centres) and sizes[0] > 20
    docs = spark.createDataFrame(rows + rows[-5:], "doc_id long, text string")
    want = brute(rows, links=True)
    monkeypatch.setattr(simhash, "TILE", 7)
    for group in (simhash.GROUP, 6):
        monkeypatch.setattr(simhash, "GROUP", group)
        assert {(x.doc_id, x.kept_id, x.links) for x in duplicates(docs).collect()} == want
