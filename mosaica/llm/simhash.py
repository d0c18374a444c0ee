"""SimHash near-duplicates by an exact search of the pairs within a radius.

Every text gets a 256-bit SimHash over its set of lower-case words. Equal fingerprints are merged first; pairs of distinct
ones are found by the pigeonhole principle, none is lost. The 256 bits are 16 blocks in a ring, and the radius plus one is
shared out among them (:func:`shares`): of two fingerprints within the radius, some block differs in fewer bits than its
share, and so do in sum that block and the next one, two or three. A block's bits are cut into as many pieces as its share, so that
one of them is equal: fingerprints meet in one task for each block, piece and value of the piece, and there in buckets
of the block's other bits, of which only those are compared that differ in few enough. A pair counts in the first block and piece
that find it, so once. That compares one pair in 24 of random fingerprints, by one word of four: the work is still quadratic in the
distinct fingerprints beyond what is linear in them. Few of them (:data:`TILE`) are compared all with all. So are crowds, which
many blocks would find again: the fingerprints within the radius of one that has many near it in a sample. What the sample shows
decides how a pair is found, never whether.
Fingerprints within the radius are joined, and a group is a connected component.
Copies of a text meet in one fingerprint and are counted, not paired: a document's links are the other documents within the
radius, its copies among them.

Defined cases: a null or empty text has no fingerprint and is in no group; a text without words has a hash of its bytes
instead, so that only its exact copies (but for case) are near it; rows that repeat ``doc_id`` and text are one document; a ``doc_id``
that is null or no integer is kept last in its group; an empty table gives an empty result; other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import ALNUM, ID, KEY, NO_ID, cut, flat, keyed, mix, parts, passing, ranges_hash, real_id, texts_of, tidy, words

#: Bits of 256 in which near copies may differ: about one word in ten changed.
RADIUS = 48
#: Distinct fingerprints up to which all are compared with all.
TILE = 8192
#: Fingerprints of a task that are compared with each other, or with as many others; where more meet, they are dealt out.
GROUP = 1 << 19
LANES = 4
BLOCKS = 16  # of 16 bits each
CHAIN = 4  # blocks in a row that are compared first
#: Fingerprints of the sample that shows crowds, links there that make one, and the most crowds.
SAMPLE, LINKS, CROWDS = 4096, 8, 64
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
FP = [f"f{k}" for k in range(LANES)]


def fingerprints_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(n, 4)`` words of 64 bits, and which texts have one. A bit is set if more than half of the words have it."""
    n = len(column)
    raw, off = flat(pc.utf8_lower(column))
    starts, ends, at = words(raw, off, ALNUM)
    out, has = np.zeros((n, LANES), np.uint64), at[1:] > at[:-1]
    bare = np.flatnonzero(~has & (off[1:] > off[:-1]))
    if len(bare):
        h = ranges_hash(raw, off[:-1][bare], off[1:][bare])
        out[bare] = np.stack([mix(h + np.uint64(lane)) for lane in range(LANES)], axis=1)
    if not len(starts):
        has[bare] = True
        return out, has
    doc = np.repeat(np.arange(n), np.diff(at))
    h = ranges_hash(raw, starts, ends)
    for s, e in zip(at[:-1][has], at[1:][has]):
        h[s:e].sort()
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))  # each word once a text
    doc, h = doc[new], h[new]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    runs = np.flatnonzero(rank % 255 == 0)  # eight counters of 8 bits to a word hold 255
    of_run = np.flatnonzero(np.concatenate(([True], doc[runs][1:] != doc[runs][:-1])))
    total = np.diff(np.append(first, len(doc)))
    for lane in range(LANES):
        b = mix(h ^ np.uint64(0xA5A5A5A5 * (lane + 1))).view(np.uint8).reshape(-1, 8)
        got = np.empty((len(total), 8), np.uint8)
        for k in range(8):
            sums = np.add.reduceat(_SPREAD[b[:, k]], runs).view(np.uint8).reshape(-1, 8).astype(np.int32)
            got[:, k] = np.packbits(np.add.reduceat(sums, of_run, axis=0) * 2 > total[:, None], axis=1, bitorder="little")[:, 0]
        out[doc[first], lane] = got.view(np.uint64)[:, 0]
    has[bare] = True
    return out, has


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(__llm_id, __llm_key, f0..f3)`` for each row that has a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            f, has = fingerprints_of(b.column("text"))
            keep = pa.array(has)
            cols = [b.column(ID).filter(keep), b.column(KEY).filter(keep)] + [pa.array(f[has, k].view(np.int64)) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays(cols, names=[ID, KEY, *FP])

    return texts_of(docs).mapInArrow(tidy(run), f"{ID} long, {KEY} long, " + ", ".join(f"{c} long" for c in FP))


def within(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of ``a`` and ``b`` (lanes first) at most ``radius`` bits apart; of one tile with itself, each once.

    Two of the four words are compared for all; the others only where those two leave it open.
    """
    left, right = [], []
    n = b.shape[1]
    x, d, d1 = np.empty((rows, n), np.uint64), np.empty((rows, n), np.uint8), np.empty((rows, n), np.uint8)
    for s in range(0, a.shape[1], rows):
        e = min(s + rows, a.shape[1])
        if e - s < rows:
            x, d, d1 = x[: e - s], d[: e - s], d1[: e - s]
        np.bitwise_count(np.bitwise_xor(a[0, s:e, None], b[0], out=x), out=d)
        d += np.bitwise_count(np.bitwise_xor(a[1, s:e, None], b[1], out=x), out=d1)
        i, j = np.divmod(np.flatnonzero(d <= radius), n)
        if same and len(i):
            keep = i + s < j
            i, j = i[keep], j[keep]
        if len(i):
            total = d[i, j].astype(np.int64)
            for k in range(2, LANES):
                total += np.bitwise_count(a[k, i + s] ^ b[k, j])
            ok = total <= radius
            left.append(i[ok] + s)
            right.append(j[ok])
    z = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (z, z)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component in a graph of ``n`` nodes."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def shares(radius: int) -> np.ndarray:
    """The radius plus one in parts for the blocks: within the radius not all of them can differ in as many bits."""
    return np.array([(radius + 1) // BLOCKS + (b < (radius + 1) % BLOCKS) for b in range(BLOCKS)])


def pieces(share: int) -> list[int]:
    """Masks that cut a block's 16 bits into ``share`` pieces; a share above 16 rules nothing out, and no share lets the block find nothing."""
    if not 0 < share <= 16:
        return [0] if share else []
    at = [16 * k // share for k in range(share + 1)]
    return [(1 << e) - (1 << s) for s, e in zip(at, at[1:])]


class _Buckets:
    """Words by the values of some of their bits, in columns of ``wide`` of one crowd (-1: none); what a column has no word for is filled with noise."""

    def __init__(self, w: np.ndarray, crowd: np.ndarray, bits: list[int], wide: int):
        r = np.zeros(len(w), np.int64)
        for k, b in enumerate(bits):
            r |= ((w >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
        kinds = int(crowd.max(initial=-1)) + 2
        r = r * kinds + crowd + 1
        order = np.argsort(r, kind="stable")
        n = np.bincount(r, minlength=kinds << len(bits))
        first = np.concatenate(([0], np.cumsum(-(-n // wide))))
        self.first = first[::kinds]
        self.of, self.crowd = np.divmod(np.repeat(np.arange(len(n)), np.diff(first)), kinds)
        self.crowd -= 1
        r = r[order]
        rank = np.arange(len(r)) - (np.cumsum(n) - n)[r]
        slot, column = rank % wide, first[r] + rank // wide
        self.w = mix(np.arange(wide * len(self.of), dtype=np.uint64) + np.uint64(len(r))).reshape(wide, -1)
        self.at = np.full(self.w.shape, -1, np.int64)
        self.w[slot, column], self.at[slot, column] = w[order], order


def candidates(a: np.ndarray, b: np.ndarray | None, share: int, q: int, limit: int, crowd_a: np.ndarray, crowd_b: np.ndarray, wide: int = 8, slab: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs, not of one crowd, of words of ``a`` and ``b`` at most ``limit`` bits apart of which the low 16 bits, the block, differ in fewer than ``share`` and in each piece before the ``q``-th.

    All words agree in the ``q``-th piece. Without ``b``, pairs within ``a``, each once.
    """
    same, own = b is None, pieces(share)
    bits = [k for m in own[:q] + own[q + 1 :] for k in range(16) if m >> k & 1] if own != [0] else list(range(16))
    bits = bits[: max(0, (max(len(a), 0 if same else len(b)) // 6).bit_length() - 1)]
    used, masks = sum(1 << k for k in bits), []
    for k in range(min(share - 1, len(bits)) + 1):
        for c in combinations(range(len(bits)), k):
            real = sum(1 << bits[x] for x in c)
            if all(real & m or m & ~used for m in own[:q]):
                masks.append(sum(1 << x for x in c))
    left = _Buckets(a, crowd_a, bits, wide)
    right = left if same else _Buckets(b, crowd_b, bits, wide)
    crowded = bool((crowd_a >= 0).any())
    columns = np.arange(len(left.of))
    step = max(1, (1 << 17) // max(1, len(columns)))
    x, d = np.empty((wide, wide, slab), np.uint64), np.empty((wide, wide, slab), np.uint8)
    for s in range(0, len(masks), step):
        m = np.array(masks[s : s + step])[:, None]
        to = left.of ^ m
        start, end = right.first[to], right.first[to + 1]
        if same:
            start, end = np.where(m == 0, columns, start), np.where(to < left.of, start, end)
        of, start, many = np.broadcast_to(columns, to.shape).ravel(), start.ravel(), (end - start).ravel()
        some = many > 0
        of, start, many = of[some], start[some], many[some]
        upto = np.cumsum(many)
        shift = start - (upto - many)
        for p in range(0, int(upto[-1]) if len(upto) else 0, 1 << 15):
            pos = np.arange(p, min(p + (1 << 15), int(upto[-1])))
            k = np.searchsorted(upto, pos, "right")
            ca_all, cb_all = of[k], shift[k] + pos
            if crowded:
                apart = (left.crowd[ca_all] < 0) | (left.crowd[ca_all] != right.crowd[cb_all])
                ca_all, cb_all = ca_all[apart], cb_all[apart]
            for at in range(0, len(ca_all), slab):
                ca, cb = ca_all[at : at + slab], cb_all[at : at + slab]
                n = len(ca)
                xs, ds = (x, d) if n == slab else (np.empty((wide, wide, n), np.uint64), np.empty((wide, wide, n), np.uint8))
                np.bitwise_count(np.bitwise_xor(left.w[:, None, ca], right.w[None, :, cb], out=xs), out=ds)
                hit = np.flatnonzero(ds <= limit)
                if not len(hit):
                    continue
                i, j, k = np.unravel_index(hit, ds.shape)
                v = xs.reshape(-1)[hit]
                i, j, ok = left.at[i, ca[k]], right.at[j, cb[k]], (ca[k] != cb[k]) | (i < j) if same else np.ones(len(hit), bool)
                ok &= (i >= 0) & (j >= 0) & (np.bitwise_count(v & np.uint64(0xFFFF)) < share)
                for e in own[:q]:
                    ok &= (v & np.uint64(e)) != 0
                if ok.any():
                    yield i[ok], j[ok]


def found_by(a: np.ndarray, b: np.ndarray | None, radius: int, block: int, q: int, crowd_a: np.ndarray, crowd_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``a`` and ``b`` (fingerprints; without ``b`` pairs within ``a``) within the radius and not of one crowd that this block and piece are the first to find."""
    share = shares(radius)
    ring = [k % BLOCKS for k in range(BLOCKS + CHAIN - 1)]
    chain = [(block + k) % BLOCKS for k in range(CHAIN)]
    sums = lambda x: sum(x[..., k : k + BLOCKS] for k in range(1, CHAIN)) + x[..., :BLOCKS]
    most = sums(share[ring])
    sides = [x.view(np.uint16).reshape(len(x), BLOCKS) for x in ((a,) if b is None else (a, b))]
    w = [np.ascontiguousarray(x[:, chain]).view(np.uint64)[:, 0] for x in sides]
    for i, j in candidates(w[0], None if b is None else w[1], int(share[block]), q, int(share[chain].sum()) - 1, crowd_a, crowd_b):
        d = np.bitwise_count(sides[0][i] ^ sides[-1][j])
        ok = d.sum(1, dtype=np.int64) <= radius
        i, j, d = i[ok], j[ok], d[ok]
        ok = np.argmax((d < share) & (sums(d[:, ring]) < most), axis=1) == block
        yield i[ok], j[ok]


def all_with_all(a: np.ndarray, b: np.ndarray | None, radius: int, rows: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``a`` and ``b`` (without ``b`` pairs within ``a``) within the radius, some rows of ``a`` at a time."""
    x, y = np.ascontiguousarray(a.T), None if b is None else np.ascontiguousarray(b.T)
    for s in range(0, len(a), rows):
        i, j = within(x[:, s : s + rows], x[:, s:] if y is None else y, radius, y is None)
        yield i + s, j + s if y is None else j


def centres_of(sample: np.ndarray, radius: int) -> tuple[np.ndarray, list[int]]:
    """Fingerprints of a sample that have the most others near them, and how many of the sample are theirs."""
    adjacent = np.eye(len(sample), dtype=bool)
    for i, j in all_with_all(sample, None, radius):
        adjacent[i, j] = adjacent[j, i] = True
    left, found, sizes = adjacent.sum(1), [], []
    while len(left) and len(found) < CROWDS and left.max() > LINKS:
        c = int(left.argmax())
        found.append(c)
        sizes.append(int(left[c]))
        gone = np.flatnonzero(adjacent[c])
        left -= adjacent[:, gone].sum(1)
        adjacent[:, gone] = False
    return sample[found], sizes


def _crowd(fps: np.ndarray, centres: np.ndarray, radius: int) -> np.ndarray:
    """The first centre that is within the radius of each fingerprint, or -1."""
    out = np.full(len(fps), -1, np.int16)
    for k in range(len(centres))[::-1]:
        out[np.bitwise_count(fps ^ centres[k]).sum(1, dtype=np.int64) <= radius] = k
    return out


def _keys(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block and piece the number that stands for both (in the upper bits of a key), and each fingerprint's value there."""
    by_block = fps.view(np.uint16).reshape(len(fps), BLOCKS)
    for block, share in enumerate(shares(radius)):
        for q, m in enumerate(pieces(int(share))):
            yield (block << 4 | q) << 16, (by_block[:, block] & np.uint16(m)).astype(np.int64)


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack([b.column(c).to_numpy().view(np.uint64) for c in FP], axis=1), b.column("node").to_numpy(), b.column("copies").to_numpy()


_MET = "key long, part long, side int, nodes binary, copies binary, crowds binary, fps binary"


def _meeting(distinct: DataFrame, radius: int, group: int) -> DataFrame:
    """Fingerprints packed by block, piece and value, and those of a crowd by its number. Where more than ``group`` meet, they are dealt out, and a part is a pair of deals."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.stack(np.unique(base + v, return_counts=True)) for base, v in _keys(_columns(b)[0], radius)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(got, axis=1)], names=["key", "n"])

    deals: dict[int, int] = {}
    if distinct.count() > group:
        crowded = distinct.mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n > {group}")
        deals = {r.key: -(-r.n // group) for r in crowded.collect()}  # at most 2**16 values of a piece, usually 16 to 64

    sample = distinct.orderBy(F.xxhash64(*FP), *FP).limit(SAMPLE).select(*FP).toArrow()
    centres, sizes = centres_of(np.stack([sample.column(c).to_numpy().view(np.uint64) for c in FP], axis=1), radius)
    total = distinct.count()
    deals |= {-1 - k: max(1, -(-n * total // (sample.num_rows * TILE * 2))) for k, n in enumerate(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps_all, node_all, copies_all = _columns(b)
            crowd_all = _crowd(fps_all, centres, radius)
            own = np.flatnonzero(crowd_all >= 0)
            for base, v, rows in [*((*x, slice(None)) for x in _keys(fps_all, radius)), *([(-CROWDS, CROWDS - 1 - crowd_all[own].astype(np.int64), own)] if len(own) else [])]:
                fps, node, copies, crowd = fps_all[rows], node_all[rows], copies_all[rows], crowd_all[rows]
                at, part, side = np.arange(len(v)), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
                values, of = np.unique(v, return_inverse=True)
                many = np.array([deals.get(base + int(x), 1) for x in values], np.int64)[of]
                if (many > 1).any():
                    at = np.repeat(at, many)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    mine = (mix(node.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)[at]
                    part, side = np.minimum(mine, other) << 32 | np.maximum(mine, other), (mine > other).astype(np.int64)
                    order = np.lexsort((side, part, v[at]))
                else:
                    order = np.argsort(v, kind="stable")
                at, part, side = at[order], part[order], side[order]
                key = base + v[at]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1]))))
                ends = np.append(new, len(at))
                packed = [pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[at]))]) for x, size in ((node, 8), (copies, 8), (crowd, 2), (fps, 8 * LANES))]
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(part[new]), pa.array(side[new].astype(np.int32)), *packed], names=["key", "part", "side", "nodes", "copies", "crowds", "fps"])

    return distinct.mapInArrow(tidy(run), _MET)


def near_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """``(u, v, n)``: for each task a spanning forest of the pairs it finds within the radius, and ``(u, u, n)`` for the documents within it of a node."""
    few = distinct.count() <= TILE

    def compare(t: pa.Table) -> pa.Table:
        if few:
            fps, nodes, copies = _columns(t.combine_chunks())
            sides = [(nodes, copies, fps, None)]
        else:
            side, sides = t.column("side").to_numpy(), []
            for k in (0, 1):
                rows = t.filter(pa.array(side == k))
                if rows.num_rows:
                    nodes, copies, crowd, fps = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("nodes", np.int64), ("copies", np.int64), ("crowds", np.int16), ("fps", np.uint64)))
                    sides.append((nodes, copies, fps.reshape(-1, LANES), crowd.astype(np.int64)))
        key, part = (0, 0) if few else (t.column("key")[0].as_py(), t.column("part")[0].as_py())
        across = part >> 32 != part & 0xFFFFFFFF
        every, copies = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
        near, root, waiting, wait = np.zeros(len(every), np.int64), np.arange(len(every)), [], 0

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if across and len(sides) < 2:
                return
            other = sides[1][2] if across else None
            if few or key < 0:
                yield from all_with_all(sides[0][2], other, radius)
            else:
                yield from found_by(sides[0][2], other, radius, key >> 20, key >> 16 & 15, sides[0][3], sides[-1][3])

        def joined() -> np.ndarray:
            i, j = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            moved = np.flatnonzero(root != np.arange(len(root)))
            return forest(np.concatenate([i, moved]), np.concatenate([j, root[moved]]), len(root))

        for i, j in pairs():
            if not len(i):
                continue
            j = j + len(sides[0][0]) if across else j
            np.add.at(near, i, copies[j])
            np.add.at(near, j, copies[i])
            waiting.append((i, j))
            wait += len(i)
            if wait > 1 << 20:
                root, waiting, wait = joined(), [], 0
        if waiting:
            root = joined()
        moved, linked = np.flatnonzero(root != np.arange(len(every))), np.flatnonzero(near)
        u, v = np.concatenate([every[moved], every[linked]]), np.concatenate([every[root[moved]], every[linked]])
        return pa.table({"u": u, "v": v, "n": np.concatenate([np.zeros(len(moved), np.int64), near[linked]])})

    rows = distinct.select("node", "copies", *FP)
    met = rows.groupBy() if few else _meeting(rows, radius, GROUP).groupBy("key", "part")
    return cut(met.applyInArrow(compare, "u long, v long, n long"), "near")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(__llm_id, __llm_key, kept_id, kept_key, size, links)`` for every document that has a near copy, the kept one too.

    The kept one of a group is that with the least ``doc_id`` (a null one last), then text hash. Documents are counted by
    fingerprint and fingerprints by group before anything is joined, so that no task holds a group.
    """
    fps = cut(fingerprints(docs).dropDuplicates([ID, KEY]), "fingerprints")
    order = F.struct((F.col(ID) == NO_ID).alias("none"), F.col(ID).alias("id"), F.col(KEY).alias("key"))
    one = fps.groupBy(*FP).agg(F.count("*").alias("copies"), F.min(order).alias("k")).select(*FP, "copies", "k.id", "k.key")
    distinct = cut(one.withColumn("node", F.monotonically_increasing_id()), "distinct")
    near = near_edges(distinct, radius)
    comp = components(near.where("u <> v").select("u", "v"))
    links = near.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    nodes = distinct.join(comp, "node", "left").join(links, "node", "left")
    nodes = cut(nodes.select(*FP, F.coalesce("root", "node").alias("root"), "copies", "id", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links")), "nodes")
    least = F.struct((F.col("id") == NO_ID).alias("none"), "id", "key")
    roots = nodes.groupBy("root").agg(F.min(least).alias("k"), F.sum("copies").alias("size")).where("size > 1").select("root", F.col("k.id").alias("kept_id"), F.col("k.key").alias("kept_key"), "size")
    return fps.join(nodes.select(*FP, "root", "links").join(roots, "root"), FP).select(ID, KEY, "kept_id", "kept_key", "size", "links")


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, kept_id, links)`` for every document of a group of near copies; the kept one, the group's class, stands beside itself."""
    return groups(docs, radius).select(real_id().alias("doc_id"), real_id("kept_id").alias("kept_id"), "links")


@passing
def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat ``doc_id`` and text, one stays."""
    gone = groups(docs, radius).where(f"{ID} <> kept_id or {KEY} <> kept_key").select(ID, KEY)
    return keyed(docs).dropDuplicates([ID, KEY]).join(gone, [ID, KEY], "left_anti").drop(ID, KEY)
