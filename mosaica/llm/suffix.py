"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix is ordered only through its first ``threshold`` words (its window), most significant digit first; suffixes
that are still equal after the last pass are exactly the windows that repeat. A window's digits are the ten words whose
hash is least among its tens of words (its anchor), then the first half of its words, then the second. Equal windows have
equal anchors at equal places, and one anchor stands for the twenty windows around it on average, so that the first pass
moves one suffix in about twenty:

1. anchors are counted over the corpus; a digit that occurs once ends its windows there;
2. the windows left over, all of an anchor's in one row, are sorted by the first digit; within a digit by the second,
   which ends the windows that are alone; and those left by the third. Equal groups are the repeated windows, and the least
   ``(doc_id, position)`` of a group is its first occurrence.

A digit with more than :data:`HOT` anchors (a notice that a third of all texts carry) isn't sorted in one task: its windows
are subdivided by their further digits at once, grouped with partial aggregates for their first occurrence, and joined
with it; an adaptive skew join splits a passage that is frequent as a whole. Both ways give the same rows.

Words are runs of bytes between ASCII white space, compared as they stand, by 64 bits of hash for each digit: 192 bits that
cover every word of a window, most of them twice. Texts aren't compared again: moving the words of the windows would take more
disk than the texts themselves.

Defined cases: texts shorter than the threshold, empty and null ones have no window; a passage that repeats within one
document counts as repeated; rows that repeat ``doc_id`` and text are one document; a null ``doc_id`` (or one that is no
integer) comes first; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ID, KEY, NO_ID, SOLID, cut, flat, keyed, mix, parts, passing, ranges_hash, real_id, texts_of, tidy, words

#: A passage is repeated if this many words in a row are.
THRESHOLD = 50
DIGIT = 10
#: Anchors of a digit beyond which its windows are not sorted in one task. The result doesn't depend on it.
HOT = 20_000
RUNS = f"{ID} long, {KEY} long, pos long, n long, first_id long, first_key long, first_pos long"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Windows:
    """The windows of a run of texts: ``least`` is each window's anchor digit, ``anchor`` whether a digit is one."""

    def __init__(self, column: pa.Array, threshold: int):
        raw, off = flat(column)
        self.raw, (self.starts, self.ends, self.at) = raw, words(raw, off, SOLID)
        n, span = len(self.starts), threshold - DIGIT + 1
        if n < threshold:
            self.digit = self.least = np.zeros(0, np.uint64)
            self.valid = self.anchor = np.zeros(0, bool)
            self.doc = self.word = np.zeros(0, np.int64)
            return
        self.word = ranges_hash(raw, self.starts, self.ends)
        p = np.arange(n - DIGIT + 1)
        self.digit = ranges_hash(self.word, p, p + DIGIT)
        self.least = _sliding(self.digit, span, np.minimum)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.valid = self.doc[: len(self.least)] == self.doc[threshold - 1 :]
        cover = np.zeros(len(self.digit) + span - 1, np.uint64)
        cover[span - 1 : span - 1 + len(self.least)] = np.where(self.valid, self.least, 0)
        self.anchor = (_sliding(cover, span, np.maximum) == self.digit) & (self.digit > 0)


def _pass_one(docs: DataFrame, threshold: int) -> DataFrame:
    """``(digit, __llm_id, __llm_key, n)``: the anchor digits of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            w = Windows(b.column("text"), threshold)
            p = np.flatnonzero(w.anchor)
            if not len(p):
                continue
            digit, doc = w.digit[p], w.doc[p]
            order = np.lexsort((digit, doc))
            digit, doc = digit[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (doc[1:] != doc[:-1]))))
            rows = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(digit[new].view(np.int64)), b.column(ID).take(rows), b.column(KEY).take(rows), pa.array(np.diff(np.append(new, len(doc))))], names=["digit", ID, KEY, "n"])

    return texts_of(docs).mapInArrow(tidy(run), f"digit long, {ID} long, {KEY} long, n long")


def _windows(texts: DataFrame, threshold: int, which: str, single: bool) -> DataFrame:
    """Of the windows whose anchor digit is in the column ``which``, those of each anchor, from window ``pos`` on: ``(digit, __llm_id, __llm_key, pos, rest)``.

    ``rest`` has 16 bytes for each window, its second and third digit; with ``single`` each window is a row, ``(digit, second, third, ...)``.
    """
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            w = Windows(b.column("text"), threshold)
            lists = b.column(which)
            listed = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            salt = mix(np.arange(b.num_rows, dtype=np.uint64))
            i = np.flatnonzero(w.valid)
            i = i[np.isin(w.least[i] ^ salt[w.doc[i]], listed ^ salt[of])]
            if not len(i):
                continue
            second, third = ranges_hash(w.word, i, i + half), ranges_hash(w.word, i + half, i + threshold)
            if single:
                doc = w.doc[i]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (w.least[i], second, third)), b.column(ID).take(rows), b.column(KEY).take(rows), pa.array((i - w.at[doc]).astype(np.int64))], names=["digit", "second", "third", ID, KEY, "pos"])
                continue
            anchors = np.flatnonzero(w.anchor)
            a = np.searchsorted(anchors, i)
            while len(wrong := np.flatnonzero(w.digit[anchors[a]] != w.least[i])):
                a[wrong] += 1
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1) | (w.doc[i[1:]] != w.doc[i[:-1]]))))
            rest = np.stack([second, third], axis=1)
            ends = np.append(new, len(i)).astype(np.int32) * 16
            blob = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rest.tobytes())])
            doc = w.doc[i[new]]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(w.least[i[new]].view(np.int64)), b.column(ID).take(rows), b.column(KEY).take(rows), pa.array((i[new] - w.at[doc]).astype(np.int64)), blob], names=["digit", ID, KEY, "pos", "rest"])

    return texts.mapInArrow(tidy(run), f"digit long, {'second long, third long, ' if single else ''}{ID} long, {KEY} long, pos long" + ("" if single else ", rest binary"))


def _equal(group: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: ``(order, group)`` of the elements that share group and digit with another; order is stable."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))) if len(order) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    many = np.bincount(number)[number] > 1 if len(order) else new
    return order[many], number[many]


def _sorted_digits(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The second and third pass over whole digits; rows come sorted by digit, document and position."""
    digit, blob = b.column("digit").to_numpy(), b.column("rest")
    off = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + b.num_rows + 1]
    rest = np.frombuffer(blob.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64).reshape(-1, 2)
    count = np.diff(off) // 16
    row = np.repeat(np.arange(b.num_rows), count)
    at, group = _equal((np.cumsum(np.concatenate(([0], digit[1:] != digit[:-1]))))[row], rest[:, 0])
    o, group = _equal(group, rest[at, 1])
    at = at[o]
    if not len(at):
        return
    r = row[at]
    own = np.stack([b.column(ID).to_numpy()[r], b.column(KEY).to_numpy()[r], b.column("pos").to_numpy()[r] + at - (np.cumsum(count) - count)[r]], axis=1)
    lead = np.concatenate(([True], group[1:] != group[:-1]))
    out = np.concatenate([own, own[np.flatnonzero(lead)[np.cumsum(lead) - 1]]], axis=1)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    step = np.concatenate(([True], (out[1:, :2] != out[:-1, :2]).any(1) | (out[1:, 2] != out[:-1, 2] + 1) | (out[1:, 3:5] != out[:-1, 3:5]).any(1) | (out[1:, 5] != out[:-1, 5] + 1)))
    s = np.flatnonzero(step)
    n = np.diff(np.append(s, len(out)))
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[s, c])) for c in range(3)] + [pa.array(n)] + [pa.array(np.ascontiguousarray(out[s, c])) for c in range(3, 6)], names=[ID, KEY, "pos", "n", "first_id", "first_key", "first_pos"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows in runs, each with its first occurrence. Between batches the rows of the digit under way are kept: :data:`HOT` at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        digit = b.column("digit").to_numpy()
        if held and held[-1].column("digit")[-1].as_py() != digit[0]:
            yield from _sorted_digits(pa.concat_batches(held))
            held = []
        begin = int(np.searchsorted(digit, digit[-1]))  # of the last digit
        if begin:
            yield from _sorted_digits(pa.concat_batches([*held, b.slice(0, begin)]))
            held = []
        held.append(b.slice(begin))
    if held:
        yield from _sorted_digits(pa.concat_batches(held))


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(__llm_id, __llm_key, pos, n, first_id, first_key, first_pos)``: ``n`` repeated windows in a row from word ``pos`` on, and where they first occur."""
    if threshold < DIGIT:
        raise ValueError(f"threshold must be at least {DIGIT}")
    anchors = _pass_one(docs, threshold)
    often = anchors.groupBy("digit").agg(F.sum("n").alias("of")).where("of > 1")
    hot = F.col("of") > HOT
    lists = anchors.drop("n").join(often, "digit").groupBy(ID, KEY).agg(F.collect_set(F.when(~hot, F.col("digit"))).alias("cold"), F.collect_set(F.when(hot, F.col("digit"))).alias("hot"))
    lists = cut(lists, "digits")
    once = texts_of(docs).groupBy(ID, KEY).agg(F.first("text").alias("text"))  # of repeated rows, one
    texts = lambda which: once.join(lists.where(F.size(which) > 0).select(ID, KEY, which), [ID, KEY])
    found = _windows(texts("cold"), threshold, "cold", False).repartition("digit").sortWithinPartitions("digit", ID, KEY, "pos").mapInArrow(tidy(_runs), RUNS)
    if not lists.where(F.size("hot") > 0).limit(1).count():
        return found
    # one plan with the others, which shuffles the texts once
    digits, every = ["digit", "second", "third"], _windows(texts("hot"), threshold, "hot", True)
    first = every.groupBy(*digits).agg(F.min(F.struct(ID, KEY, "pos")).alias("f"), F.count("*").alias("of")).where("of > 1")
    many = every.join(first, digits).select(ID, KEY, "pos", F.lit(1).cast("long").alias("n"), F.col(f"f.{ID}").alias("first_id"), F.col(f"f.{KEY}").alias("first_key"), F.col("f.pos").alias("first_pos"))
    return found.unionByName(many)


def spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, start_word, n_words, first_doc_id, first_start_word)``: the repeated passages of every document.

    A passage is a run of repeated windows that first occur in a row in one place; the first occurrence is a row too,
    beside itself. Passages of a document may overlap.
    """
    r = repeated_windows(docs, threshold)
    at = Window.partitionBy(ID, KEY, "first_id", "first_key", F.col("first_pos") - F.col("pos")).orderBy("pos")
    new = F.coalesce(F.col("pos") > F.max(F.col("pos") + F.col("n")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    r = r.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(at))
    r = r.groupBy(ID, KEY, "first_id", "first_key", (F.col("first_pos") - F.col("pos")).alias("shift"), "run").agg(F.min("pos").alias("start_word"), F.max(F.col("pos") + F.col("n")).alias("end"))
    return r.select(real_id().alias("doc_id"), "start_word", (F.col("end") - F.col("start_word") + threshold - 1).alias("n_words"), real_id("first_id").alias("first_doc_id"), (F.col("start_word") + F.col("shift")).alias("first_start_word"))


@passing
def drop_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the passages that occurred before: each repeated window's words stay only at its first occurrence.

    A changed text loses those words with the white space after them, and ``n_chars`` follows; a document of which
    nothing but white space is left goes.
    """
    r = repeated_windows(docs, threshold).where(f"{ID} <> first_id or {KEY} <> first_key or pos <> first_pos")
    lists = r.groupBy(ID, KEY).agg(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n") + threshold - 1).alias("end"))).alias("__llm_gone"))
    inner = "__llm_text"
    cutting = keyed(docs).join(lists, [ID, KEY], "left").withColumn(inner, F.coalesce("text", F.lit("")))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, inner):
            column, gone = b.column(inner), b.column("__llm_gone")
            cols = {c: b.column(c) for c in names}
            if gone.null_count < b.num_rows:
                raw, off = flat(column)
                starts, _, at = words(raw, off, SOLID)
                new, stay = [], np.ones(b.num_rows, bool)
                for r in range(b.num_rows):
                    if not gone[r].is_valid:
                        new.append(cols["text"][r].as_py())
                        continue
                    n = int(at[r + 1] - at[r])
                    mark = np.zeros(n + 1, np.int64)
                    for g in gone[r].as_py():
                        mark[g["pos"]] += 1
                        mark[g["end"]] -= 1
                    keep = np.cumsum(mark[:n]) == 0
                    edge = np.append(starts[at[r] : at[r + 1]], off[r + 1])
                    edge[0] = edge[0] if not keep[0] else off[r]
                    change = np.flatnonzero(np.concatenate(([True], keep[1:] != keep[:-1])))
                    pieces = [raw[edge[s] : edge[e]].tobytes() for s, e in zip(change, np.append(change[1:], n)) if keep[s]]
                    new.append(b"".join(pieces).decode())
                    stay[r] = bool(pieces)
                cols["text"] = pa.array(new, cols["text"].type)
                if "n_chars" in cols:
                    changed = gone.is_valid().to_numpy(zero_copy_only=False)
                    was = cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(t) if c else w for t, c, w in zip(new, changed, was)], cols["n_chars"].type)
                mask = pa.array(stay)
                cols = {c: v.filter(mask) for c, v in cols.items()}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return cutting.select(*(F.col(f"`{c}`") for c in names), "__llm_gone", inner).mapInArrow(tidy(run), docs.schema)


#: :func:`spans` of ``documents`` with its defaults, for DuckDB; it takes each ``doc_id`` for one document.
SPANS_SQL = f"""
WITH d AS (SELECT DISTINCT coalesce(doc_id, {NO_ID}) AS id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, regexp_extract_all(t, '[^ \\t\\n\\r\\v\\f]+') AS ws FROM d),
h AS (
  SELECT id, unnest(range(len(ws) - {THRESHOLD - 1})) AS pos, unnest(list_transform(range(len(ws) - {THRESHOLD - 1}), lambda i: md5(array_to_string(ws[i + 1 : i + {THRESHOLD}], ' ')))) AS h
  FROM w WHERE len(ws) >= {THRESHOLD}
), f AS (
  SELECT h, min((id, pos)) AS f FROM h GROUP BY h HAVING count(*) > 1
), m AS (
  SELECT id, pos, f[1] AS first_id, f[2] - pos AS shift FROM h JOIN f USING (h)
), r AS (
  SELECT *, pos - row_number() OVER (PARTITION BY id, first_id, shift ORDER BY pos) AS run FROM m
)
SELECT nullif(id, {NO_ID}) AS doc_id, min(pos) AS start_word, max(pos) - min(pos) + {THRESHOLD} AS n_words, nullif(first_id, {NO_ID}) AS first_doc_id, min(pos) + shift AS first_start_word
FROM r GROUP BY id, first_id, shift, run
"""
