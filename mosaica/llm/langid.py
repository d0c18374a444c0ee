"""Language identification, words first, backing off to shorter and shorter character n-grams.

The model is fitted to a bounded sample of labelled documents: of each language the ``per_language`` with the least
hash of ``doc_id`` and text. It has the log frequency of every word that occurs ``min_count`` times in a language, and
of the character n-grams of the languages' words, each with add-half smoothing. A known word scores its log
frequencies; an unseen word scores the mean of those of its known n-grams, of the greatest length (5 to 1) at which half
of its n-grams are known. A text's score is the sum over all its words, and the language with the best one is its
language; ties go to the alphabetically first.

Words are split at ASCII white space, in lower case, without what isn't a letter at their ends. Words are looked up by hash, all
of a batch at once: what a worker hasn't met before is scored once for each distinct word.

Defined cases: a null or empty text, or one without letters or known n-grams, has language ``und`` and margin 0; repeated
rows score alike; a null or empty label is no label; without labels every language is ``und``; a ``doc_id`` that is null or no
integer is null; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SOLID, flat, long_id, parts, ranges_hash, tidy, words
from .vocab import CACHE_WORDS

#: Labelled documents of each language to fit to.
PER_LANGUAGE = 400
MIN_COUNT = 2
LONGEST = 5
_ENDS = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def word_of(raw: str) -> str:
    return _ENDS.sub("", raw.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """``tables[0]`` has words, ``tables[n]`` n-grams: string -> log frequencies by language. It is sent as matrices and the strings of their rows."""

    def __init__(self, languages: list[str], tables: list[dict[str, np.ndarray]]):
        self.tables = tables
        self.__setstate__((languages, [list(t) for t in tables], [np.array(list(t.values()), float).reshape(len(t), len(languages)) for t in tables]))

    def __getstate__(self):
        return self.languages, [list(x) for x in self.row], self.values

    def __setstate__(self, state) -> None:
        self.languages, names, self.values = state
        self.row = [{x: k for k, x in enumerate(n)} for n in names]

    def score(self, word: str) -> np.ndarray:
        return self.scores([word])[0]

    def scores(self, found: list[str]) -> np.ndarray:
        """A row for each word: they are looked up one by one, and the values of all are averaged at once."""
        out = np.zeros((len(found), len(self.languages)))
        of, hits, many = ([[] for _ in self.row] for _ in range(3))
        whole = self.row[0]
        for k, w in enumerate(found):
            n, hit = 0, [whole[w]] if w in whole else []
            if not hit and w:
                for n in range(LONGEST, 0, -1):
                    row, g = self.row[n], grams(w, n)
                    hit = [row[x] for x in g if x in row]
                    if hit and 2 * len(hit) >= len(g):
                        break
                else:
                    hit = []
            if hit:
                of[n].append(k)
                hits[n] += hit
                many[n].append(len(hit))
        for n, m in enumerate(many):
            if m:
                size = np.array(m)
                out[of[n]] = np.add.reduceat(self.values[n][hits[n]], np.cumsum(size) - size, axis=0) / size[:, None]
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, min_count: int = MIN_COUNT) -> Model:
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where("lang <> ''")
    order = F.xxhash64("doc_id", "text")
    slim = labelled.select("lang", order.alias("h"))
    best = Window.partitionBy("lang").orderBy("h")
    picked = slim.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("most"))
    sample = labelled.join(F.broadcast(picked), "lang").where(order <= F.col("most"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(w for w in map(word_of, _SPACE.split(text)) if w)
        for lang, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    rows = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs, ws, ns = (rows.column(c).to_pylist() for c in ("lang", "word", "n"))
    languages = sorted(set(langs))
    at = {x: k for k, x in enumerate(languages)}
    counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    for lang, w, n in zip(langs, ws, ns):
        for k in range(LONGEST + 1):
            for g in [w] if k == 0 else grams(w, k):
                row = counts[k].get(g)
                if row is None:
                    row = counts[k][g] = np.zeros(len(languages))
                row[at[lang]] += n
    tables = []
    for c in counts:
        total = np.sum(list(c.values()), axis=0) if c else 0
        kept = {g: v for g, v in c.items() if v.max() >= min_count}
        tables.append({g: np.log((v + 0.5) / (total + 0.5 * (len(kept) + 1))) for g, v in kept.items()})
    return Model(languages, tables)


class Scorer:
    """Scores of the white-space words met so far, by their hash."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = np.zeros((0, len(self.model.languages)))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the words' scores and number of words, of each text."""
        raw, off = flat(column)
        starts, ends, at = words(raw, off, SOLID)
        total, n = np.zeros((len(off) - 1, len(self.model.languages))), np.diff(at)
        if not len(starts) or not self.model.languages:
            return total, n
        h = ranges_hash(raw, starts, ends)
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.clear()
        spot = np.searchsorted(self.known, distinct)
        new = np.flatnonzero((spot == len(self.known)) | (self.known[np.minimum(spot, len(self.known) - 1)] != distinct)) if len(self.known) else np.arange(len(distinct))
        if len(new):
            texts = [raw[starts[k] : ends[k]].tobytes().decode() for k in first[new].tolist()]
            rows = self.model.scores([t.lower() if t.isascii() and t.isalpha() else word_of(t) for t in texts])
            known, row = np.concatenate([self.known, distinct[new]]), np.concatenate([self.row, len(self.rows) + np.arange(len(new))])
            order = np.argsort(known)
            self.known, self.row, self.rows = known[order], row[order], np.concatenate([self.rows, rows])
        score = self.rows[self.row[np.searchsorted(self.known, distinct)]][of]
        has = n > 0
        total[has] = np.add.reduceat(score, at[:-1][has], axis=0)
        return total, n


def best(model: Model, total: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and margin from sums of scores and numbers of words."""
    some = total.any(1) if model.languages else np.zeros(len(n), bool)
    if not some.any():
        return ["und"] * len(n), np.zeros(len(n))
    k = total.argmax(1)
    lead = total[np.arange(len(n)), k]
    rest = total.copy()
    rest[np.arange(len(n)), k] = -np.inf
    second = rest.max(1) if total.shape[1] > 1 else lead
    return [model.languages[x] if ok else "und" for x, ok in zip(k, some)], np.where(some, (lead - second) / np.maximum(n, 1), 0.0)


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """``(doc_id, language, margin)`` for every row; ``margin``: by how much the best language leads, per word."""
    model = model or fit(docs, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in parts(batches):
            language, margin = best(sent.value, *scorer.scores(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(language, pa.string()), pa.array(margin, pa.float64())], names=["doc_id", "language", "margin"])

    return docs.select(long_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id long, language string, margin double")
