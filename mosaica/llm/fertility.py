"""Quality rules by tokeniser fertility.

Every white-space word of a text is encoded with a public byte-fallback vocabulary; from the ids come characters per
token, the share of byte-fallback tokens and the entropy of the tokens in bits. Texts are compared with those of the
same language (or, where that is unknown, the same script) and the same power of two of tokens, their class: a text is
rejected when characters per token leave the band around the median on either side, fallback rises above its band, or entropy
falls below its own. As entropy grows with the number of tokens, it is taken as its distance from the median of all texts of the
same power of two.

A band is ``k`` robust deviations (median absolute deviation x 1.4826) wide, or the floor given. Its middle and deviation are
the class's own and the language's, weighted by the class's texts and by ``prior``: one rule for classes of all sizes, in which a
class of few texts goes by its language and a large one by itself. The language's deviation counts more for texts shorter than
its median, by the root of how many powers of two: means over few tokens vary more.

Medians are exact, of measures in steps of 1e-4: one pass over the texts counts the values of each class, and all else is worked out on
those counts, whose number doesn't grow with the corpus.

Defined cases: a null, empty or blank text has no tokens and is rejected; a null or empty language goes by script;
repeated rows are judged alike; the only text of its language is accepted; an empty table gives an empty result; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZERS, cut, parts, passing, tidy
from .vocab import Pieces

K = 5.0
#: As many texts of a class count as much as its language.
PRIOR = 30
#: Least half width of a band: a share of the median, a share of tokens, bits.
FLOORS = {"cpt": 0.03, "fallback": 0.05, "entropy": 0.2}
#: Steps of a measure for one.
STEPS = 10_000
PRE = "__llm_"
_SCRIPTS = [("latin", "A-Za-zÀ-ɏ"), ("greek", "Ͱ-Ͽ"), ("cyrillic", "Ѐ-ԯ"), ("hebrew", "֐-׿"), ("arabic", "؀-ۿ"), ("devanagari", "ऀ-ॿ"), ("thai", "฀-๿"), ("kana", "぀-ヿ"), ("han", "一-鿿"), ("hangul", "가-힯")]


def script_of(text: str) -> str:
    """The script with most letters; ties go to the earlier in the list, no letters to ``none``."""
    import re

    most, name = 0, "none"
    for script, chars in _SCRIPTS:
        n = len(re.findall(f"[{chars}]", text))
        if n > most:
            most, name = n, script
    return f"script:{name}"


def measures(texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, characters per token, fallback share and entropy of each text; NaN without tokens."""
    blobs, chars = [], np.zeros(len(texts))
    for k, t in enumerate(texts):
        ws = t.split()
        blobs.append(b"".join(map(pieces.__getitem__, ws)))
        chars[k] = sum(map(len, ws))
    n = np.array([len(b) // 4 for b in blobs], np.int64)
    ids = np.frombuffer(b"".join(blobs), np.int32)
    doc = np.repeat(np.arange(len(texts)), n)
    fallback = np.bincount(doc[pieces.is_byte[ids]], minlength=len(texts))
    both = np.sort(doc * pieces.size + ids)
    new = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(both)))
    with np.errstate(all="ignore"):
        of = both[new] // pieces.size if len(new) else np.zeros(0, np.int64)
        entropy = np.log2(n) - np.bincount(of, count * np.log2(count), minlength=len(texts)) / n
        return n, chars / n, fallback / n, np.where(n > 0, np.maximum(entropy, 0), np.nan)


def measured(docs: DataFrame, folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``__llm_group``, ``__llm_n``, ``__llm_cpt``, ``__llm_fallback`` and ``__llm_entropy``."""
    has_lang = "lang" in docs.columns
    names = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(folder)
        for b in parts(batches, f"{PRE}text"):
            texts = b.column(f"{PRE}text").to_pylist()
            langs = b.column("lang").to_pylist() if has_lang else [None] * len(texts)
            group = [str(g) if g not in (None, "") else script_of(t) for g, t in zip(langs, texts)]
            n, cpt, fallback, entropy = measures(texts, pieces)
            none = n == 0
            extra = [pa.array(group), pa.array(n), *(pa.array(x, mask=none) for x in (cpt, fallback, entropy))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + extra, names=[*names, *(PRE + c for c in ("group", "n", "cpt", "fallback", "entropy"))])

    schema = docs.select(*(F.col(f"`{c}`") for c in names)).schema
    for c, kind in (("group", "string"), ("n", "long"), ("cpt", "double"), ("fallback", "double"), ("entropy", "double")):
        schema = schema.add(PRE + c, kind)
    return docs.withColumn(f"{PRE}text", F.coalesce("text", F.lit(""))).mapInArrow(tidy(run), schema)


def _median(h: DataFrame, keys: list[str], value: str, count: str, name: str) -> DataFrame:
    """The lower median of ``value`` for each of ``keys``, exactly, from counts."""
    h = h.groupBy(*keys, value).agg(F.sum(count).alias("__c"))
    own = Window.partitionBy(*keys)
    upto = F.sum("__c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    h = h.withColumn("__upto", upto).withColumn("__all", F.sum("__c").over(own)).where("__upto >= (__all + 1) div 2")
    return h.groupBy(*keys).agg(F.min(value).alias(name), F.max("__all").alias(f"{name}_n"))


def bands(counts: DataFrame, k: float, prior: float) -> DataFrame:
    """``(g, o, m, v, c)``, how often a measure has a value in a class -> ``(g, o, <m>_mid, <m>_width)``, one row for each class."""
    usual = _median(counts.where("m = 'entropy'"), ["o"], "v", "c", "usual").select("o", "usual", F.lit("entropy").alias("m"))
    counts = counts.join(usual, ["o", "m"], "left").withColumn("v", F.col("v") - F.coalesce("usual", F.lit(0)))

    def level(keys: list[str], tag: str) -> DataFrame:
        mid = _median(counts, keys, "v", "c", f"{tag}mid")
        away = counts.join(mid, keys).withColumn("away", F.abs(F.col("v") - F.col(f"{tag}mid")))
        return mid.join(_median(away, keys, "away", "c", f"{tag}dev").drop(f"{tag}dev_n"), keys)

    octave = _median(counts.where("m = 'cpt'"), ["g"], "o", "c", "o_mid").select("g", "o_mid")
    both = level(["g", "o", "m"], "c_").join(level(["g", "m"], "l_"), ["g", "m"]).join(octave, "g")
    n, p = F.col("c_mid_n"), F.lit(float(prior))
    short = F.sqrt(F.pow(F.lit(2.0), F.greatest(F.col("o_mid") - F.col("o"), F.lit(0))))
    both = both.withColumn("mid", (n * F.col("c_mid") + p * F.col("l_mid")) / (n + p) / STEPS)
    both = both.withColumn("dev", (n * F.col("c_dev") + p * F.col("l_dev") * short) / (n + p) / STEPS)
    both = both.join(usual, ["o", "m"], "left").withColumn("mid", F.col("mid") + F.coalesce("usual", F.lit(0)) / STEPS)
    floor = F.when(F.col("m") == "cpt", F.col("mid") * FLOORS["cpt"]).when(F.col("m") == "fallback", FLOORS["fallback"]).otherwise(FLOORS["entropy"])
    both = both.withColumn("width", F.greatest(F.col("dev") * (k * 1.4826), floor))
    return both.groupBy("g", "o").agg(*(F.max(F.when(F.col("m") == m, F.col(x))).alias(f"{m}_{x}") for m in FLOORS for x in ("mid", "width")))


def judged(docs: DataFrame, k: float = K, prior: float = PRIOR, folder: str = TOKENIZERS, keep: list[str] | None = None) -> DataFrame:
    """:func:`measured` with ``__llm_ok``."""
    seen = cut(measured(docs, folder, keep), "fertility")
    octave = F.floor(F.log2(f"{PRE}n")).cast("int")
    measure = {"cpt": F.col(f"{PRE}cpt"), "fallback": F.col(f"{PRE}fallback"), "entropy": F.col(f"{PRE}entropy")}
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.round(x * STEPS).cast("long").alias("v")) for m, x in measure.items())))
    slim = seen.where(f"{PRE}n > 0").select(F.col(f"{PRE}group").alias("g"), octave.alias("o"), values.alias("x")).select("g", "o", "x.m", "x.v")
    counts = cut(slim.groupBy("g", "o", "m", "v").agg(F.count("*").alias("c")), "counts")
    # written, so that its size is known: a few rows for each language are broadcast, and only a table beyond the threshold is shuffled with the texts
    table = cut(bands(counts, k, prior), "bands").withColumnsRenamed({"g": f"{PRE}g", "o": f"{PRE}o"} | {f"{m}_{x}": f"{PRE}{m}_{x}" for m in FLOORS for x in ("mid", "width")})
    out = seen.join(table, (F.col(f"{PRE}group") == F.col(f"{PRE}g")) & (octave == F.col(f"{PRE}o")), "left")
    off = {m: x - F.col(f"{PRE}{m}_mid") for m, x in measure.items()}
    ok = (F.abs(off["cpt"]) <= F.col(f"{PRE}cpt_width")) & (off["fallback"] <= F.col(f"{PRE}fallback_width")) & (-off["entropy"] <= F.col(f"{PRE}entropy_width"))
    return out.select(*(F.col(f"`{c}`") for c in seen.columns), F.coalesce(ok, F.lit(False)).alias(f"{PRE}ok"))


def accepted(docs: DataFrame, k: float = K, prior: float = PRIOR, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, band, n_tokens, chars_per_token, fallback_share, entropy)`` of the documents that pass."""
    have = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    j = judged(docs.select(*have), k, prior, folder, ["doc_id"]).where(f"{PRE}ok")
    return j.select("doc_id", F.col(f"{PRE}group").alias("band"), F.col(f"{PRE}n").alias("n_tokens"), F.col(f"{PRE}cpt").alias("chars_per_token"), F.col(f"{PRE}fallback").alias("fallback_share"), F.col(f"{PRE}entropy").alias("entropy"))


@passing
def keep_good(docs: DataFrame, k: float = K, prior: float = PRIOR, folder: str = TOKENIZERS) -> DataFrame:
    """``docs`` without the rejected documents."""
    return judged(docs, k, prior, folder).where(f"{PRE}ok").select(*(F.col(f"`{c}`") for c in docs.columns))
