"""Eleven external measures from the contingency of ``_class`` and ``_label``. Noise counts as a label.

The pairwise counts come from the contingency, not from pairs of rows: C(n_ij) summed over the cells gives the pairs
together in both, and so on. Everything is one grouping of the rows and a few of its cells; one row comes back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..modality import CLASS, LABEL, MultiFrame


@dataclass(frozen=True)
class Counts:
    """Rows; pairs together in both, in classes, in labels; and the sums that the conjugate measures need."""

    n: int
    cells: int
    classes: int
    labels: int
    f1: float
    most: int
    entropy: float
    class_entropy: float
    label_entropy: float
    joint: float

    @property
    def pairs(self) -> dict[str, int]:
        all_ = self.n * (self.n - 1) // 2
        tp, fp, fn = self.cells, self.labels - self.cells, self.classes - self.cells
        return {"tp": tp, "fp": fp, "fn": fn, "tn": all_ - tp - fp - fn}


def _comb(c: str):
    x = F.col(c).cast("decimal(19,0)")
    return F.sum(x * (x - 1) / 2).cast("decimal(38,0)")


def counts(df: DataFrame, cls: str = CLASS, label: str = LABEL) -> Counts:
    cells = df.groupBy(F.col(cls).alias("i"), F.col(label).alias("j")).agg(F.count("*").alias("nij"))
    rows = cells.groupBy("i").agg(F.sum("nij").alias("a"), F.max("nij").alias("most"))
    cols = cells.groupBy("j").agg(F.sum("nij").alias("b"))
    full = cells.join(rows.drop("most"), "i").join(cols, "j")
    ratio = lambda p, q: F.col(p) / F.col(q)
    f = 2 * ratio("nij", "a") * ratio("nij", "b") / (ratio("nij", "a") + ratio("nij", "b"))
    best = full.groupBy("j").agg(F.max(f).alias("f"), F.first("b").alias("b")).agg(F.sum(F.col("b") * F.col("f")).alias("f1"))
    inner = full.agg(_comb("nij").alias("cells"), F.sum(F.col("nij") * F.log(ratio("nij", "a"))).alias("entropy"), F.sum(F.col("nij") * F.log(F.col("nij") / (F.col("a").cast("double") * F.col("b")))).alias("joint"), F.sum("nij").alias("n"))
    by_class = rows.agg(_comb("a").alias("classes"), F.sum("most").alias("most"), F.sum(F.col("a") * F.log("a")).alias("ca"))
    by_label = cols.agg(_comb("b").alias("labels"), F.sum(F.col("b") * F.log("b")).alias("cb"))
    r = inner.crossJoin(best).crossJoin(by_class).crossJoin(by_label).first()
    n = int(r.n or 0)
    if not n:
        raise ValueError("no rows with class and label")
    log_n = math.log(n)
    return Counts(n, int(r.cells), int(r.classes), int(r.labels), r.f1 / n, int(r.most), -r.entropy / n, log_n - r.ca / n, log_n - r.cb / n, r.joint / n)


class External(Enum):
    RAND = "rand"
    JACCARD = "jaccard"
    FOWLKES_MALLOWS = "fowlkes_mallows"
    PHI = "phi"
    F1 = "f1"
    PURITY = "purity"
    ENTROPY = "entropy"
    MINKOWSKI = "minkowski"
    ADJUSTED_RAND = "adjusted_rand"
    GOODMAN_KRUSKAL = "goodman_kruskal"
    VAR_INFO = "var_info"

    def evaluate(self, frame: MultiFrame | DataFrame) -> float:
        return of(counts(frame.df if isinstance(frame, MultiFrame) else frame))[self.value]

    @staticmethod
    def pairwise(frame: MultiFrame | DataFrame) -> dict[str, float]:
        v = of(counts(frame.df if isinstance(frame, MultiFrame) else frame))
        return {m: v[m] for m in ("rand", "jaccard", "fowlkes_mallows", "phi")}

    @staticmethod
    def conjugate(frame: MultiFrame | DataFrame) -> dict[str, float]:
        v = of(counts(frame.df if isinstance(frame, MultiFrame) else frame))
        return {m.value: v[m.value] for m in External if m.value not in ("rand", "jaccard", "fowlkes_mallows", "phi")}


def _div(a: float, b: float) -> float:
    return a / b if b else float("nan")


def of(c: Counts) -> dict[str, float]:
    """All eleven values."""
    all_ = c.n * (c.n - 1) // 2
    tp, fp, fn, tn = (_div(v, all_) for v in (c.pairs["tp"], c.pairs["fp"], c.pairs["fn"], c.pairs["tn"]))
    expected, most = (c.classes * c.labels // all_ if all_ else 0), (c.classes + c.labels) // 2
    return {
        "rand": _div(tp + tn, tp + fp + fn + tn),
        "jaccard": _div(tp, tp + fp + fn),
        "fowlkes_mallows": math.sqrt(_div(tp, tp + fp) * _div(tp, tp + fn)),
        "phi": _div(tp * tn - fp * fn, (tp + fn) * (tp + fp) * (fn + tn) * (fp + tn)),
        "f1": c.f1,
        "purity": c.most / c.n,
        "entropy": c.entropy,
        "minkowski": _div(math.sqrt(c.classes + c.labels - 2 * c.cells), math.sqrt(c.labels)),
        "adjusted_rand": _div(c.cells - expected, most - expected),
        "goodman_kruskal": 1 - c.most / c.n,
        "var_info": c.class_entropy + c.label_entropy - 2 * c.joint,
    }
