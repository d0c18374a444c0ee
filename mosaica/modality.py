"""Modalities and prepared frames.

A prepared frame has a long ``_id``, one ``array<double>`` column per modality, and, where known, an int ``_class`` (the
external label) and an int ``_label`` (the cluster, -1 for noise). The distance of two rows follows from the modalities
alone, so it is not an object of its own.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID, LABEL, CLASS, NOISE = "_id", "_label", "_class", -1
METRICS = ("euclidean", "manhattan", "chebyshev", "canberra", "cosine")


@dataclass(frozen=True)
class Modality:
    """One vector column: its width, the number of raw features behind it, its share in the distance and its scale."""

    name: str
    dim: int
    metric: str = "euclidean"
    weight: float = 1.0
    norm: float = 1.0
    w_dim: int | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; known: {', '.join(METRICS)}")

    @property
    def features(self) -> int:
        return self.dim if self.w_dim is None else self.w_dim


def in_order(modalities: list[Modality]) -> list[Modality]:
    """By name, the order of the global dimensions; weights must add up to 1."""
    out = sorted(modalities, key=lambda m: m.name)
    if not out:
        raise ValueError("no modalities")
    if abs(sum(m.weight for m in out) - 1) > 1e-9:
        raise ValueError("the weights of the modalities don't add up to 1")
    return out


@dataclass(frozen=True)
class MultiFrame:
    """A prepared frame with its modalities and number of rows."""

    df: DataFrame
    modalities: tuple[Modality, ...]
    amount: int

    def like(self, df: DataFrame) -> MultiFrame:
        """The same modalities on another frame of as many rows."""
        return replace(self, df=df)

    @property
    def global_dim(self) -> int:
        return sum(m.dim for m in self.modalities)

    @property
    def estimate_mem(self) -> int:
        """Bytes, at ten for each number."""
        return self.amount * self.global_dim * 10

    @property
    def modal_dict(self) -> dict[str, dict]:
        return {m.name: asdict(m) for m in self.modalities}

    def save_modalities(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.modal_dict, indent=2))

    @staticmethod
    def of(df: DataFrame, modalities: list[Modality]) -> MultiFrame:
        """Checks that every modality's vectors have its width, and counts the rows."""
        ms = in_order(modalities)
        odd = [F.sum((F.coalesce(F.size(m.name), F.lit(-1)) != m.dim).cast("int")).alias(m.name) for m in ms]
        got = df.agg(F.count("*").alias("__n"), *odd).first()
        for m in ms:
            if got[m.name]:
                raise ValueError(f"{got[m.name]} rows of {m.name!r} aren't {m.dim} wide")
        return MultiFrame(df, tuple(ms), got["__n"])

    @staticmethod
    def restore(df: DataFrame, modalities: dict | str) -> MultiFrame:
        """A saved frame and its ``modal_dict``, or the path of its JSON, make a frame again."""
        if isinstance(modalities, str):
            modalities = json.loads(Path(modalities).read_text())
        return MultiFrame.of(df, [Modality(**m) for m in modalities.values()])
