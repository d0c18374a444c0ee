"""Search for the best algorithm and parameters under a time budget.

An arm is an algorithm with a search space and an optimiser that tries one configuration a step. A bandit draws the arm
of the next step from the best values so far and the time the arms took. All randomness is seeded.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..modality import LABEL, MultiFrame
from ..operators.base import Algorithm, Defaults, Model
from ..operators.clique import CLIQUE
from ..operators.dbscan import DBSCAN
from ..operators.hierarchical import CURE, Birch
from ..operators.internal import Internal
from ..operators.kmeans import BisectingKMeans, KMeans, MeanShift
from ..operators.spectral import SpectralAdjacency, SpectralSimilarity
from ..session import cut, numbered
from .report import Level, timed

#: What an optimiser is told when a configuration fails.
FAILED = float(0xBADBADBADBAD)


# ---- spaces -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parameter:
    """``kind``: const, int, float or choice."""

    name: str
    kind: str
    value: Any

    def draw(self, r: random.Random) -> Any:
        if self.kind == "int":
            return r.randint(*self.value)
        if self.kind == "float":
            return r.uniform(*self.value)
        return r.choice(self.value) if self.kind == "choice" else self.value


def parse_space(space: dict[str, Any], frame: MultiFrame) -> list[Parameter]:
    """A pair of ints or floats is a range with both ends, a set a choice, a callable a constant (or range) of the frame, all else a constant."""
    out = []
    for name, v in space.items():
        if callable(v):
            v = v(frame)
        if isinstance(v, tuple):
            v = tuple(x(frame) if callable(x) else x for x in v)
            if len(v) != 2 or isinstance(v[0], bool) or v[0] > v[1]:
                raise ValueError(f"{name}: {v} is no range")
            kind = "int" if all(isinstance(x, (int, np.integer)) for x in v) else "float"
            v = tuple(map(int if kind == "int" else float, v))
        elif isinstance(v, (set, frozenset)):
            kind, v = "choice", sorted(v)
        else:
            kind = "const"
        out.append(Parameter(name, kind, v))
    return out


@dataclass(frozen=True)
class AlgoConf:
    """An algorithm with the space of its parameters."""

    algorithm: type[Algorithm]
    space: dict[str, Any]

    @property
    def algo_name(self) -> str:
        return self.algorithm.__name__

    def build(self, params: dict[str, Any]) -> Algorithm:
        return self.algorithm(**params)


D = Defaults
SPACES: dict[str, AlgoConf] = {
    c.algo_name: c
    for c in [
        AlgoConf(KMeans, {"k": (2, D.max_clusters), "max_iterations": (1, D.max_iterations)}),
        AlgoConf(BisectingKMeans, {"k": (2, D.max_clusters), "max_iterations": (1, D.max_iterations), "min_cluster_size": (0.0, 1.0)}),
        AlgoConf(MeanShift, {"radius": (0.05, 1.0), "max_clusters": D.max_clusters, "max_iterations": (1, D.max_iterations)}),
        AlgoConf(Birch, {"k": (2, D.max_clusters), "max_branches": (3, lambda f: max(4, D.sqrt_n(f))), "threshold": (0.0, 0.5), "max_iterations": (1, D.max_iterations)}),
        AlgoConf(DBSCAN, {"epsilon": (0.01, 1.0), "min_points": (2, lambda f: max(3, D.sqrt_n(f))), "border_noise": {True, False}, "max_clusters": D.max_clusters, "points_in_box": D.points_in_box, "levels": D.levels}),
        AlgoConf(CLIQUE, {"threshold": (0.0, 1.0), "splits": (2, lambda f: max(3, D.log10_n(f) * 4)), "levels": (1, lambda f: min(4, D.global_dim(f)))}),
        AlgoConf(CURE, {"k": (2, D.max_clusters), "representatives": (2, 20), "shrink_factor": (0.1, 0.9), "remove_outliers": {True, False}}),
        AlgoConf(SpectralAdjacency, {"neighbours": (2, lambda f: max(3, D.sqrt_n(f))), "eigen": D.log_n, "k": (2, D.max_clusters), "max_iterations": (1, D.max_iterations)}),
        AlgoConf(SpectralSimilarity, {"gamma": (0.1, 5.0), "eigen": D.log_n, "k": (2, D.max_clusters), "max_iterations": (1, D.max_iterations)}),
    ]
}
DEFAULT_ARMS = ("KMeans", "MeanShift", "Birch", "BisectingKMeans")


# ---- optimisers ---------------------------------------------------------------------------------------------------


@dataclass
class HistoryRun:
    """One try: its value (less is better, infinite if it failed), seconds, algorithm and parameters."""

    value: float
    fit_time: float
    eval_time: float
    algo: str
    params: dict[str, Any]


@dataclass
class Optimal:
    algo: Algorithm
    model: Model
    frame: MultiFrame
    value: float
    index: int


@dataclass
class HyperOpt:
    """Tries configurations; subclasses say which."""

    conf: AlgoConf
    frame: MultiFrame
    measure: Internal
    seed: int = 0
    history: list[HistoryRun] = field(default_factory=list)
    optimal: Optimal | None = None

    def __post_init__(self):
        self.space = parse_space(self.conf.space, self.frame)
        self.random = random.Random(f"{self.conf.algo_name}:{self.seed}")

    def propose(self) -> dict[str, Any]:
        return {p.name: p.draw(self.random) for p in self.space}

    def step(self) -> HistoryRun:
        params = self.propose()
        began, fitted, value = time.time(), None, math.inf
        try:
            with timed(self.conf.algo_name, params=params):
                algo = self.conf.build(params)
                model, labelled = algo.fit_predict_with_model(self.frame)
            fitted = time.time()
            with timed(f"evaluation by {self.measure.name}") as found:
                value = found["result"] = self.measure.evaluate(labelled, minimise=True)
            value = value if math.isfinite(value) else math.inf
        except (ValueError, RuntimeError, ArithmeticError, PySparkException):  # a configuration that can't work is no reason to stop
            pass
        ended = time.time()
        run = HistoryRun(value, (fitted or ended) - began, ended - fitted if fitted else 0.0, self.conf.algo_name, params)
        if math.isfinite(value) and (self.optimal is None or value < self.optimal.value):
            self.optimal = Optimal(algo, model, labelled, value, len(self.history))
        self.history.append(run)
        return run


class RandomOpt(HyperOpt):
    """Independent draws."""


class DensityOpt(HyperOpt):
    """Draws candidates and takes the one most like the better quarter of past tries and least like the rest."""

    WARM, CANDIDATES = 5, 24

    def propose(self) -> dict[str, Any]:
        drawn = [super(DensityOpt, self).propose() for _ in range(self.CANDIDATES)]
        past = sorted(self.history, key=lambda h: h.value)
        if len(past) < self.WARM:
            return drawn[0]
        cut_at = max(1, len(past) // 4)

        def density(x: dict, runs: list[HistoryRun]) -> float:
            total = 0.0
            for p in self.space:
                if p.kind in ("int", "float"):
                    width = max(1e-9, (p.value[1] - p.value[0]) / (1 + len(runs) ** 0.5))
                    total += math.log(1e-9 + sum(math.exp(-0.5 * ((x[p.name] - h.params[p.name]) / width) ** 2) for h in runs) / len(runs))
                elif p.kind == "choice":
                    total += math.log((1 + sum(h.params[p.name] == x[p.name] for h in runs)) / (len(p.value) + len(runs)))
            return total

        return max(drawn, key=lambda x: density(x, past[:cut_at]) - density(x, past[cut_at:]))


def optuna_opt(conf: AlgoConf, frame: MultiFrame, measure: Internal, seed: int = 0) -> HyperOpt:
    """An optimiser that asks Optuna's TPE sampler, where that is installed."""
    import optuna

    class OptunaOpt(HyperOpt):
        def __post_init__(self):
            super().__post_init__()
            self.study = optuna.create_study(sampler=optuna.samplers.TPESampler(seed=self.seed))

        def step(self) -> HistoryRun:
            self.trial = self.study.ask()
            run = super().step()
            self.study.tell(self.trial, run.value if math.isfinite(run.value) else FAILED)
            return run

        def propose(self) -> dict[str, Any]:
            t = self.trial
            ask = {"int": lambda p: t.suggest_int(p.name, *p.value), "float": lambda p: t.suggest_float(p.name, *p.value), "choice": lambda p: t.suggest_categorical(p.name, p.value), "const": lambda p: p.value}
            return {p.name: ask[p.kind](p) for p in self.space}

    return OptunaOpt(conf, frame, measure, seed)


# ---- bandits ------------------------------------------------------------------------------------------------------


class MabSolver:
    """Draws arms by reward: the best value of an arm against random labels, and the share of time it left to others."""

    WARMUP = 3

    def __init__(self, frame: MultiFrame, optimisers: list[HyperOpt], seed: int = 0):
        self.frame, self.optimisers, self.random = frame, optimisers, np.random.default_rng(seed)
        n = len(optimisers)
        self.consumption, self.usage = np.zeros(n), np.zeros(n, int)
        with timed(f"pivot of {optimisers[0].measure.name}", end=Level.INFO) as found:
            self.pivot = found["result"] = self.random_value(seed)
        self.rewards = np.full(n, self.pivot)
        self.history: list[HistoryRun] = []

    def random_value(self, seed: int) -> float:
        """The measure of labels 0, 1 and 2 drawn at random."""
        m = self.optimisers[0].measure
        for k in range(10):
            df = self.frame.df.withColumn(LABEL, F.pmod(F.xxhash64("_id", F.lit(seed), F.lit(k)), F.lit(3)).cast("int"))
            try:
                v = m.evaluate(self.frame.like(df), minimise=False)
            except ValueError:
                continue
            if math.isfinite(v):
                return v
        return 0.0

    def normalised_rewards(self) -> np.ndarray:
        total = self.consumption.sum()
        spare = 1.0 - self.consumption / total if total else np.ones(len(self.usage))
        best = self.rewards.max() - self.pivot
        return spare if abs(best) < 1e-12 else (self.rewards - self.pivot) / best + spare

    def draw(self) -> int:
        raise NotImplementedError

    def step(self, arm: int) -> float:
        began = time.time()
        with timed(f"arm {arm}", end=Level.INFO, algorithm=self.optimisers[arm].conf.algo_name, attempt=int(self.usage[arm]) + 1, of_all=len(self.history) + 1) as found:
            run = self.optimisers[arm].step()
            found["result"] = -run.value
        took = time.time() - began
        self.history.append(run)
        self.consumption[arm] += took
        self.usage[arm] += 1
        self.rewards[arm] = max(self.rewards[arm], -run.value)
        return took

    def run(self, time_limit: float) -> Optimal | None:
        """Goes on until the budget is used; it is looked at between steps. May be called again."""
        used = 0.0
        while used < time_limit and self.usage.min() < self.WARMUP:
            used += self.step(int(self.usage.argmin()))
        while used < time_limit:
            used += self.step(self.draw())
        found = [o.optimal for o in self.optimisers if o.optimal]
        return min(found, key=lambda o: o.value) if found else None


class SoftmaxMab(MabSolver):
    def draw(self) -> int:
        r = self.normalised_rewards()
        e = np.exp(r - r.max())
        return int(self.random.choice(len(e), p=e / e.sum()))


class UcbMab(MabSolver):
    def draw(self) -> int:
        return int(np.argmax(self.normalised_rewards() + np.sqrt(2 * np.log(max(1, len(self.history))) / np.maximum(self.usage, 1))))


# ---- facade and history -------------------------------------------------------------------------------------------


class AutoCluster:
    """Search over several algorithms; without a measure one is recommended from the frame's meta-features."""

    def __init__(self, frame: MultiFrame, configs: list[AlgoConf] | None = None, mab_solver: type[MabSolver] = SoftmaxMab, hyper_opt: Callable[..., HyperOpt] = DensityOpt, measure: Internal | None = None, seed: int = 0):
        if measure is None:
            from .recommend import recommend

            measure = recommend(frame)
        if configs is None:
            configs = [SPACES[n] for n in DEFAULT_ARMS]
            random.Random(seed).shuffle(configs)
        if not configs:
            raise ValueError("no algorithms")
        self.measure = measure
        self.solver = mab_solver(frame, [hyper_opt(c, frame, measure, seed) for c in configs], seed)

    def run(self, time_limit: float) -> Optimal | None:
        return self.solver.run(time_limit)

    def history(self) -> list[HistoryRun]:
        return self.solver.history

    def history_json(self) -> str:
        return json.dumps([asdict(h) for h in self.history()], indent=2, default=float)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return history_frame(spark, self.history())


def history_frame(spark: SparkSession, runs: list[HistoryRun]) -> DataFrame:
    return spark.createDataFrame([(i, h.algo, float(h.value), h.fit_time, h.eval_time, json.dumps(h.params, default=float)) for i, h in enumerate(runs)], "step long, algo string, value double, fit_time double, eval_time double, params string")


#: Steps of a block that one task looks at.
BLOCK = 1 << 16


def cumulative_best(history: DataFrame, step: str = "step", algo: str = "algo", value: str = "value", window: int = 25) -> DataFrame:
    """``history`` with the best value so far of its algorithm, and the mean of the last ``window`` values of all.

    Steps are numbered in order and cut into blocks. A block gets the last rows of the one before, and each algorithm's best until then.
    """
    size, names = max(BLOCK, window), history.columns
    rows = cut(numbered(history, step, "__number").withColumn("__block", F.floor(F.col("__number") / size)), "steps")
    own = F.when(F.col("__own"), F.col(value))
    earlier = rows.where(F.col("__number") % size > size - window).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
    last = Window.partitionBy("__block").orderBy("__number").rowsBetween(-(window - 1), Window.currentRow)
    best = Window.partitionBy("__block", algo).orderBy("__number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__own", F.lit(True)).unionByName(earlier).withColumn("rolling", F.avg(value).over(last)).withColumn("__best", F.min(own).over(best)).where("__own")
    before = Window.partitionBy("__algo").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(F.col(algo).alias("__algo"), F.col("__block").alias("__at")).agg(F.min(value).alias("__least")).withColumn("__before", F.min("__least").over(before))
    out = out.join(blocks, F.col(algo).eqNullSafe(F.col("__algo")) & (F.col("__block") == F.col("__at")))
    return out.select(*names, F.least("__best", "__before").alias("best"), "rolling")
