"""Preparation, search, sources, streaming and the registry."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mosaica.functions.encoders import BytesEncoder, HashingEncoder, encode_column
from mosaica.modality import CLASS, ID, LABEL, Modality, MultiFrame
from mosaica.operators.internal import Internal
from mosaica.operators.kmeans import KMeans
from mosaica.operators.metafeatures import NAMES
from mosaica.plans import prep
from mosaica.plans.recommend import train
from mosaica.plans.search import SPACES, AutoCluster, DensityOpt, RandomOpt, SoftmaxMab, UcbMab, cumulative_best, parse_space
from mosaica.sources import files
from mosaica.sources.blobs import blobs
from mosaica.streaming.score import score_to_parquet


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(pd.DataFrame({"a": [1.0, 2, 3, 4, 5, None], "b": [7] * 6, "s": ["x", "y", "", "x", "z", "x"], "t": ["red apple", "green pear", "", "red apple pie", "blue sky", "x"], "c": ["u", "v", "u", "v", "w", "u"]}))


def test_builder(spark, raw):
    f = prep.Builder(raw, class_col="c", partitions=2).tabular("tab", ["a", "b", "s"]).text("t", HashingEncoder(16), distance="cosine").create()
    assert f.amount == 5 and [m.name for m in f.modalities] == ["t", "tab"]
    tab = {m.name: m for m in f.modalities}["tab"]
    assert (tab.dim, tab.w_dim) == (2 + 4, 3) and sum(m.weight for m in f.modalities) == pytest.approx(1)
    rows = f.df.orderBy("tab").collect()
    assert {r[CLASS] for r in rows} == {0, 1, 2} and all(-1 <= v <= 1 for r in rows for v in [*r.t, *r.tab])
    assert all(r.tab[1] == 0 for r in rows)  # constant
    assert all(sum(r.tab[2:]) == 1 for r in rows)
    again = f.apply(spark.createDataFrame([(1.0, 7, "never seen", "red apple")], "a double, b int, s string, t string")).df.first()
    assert again.tab == [-1, 0, 0, 0, 0, 0]


def test_builder_refuses(raw):
    b = prep.Builder(raw)
    for wrong in (lambda: b.vector("a"), lambda: b.tabular("tab", ["nope"]), lambda: b.tabular("9x", ["a"]), lambda: b.tabular("tab", ["a"], "far"), lambda: b.tabular("tab", ["a"], weight=-1.0), lambda: prep.Builder(raw, class_col="a"), b.create):
        with pytest.raises(ValueError):
            wrong()
    b.tabular("one", ["a"], weight=1.0)
    with pytest.raises(ValueError):
        b.tabular("two", ["b"])
    with pytest.raises(ValueError):
        b.tabular("two", ["a"], weight=1.0)
    with pytest.raises(ValueError):
        prep.Builder([1, 2])


def test_stages(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "_id long, v array<double>")
    assert [r.v for r in prep.Ranges.fit(df, "v", 2).apply(df).orderBy("_id").collect()] == [[-1, 0], [1, 0]]
    with pytest.raises(ValueError):
        prep.dim_of(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "_id long, v array<double>"), "v")
    from pyspark.ml.linalg import Vectors

    v = spark.createDataFrame([(1, Vectors.sparse(3, {1: 2.0})), (2, Vectors.dense(1, 2, 3))], ["k", "v"])
    assert [r.v for r in prep.as_array(v, "v").orderBy("k").collect()] == [[0, 2, 0], [1, 2, 3]]
    assert prep.partitioned(df, 3).rdd.getNumPartitions() == 3 and prep.partitioned(df, None) is df
    with pytest.raises(ValueError):
        prep.partitioned(df, "many")


def test_images(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k * 60] * (k + 1)))
    df = spark.createDataFrame([(f"{k}.bin",) for k in range(4)], "img string")
    f = prep.Builder(df).image("img", BytesEncoder(8), str(tmp_path), reduce_dim=False).create()
    assert f.amount == 4 and f.modalities[0].dim == 8
    assert files.list_files(spark, str(tmp_path), "*.bin").count() == 4


def test_encoder_batches(spark):
    e = HashingEncoder(8)
    texts = [f"word{k} word{k + 1}" for k in range(50)] + [None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", encode_column(e, "t", 7).alias("v")).orderBy("i").collect()
    assert np.allclose([r.v for r in got], e.encode(texts), atol=1e-6)


def test_spaces(spark):
    f = MultiFrame(spark.range(1).select(F.col("id").alias(ID)), (Modality("v", 2),), 1000)
    kinds = {p.name: (p.kind, p.value) for p in parse_space({"a": (1, 5), "b": (0.0, 1), "c": {True, False}, "d": 7, "e": lambda x: x.amount, "f": (2, lambda x: x.global_dim)}, f)}
    assert kinds == {"a": ("int", (1, 5)), "b": ("float", (0.0, 1.0)), "c": ("choice", [False, True]), "d": ("const", 7), "e": ("const", 1000), "f": ("int", (2, 2))}
    with pytest.raises(ValueError):
        parse_space({"a": (5, 1)}, f)
    assert len(SPACES) == 9 and all(parse_space(c.space, f) for c in SPACES.values())


@pytest.mark.parametrize("mab,opt", [(SoftmaxMab, DensityOpt), (UcbMab, RandomOpt)])
def test_search(spark, mab, opt):
    f = blobs(spark, 200, 3, (3, 2), seed=1)
    s = AutoCluster(f.like(f.df.drop(CLASS)), [SPACES["KMeans"], SPACES["MeanShift"]], mab, opt, Internal.SILHOUETTE_APPROX, seed=1)
    s.solver.WARMUP = 1
    best = s.run(12)
    h = s.history()
    assert len(h) >= 2 and {x.algo for x in h[:2]} == {"KMeans", "MeanShift"}
    done = [x.value for x in h if x.value < float("inf")]
    assert (best.value == min(done)) if done else best is None
    assert len(json.loads(s.history_json())) == len(h) == s.history_frame(spark).count()


def test_rewards():
    m = SoftmaxMab.__new__(SoftmaxMab)
    m.consumption, m.rewards, m.pivot, m.usage, m.history = np.array([1.0, 3.0]), np.array([2.0, 6.0]), 2.0, np.array([2, 2]), [None] * 4
    assert m.normalised_rewards().tolist() == [0.75, 1.25]
    m.rewards = np.array([2.0, 2.0])
    assert m.normalised_rewards().tolist() == [0.75, 0.25]


def test_recommender(spark):
    r = np.random.default_rng(0)
    rows = [(*(r.random(19) * 0.1 + (k % 2)).tolist(), "SF" if k % 2 else "GD41_APPROX") for k in range(40)]
    model = train(spark.createDataFrame(rows, [*NAMES, "measure"]), folds=2)
    got = model.transform(spark.createDataFrame([([0.05] * 19, "SF"), ([1.05] * 19, "SF")], "x array<double>, measure string").select(*(F.col("x")[i].alias(n) for i, n in enumerate(NAMES)), "measure")).select("recommended").collect()
    assert [g[0] for g in got] == ["GD41_APPROX", "SF"]


def test_history(spark):
    h = spark.createDataFrame([(1, "a", 3.0), (2, "b", 9.0), (3, "a", 5.0), (4, "a", 1.0)], "step long, algo string, value double")
    got = cumulative_best(h, window=2).orderBy("step").collect()
    assert [r.best for r in got] == [3, 9, 3, 1] and [r.rolling for r in got] == [3, 6, 7, 3]


def test_sources(spark, tmp_path):
    f = blobs(spark, 100, 4, (3, 2))
    files.save(f, str(tmp_path / "f"))
    again = files.load(spark, str(tmp_path / "f"))
    assert again.modalities == f.modalities and again.amount == 100
    d = files.register(files.Fetcher("small", lambda s: f.df.drop(CLASS), lambda df: MultiFrame.of(df, list(f.modalities))))
    assert files.by_name("small") is d
    for _ in range(2):
        assert d.preprocessed(spark, str(tmp_path / "cache")).amount == 100
    with pytest.raises(ValueError):
        files.by_name("none")


def test_stream(spark, tmp_path):
    f = blobs(spark, 120, 3, (2, 2), seed=2)
    model = KMeans(3, 5, seed=1).fit(f)
    f.df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f.df.schema).parquet(f"{tmp_path}/in")
    score_to_parquet(stream, model, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    want = {r[ID]: r[LABEL] for r in model.predict(f).df.collect()}
    assert {r[ID]: r[LABEL] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 115


def test_cumulative_best_over_blocks(spark, monkeypatch):
    from mosaica.plans import search

    monkeypatch.setattr(search, "BLOCK", 8)
    r = np.random.default_rng(0)
    v, a = r.random(60).round(3).tolist(), r.choice(["x", "y", None], 60, p=[0.6, 0.3, 0.1]).tolist()
    v[5] = v[20] = None
    h = spark.createDataFrame([(i * 3, p, q) for i, (p, q) in enumerate(zip(a, v))], "step long, algo string, value double").repartition(5)
    got = {q.step // 3: q for q in cumulative_best(h, window=4).collect()}
    assert len(got) == 60
    for i in range(60):
        seen, last = [v[k] for k in range(i + 1) if a[k] == a[i] and v[k] is not None], [x for x in v[max(0, i - 3) : i + 1] if x is not None]
        assert got[i].best == (min(seen) if seen else None) and got[i].rolling == pytest.approx(sum(last) / len(last))


def test_encoders_take_values_by_mini_batch(spark):
    """Arrow values are made Python's a mini-batch at a time: the plan has no pandas UDF, which makes all of a batch at once."""
    df = spark.createDataFrame([(i, None if i == 3 else "a b") for i in range(10)], "i long, t string").coalesce(1)
    plan = df.select("i", encode_column(HashingEncoder(8), "t", 4).alias("v"))
    want = HashingEncoder(8).encode(["a b", None]).astype(np.float32)
    assert all(q.v == want[int(q.i == 3)].tolist() for q in plan.collect())
    from pyspark.util import PythonEvalType

    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in text and f", {PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF}" not in text
