"""Known values, columns against kernels, and row algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.functions import distances as dist
from mosaica.functions.norms import approximate_diameter, exact_diameter
from mosaica.modality import METRICS, Modality, MultiFrame


def sparse(n, **at):
    v = [0.0] * n
    for k, x in at.items():
        v[int(k[1:])] = float(x)
    return v


PAIRS = [
    ([1, 2, 3, 4, 5], [4, 2, 1, 5, 3]),
    (sparse(7, _1=4, _4=1, _6=9), sparse(7, _0=7, _2=3, _4=2)),
    ([7, 5, 0, 5, 7], sparse(5, _1=6, _3=6)),
    ([5, 3, 4, 1, 3], sparse(5, _2=5, _4=1)),
]
KNOWN = {
    "manhattan": [8, 24, 16, 12],
    "euclidean": [math.sqrt(18), math.sqrt(156), 10, math.sqrt(40)],
    "chebyshev": [3, 9, 7, 5],
    "cosine": [0.1636363636363637, 0.9743420997104607, 0.41876180628090365, 0.4176748639268918],
    "canberra": [1.4611111111111112, 4.333333333333334, 2.1818181818181817, 3.6111111111111118],
}


@pytest.mark.parametrize("metric", METRICS)
def test_known_values(spark, metric):
    rows = [(k, [float(v) for v in x], [float(v) for v in y]) for k, (x, y) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    for k, (x, y) in enumerate(PAIRS):
        want = pytest.approx(KNOWN[metric][k], abs=1e-12)
        one = df.where(F.col("k") == k)
        for dim in (len(x), None):
            assert one.select(dist.metric(metric, "x", "y", dim), dist.metric(metric, "y", "x", dim)).first() == (want, want)
        m = [Modality("x", len(x), metric)]
        assert dist.pairwise(m, np.array([x], float), np.array([y], float))[0, 0] == want


@pytest.mark.parametrize("metric", METRICS)
def test_zero_and_equal_vectors(spark, metric):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [1.0, 2.0])], "z array<double>, y array<double>, x array<double>")
    assert df.select(dist.metric(metric, "z", "y", 2), dist.metric(metric, "x", "x")).first() == (pytest.approx(0, abs=1e-12),) * 2
    if metric == "cosine":
        assert df.select(dist.metric(metric, "z", "x")).first()[0] == 0.0


MS = [Modality("a", 3, "manhattan", 0.5, 2.0), Modality("b", 2, "euclidean", 0.3, 4.0), Modality("c", 2, "cosine", 0.2, 0.5), Modality("n", 1, "chebyshev", 0.0, 0.0)]


def test_multimodal_columns_and_kernels(spark):
    r = np.random.default_rng(0)
    x, y = r.standard_normal((20, 8)), r.standard_normal((20, 8))
    cut = lambda v: [v[:3].tolist(), v[3:5].tolist(), v[5:7].tolist(), v[7:].tolist()]
    df = spark.createDataFrame([(i, *cut(p), *cut(q)) for i, (p, q) in enumerate(zip(x, y))], "i int, a array<double>, b array<double>, c array<double>, n array<double>, a_2 array<double>, b_2 array<double>, c_2 array<double>, n_2 array<double>")
    got = [v[0] for v in df.orderBy("i").select(dist.multimodal(MS)).collect()]
    assert np.allclose(got, np.diag(dist.pairwise(MS, x, y)), atol=1e-12)
    assert np.allclose(dist.pairwise(MS, x, y), dist.pairwise(MS, y, x).T)
    at, d = dist.nearest(MS, x, y)
    assert (at == dist.pairwise(MS, x, y).argmin(1)).all() and np.allclose(d, dist.pairwise(MS, x, y).min(1))


def test_row_algebra(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0], [4.0, 0.0])], "i int, p array<double>, q array<double>, r array<double>")
    two = [Modality("p", 2, weight=0.5), Modality("q", 1, weight=0.5)]
    r = df.select(dist.plus("p", "r", 2, -1).alias("plus"), dist.scale("p", 3).alias("scale"), dist.elementwise("p", "r", F.least).alias("least"), dist.l2(two).alias("l2"), dist.flatten(two).alias("flat"), dist.by_global(two, 2).alias("g"), dist.zero(two[0]).alias("zero")).first()
    assert (r.plus, r.scale, r.least, r.flat, r.g, r.zero) == ([-2, 4], [3, 6], [1, 0], [1, 2, 3], 3, [0, 0])
    assert r.l2 == pytest.approx(0.5 * math.sqrt(5) + 1.5)
    with pytest.raises(ValueError):
        dist.by_global(two, 3)


def test_norms(spark):
    m = Modality("v", 2)
    df = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "_id long, v array<double>")
    lower, exact = approximate_diameter(df, m), exact_diameter(df, m)
    assert 0.9 * exact <= lower <= exact
    assert approximate_diameter(df.limit(0), m) == 0 and approximate_diameter(df.where("_id = 1"), m) == 0


def test_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "_id long, v array<double>")
    f = MultiFrame.of(df, [Modality("v", 2)])
    assert (f.amount, f.global_dim, f.estimate_mem) == (2, 2, 40)
    f.save_modalities(f"{tmp_path}/m.json")
    assert MultiFrame.restore(df, f"{tmp_path}/m.json").modalities == f.modalities
    for wrong in ([Modality("v", 3)], [Modality("v", 2, weight=0.5)], []):
        with pytest.raises(ValueError):
            MultiFrame.of(df, wrong)
    with pytest.raises(ValueError):
        Modality("v", 2, "hamming")


def test_squares_of_near_rows_keep_their_digits():
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 40)) + 100.0
    y = np.concatenate([x[:50], x[50:100] + 1e-7, r.standard_normal((200, 40)) + 100.0])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    got = dist.pairwise([Modality("v", 40)], x, y)
    assert (got[np.arange(50), np.arange(50)] == 0).all() and np.allclose(got, want, rtol=1e-9, atol=0)


@pytest.mark.parametrize("metric", METRICS)
def test_kernels_over_many_rows(metric):
    r = np.random.default_rng(2)
    x, y, m = r.standard_normal((90, 12)), r.standard_normal((70, 12)), [Modality("v", 12, metric, norm=3.0)]
    x[3], y[4], y[5] = 0, 0, x[7]
    i, j = (v.ravel() for v in np.indices((90, 70)))
    d = dist.pairwise(m, x, y)
    assert np.allclose(d.ravel(), dist.paired(m, x[i], y[j]), atol=1e-12)
    edge = dist.paired(m, x[:1], y[:1])[0]
    assert (dist.within(m, x, y, edge).ravel() == (dist.paired(m, x[i], y[j]) <= edge)).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
@pytest.mark.parametrize("dim,shape", [(2, "square"), (2, "circle"), (3, "square"), (9, "square")])
def test_exact_diameter_leaves_no_end_out(spark, monkeypatch, metric, dim, shape):
    from mosaica.functions import norms

    monkeypatch.setattr(norms, "FEW_ROWS", 20)
    r = np.random.default_rng(dim)
    x = r.random((1500, dim)) ** 2 * 3
    if shape == "circle":
        t = r.random(1500) * 2 * np.pi
        x = np.stack([np.cos(t), np.sin(t)], axis=1)
    x[:700] = x[700:1400]
    m = Modality("v", dim, metric, 0.3, 7.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, v array<double>")
    want = dist.pairwise([Modality("v", dim, metric)], x, x).max()
    assert exact_diameter(df, m) == pytest.approx(want, rel=1e-14)
    if dim <= norms.FEW_DIMENSIONS and shape == "square":
        assert 2 <= norms._outer(df, Modality("v", dim, metric), approximate_diameter(df, Modality("v", dim, metric))).count() < 150
