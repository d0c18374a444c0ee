"""Algorithms on well-separated blobs and at their edges; measures by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.modality import CLASS, ID, LABEL, Modality, MultiFrame
from mosaica.functions.norms import exact_diameter
from mosaica.operators.boxes import boxes_of
from mosaica.operators.clique import CLIQUE, groups
from mosaica.operators.components import components
from mosaica.operators.dbscan import DBSCAN, neighbour_counts
from mosaica.operators.external import External, counts, of
from mosaica.functions.distances import pairwise
from mosaica.operators.hierarchical import CURE, Birch, Bunch, CFTree, agglomerate
from mosaica.operators.internal import Internal
from mosaica.operators.kmeans import BisectingKMeans, KMeans, MeanShift
from mosaica.operators.metafeatures import NAMES, meta_features
from mosaica.operators.spectral import SpectralAdjacency, SpectralSimilarity, eigenvectors, similarity_times, sparse_times

CENTRES = np.array([[-0.8, -0.8, 0.1], [0.8, -0.7, 0.0], [0.0, 0.9, -0.5]])


def make(spark, n=90, partitions=3, spread=0.05, seed=0):
    r = np.random.default_rng(seed)
    k = np.arange(n) % 3
    x = CENTRES[k] + spread * r.standard_normal((n, 3))
    rows = [(i, int(c), v[:2].tolist(), v[2:].tolist()) for i, (c, v) in enumerate(zip(k, x))]
    df = spark.createDataFrame(rows, f"{ID} long, {CLASS} int, p array<double>, q array<double>").repartition(partitions, ID)
    return MultiFrame(df, (Modality("p", 2, "euclidean", 0.8, 2.4), Modality("q", 1, "manhattan", 0.2, 0.8)), n)


@pytest.fixture(scope="module")
def frame(spark):
    f = make(spark)
    return f.like(f.df.persist())


@pytest.mark.parametrize(
    "algo",
    [KMeans(3, 20, seed=1), BisectingKMeans(3, 20, min_cluster_size=0.0, seed=1), MeanShift(0.2, 10, 20, 12, seed=1), Birch(3, 5, 0.05, 10), DBSCAN(0.15, 4), DBSCAN(0.15, 4, border_noise=False, max_clusters=5), CURE(3, 4, 0.3), CURE(3, 2, 0.5, remove_outliers=True), SpectralAdjacency(20, 6, 3, 50, seed=2), SpectralSimilarity(20.0, 3, 3, 50, seed=2)],
    ids=lambda a: a.algo_name,
)
def test_finds_blobs(frame, algo):
    model, out = algo.fit_predict_with_model(frame)
    assert out.df.count() == frame.amount
    if algo.algo_name != "SpectralAdjacency":  # the greatest eigenvectors of a Laplacian say little about clusters
        assert External.ADJUSTED_RAND.evaluate(out.like(out.df.where(F.col(LABEL) >= 0))) > 0.9


@pytest.mark.parametrize(
    "algo",
    [KMeans(3, 10, seed=3), BisectingKMeans(3, 10, seed=3), MeanShift(0.2, 10, 10, 9, seed=3), Birch(3, 5, 0.02, 10, group_rows=20), DBSCAN(0.15, 4), CURE(3, 4, 0.3, group_rows=20), CURE(3, 2, 0.4, True, 10), CLIQUE(0.1, 2, 2), SpectralAdjacency(20, 6, 3, 50, seed=2), SpectralSimilarity(20.0, 3, 3, 50, seed=2)],
    ids=lambda a: a.algo_name,
)
def test_partitioning_does_not_matter(spark, algo):
    got = []
    for p in (1, 5):
        f = make(spark, 240, partitions=p, spread=0.2)
        got.append({r[ID]: r[LABEL] for r in algo.fit_predict(f.like(f.df.drop(LABEL))).df.collect()})
    assert got[0] == got[1] and len(got[0]) == 240


def brute_agglomerate(x, k, most, shrink, ms):
    """CURE's mergers by looking at all pairs of clusters each time, with all their points."""
    c = [([v], [v], [v]) for v in x]  # rows, points, representatives
    far = lambda p, q: float(pairwise(ms, np.array([p]), np.array([q]))[0, 0])
    while len(c) > k:
        d, i, j = min((min(far(p, q) for p in c[i][2] for q in c[j][2]), i, j) for i in range(len(c)) for j in range(i + 1, len(c)))
        rows = c[i][0] + c[j][0]
        mean = np.mean(rows, axis=0)
        reps = rows
        if len(rows) > most:
            picked = [max(range(len(rows)), key=lambda r: (far(rows[r], mean), -r))]
            while len(picked) < most:
                gap = [min(far(v, rows[p]) for p in picked) for v in rows]
                if max(gap) == 0:
                    break
                picked.append(int(np.argmax(gap)))
            reps = [rows[p] for p in picked]
        c[i] = (rows, rows, [r + shrink * (mean - r) for r in reps])
        del c[j]
    return c


@pytest.mark.parametrize("most,shrink,k", [(3, 0.3, 4), (1, 0.5, 3), (50, 0.2, 2), (2, 0.8, 6)])
def test_cure_matches_brute_force(most, shrink, k):
    ms = (Modality("p", 2, "euclidean", 0.8, 2.4), Modality("q", 1, "manhattan", 0.2, 0.8))
    x = np.random.default_rng(most).random((45, 3))
    got = agglomerate([Bunch(v[None], v[None], v, 1) for v in x], k, most, shrink, ms)
    want = brute_agglomerate(list(x), k, most, shrink, ms)
    key = lambda rows: sorted(map(tuple, np.round(rows, 9)))
    assert sorted(key(b.points) for b in got) == sorted(key(c[0]) for c in want)
    assert sorted(key(b.reps) for b in got) == sorted(key(c[2]) for c in want)
    assert sum(b.n for b in got) == 45


def test_birch_keeps_all_rows_under_a_memory_bound(spark):
    f = make(spark, 240, spread=0.2)
    n, s = Birch(3, 5, 0.0, 10, group_rows=50).entries(f)
    assert len(n) == 240  # with threshold 0 all rows are entries
    few, t = Birch(3, 5, 0.0, 10, group_rows=50, memory=1024).entries(f)
    assert few.sum() == 240 and np.allclose(t.sum(0), s.sum(0)) and len(few) <= 1024 // 32


def test_clique(frame):
    out = CLIQUE(0.1, 2, 2).fit_predict(frame.like(frame.df.drop(LABEL)))
    assert out.df.where(F.col(LABEL) >= 0).count() > 60
    with pytest.raises(RuntimeError):
        CLIQUE(1.0, 4, 2).fit(frame)
    assert groups([((0, 1),), ((0, 2),), ((0, 4),), ((1, 1),)]) == [[((0, 1),), ((0, 2),)], [((0, 4),)], [((1, 1),)]]


@pytest.mark.parametrize("make_it", [lambda: KMeans(1), lambda: KMeans(3, 0), lambda: BisectingKMeans(3, min_cluster_size=-1), lambda: MeanShift(0, 4), lambda: Birch(3, 1), lambda: DBSCAN(0, 3), lambda: DBSCAN(1, 0), lambda: CLIQUE(2, 3), lambda: CURE(3, shrink_factor=1.0), lambda: SpectralAdjacency(0, 2, 3), lambda: SpectralSimilarity(0, 2, 3)])
def test_parameters_are_checked(make_it):
    with pytest.raises(ValueError):
        make_it()


def test_refusals(frame):
    with pytest.raises(RuntimeError):
        KMeans(1000).fit(frame)
    with pytest.raises(RuntimeError):
        MeanShift(5.0, 3, 3).fit(frame)  # one cluster
    with pytest.raises(ValueError):
        KMeans(3).fit(frame).predict(frame.df.withColumn(LABEL, F.lit(0)))


def test_mean_shift_noise(frame):
    m = MeanShift(0.1, 20, 20, 30, seed=1).fit(frame).set_noise(True)
    far = np.array([[9.0, 9.0, 9.0]])
    assert m.labels_of(far)[0] == -1 and m.set_noise(False).labels_of(far)[0] >= 0


def test_dbscan_edges(spark):
    """Rows exactly epsilon apart are neighbours; predict follows the majority."""
    xs = [0.0, 1.0, 2.0, 2.5, 10.0, 11.0, 12.0, 20.0]
    f = MultiFrame(spark.createDataFrame([(i, [x]) for i, x in enumerate(xs)], f"{ID} long, p array<double>"), (Modality("p", 1),), len(xs))
    n = {r[ID]: r.neighbours for r in neighbour_counts(f, 1.0).collect()}
    assert n == {0: 2, 1: 3, 2: 3, 3: 2, 4: 2, 5: 3, 6: 2, 7: 1}
    strict = DBSCAN(1.0, 3).fit(f)
    assert {r[ID]: r[LABEL] for r in strict.dataframe.df.collect()} == {0: -1, 1: 0, 2: 0, 3: -1, 4: -1, 5: 1, 6: -1, 7: -1}
    loose = DBSCAN(1.0, 3, border_noise=False).fit(f)
    assert {r[ID]: r[LABEL] for r in loose.dataframe.df.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: -1}
    new = f.like(spark.createDataFrame([(0, [1.5]), (1, [10.5]), (2, [50.0])], f"{ID} long, p array<double>"))
    assert {r[ID]: r[LABEL] for r in loose.predict(new).df.collect()} == {0: 0, 1: 1, 2: -1}


@pytest.mark.parametrize("metrics", [("euclidean", "manhattan"), ("chebyshev", "cosine"), ("canberra", "euclidean")])
def test_boxes_rule_out_nothing_near(spark, metrics):
    r = np.random.default_rng(5)
    x = np.concatenate([r.random((300, 3)) ** 3, np.full((60, 3), 0.5)])
    ms = (Modality("p", 2, metrics[0], 0.7, 1.3), Modality("q", 1, metrics[1], 0.3, 0.9))
    df = spark.createDataFrame([(i, v[:2].tolist(), v[2:].tolist()) for i, v in enumerate(x)], f"{ID} long, p array<double>, q array<double>")
    f = MultiFrame(df, ms, len(x))
    d = pairwise(ms, x, x)
    for eps, splits in ((0.03, 2), (0.1, 3)):
        boxes = boxes_of(f, eps, points_in_box=20, levels=6, axis_splits=splits)
        at, near = boxes.of(x), {tuple(p) for p in boxes.near().tolist()}
        assert all((at[i], at[j]) in near for i, j in zip(*np.nonzero(d <= eps)))
        assert ((x > boxes.lo[at]) | (x == boxes.lo[at])).all() and (x <= boxes.hi[at]).all()
        assert metrics[0] == "canberra" or (len(boxes) > 4 and len(near) < len(boxes) ** 2)
        want = {i: int(n) for i, n in enumerate((d <= eps).sum(1))}
        assert {q[ID]: q.neighbours for q in neighbour_counts(f, eps, boxes).collect()} == want
    far = boxes.of(np.array([[99.0, -99.0, 3.0]]))  # rows beyond all others are in an outer box
    assert 0 <= far[0] < len(boxes)


def test_dbscan_does_not_depend_on_boxes(spark):
    f = make(spark, 200, spread=0.12)
    got = [{r[ID]: r[LABEL] for r in DBSCAN(0.08, 4, b, points_in_box=p, levels=n, axis_splits=s).labels(f).collect()} for b in (True, False) for p, n, s in ((None, 0, 2), (5, 9, 2), (30, 3, 4))]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and len(set(got[0].values())) > 2


def test_cf_tree():
    m = (Modality("p", 2),)
    t = CFTree(m, 4, 0.1, most=30)
    x = np.random.default_rng(0).random((500, 2))
    for v in x:
        t.insert(1.0, v)
    n, s = t.entries()
    assert n.sum() == 500 and np.allclose(s.sum(0), x.sum(0)) and len(n) <= 31 and t.threshold > 0.1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def residuals(a, w, v):
    return np.linalg.norm(a @ v - v * w, axis=0).max()


@pytest.mark.parametrize("n,k", [(1, 3), (5, 5), (40, 2), (40, 40), (300, 6)])
def test_eigenvectors(n, k):
    r = np.random.default_rng(n)
    a = r.standard_normal((n, n))
    a = a + a.T + np.diag(np.arange(n) * 0.3)
    w, v = eigenvectors(lambda x: a @ x, n, k)
    want = np.linalg.eigvalsh(a)
    want = want[np.argsort(-np.abs(want))][:k]
    assert np.allclose(w, want, atol=1e-7) and residuals(a, w, v) < 1e-7 and np.allclose(v.T @ v, np.eye(min(n, k)), atol=1e-9)


@pytest.mark.parametrize("blocks,size", [(5, 10), (3, 200)])
def test_repeated_eigenvalues(blocks, size):
    a = np.kron(np.eye(blocks), np.ones((size, size)))
    w, v = eigenvectors(lambda x: a @ x, len(a), blocks)
    assert np.allclose(w, size) and residuals(a, w, v) < 1e-8
    spans = np.kron(np.eye(blocks), np.ones((size, 1))) / np.sqrt(size)
    assert np.allclose(np.linalg.svd(spans.T @ v)[1], 1)  # the vectors span the blocks
    assert np.allclose(eigenvectors(lambda x: 0 * x, 30, 4)[0], 0)


def test_products_of_graphs(spark, monkeypatch):
    from mosaica.operators import spectral

    monkeypatch.setattr(spectral, "GRAPH_ROWS", 7)
    r = np.random.default_rng(3)
    ids = np.sort(r.choice(1000, 40, replace=False)).astype(np.int64)
    i, j, v = r.integers(0, 40, 200), r.integers(0, 40, 200), r.standard_normal(200)
    a = np.zeros((40, 40))
    np.add.at(a, (i, j), v)
    e = spark.createDataFrame([(int(ids[p]), int(ids[q]), float(x)) for p, q, x in zip(i, j, v)], f"{ID} long, neighbour long, v double")
    x = r.standard_normal((40, 3))
    assert np.allclose(sparse_times(e, ids)(x), a @ x)
    f = make(spark, 40)
    rows = f.df.orderBy(ID).collect()
    p = np.array([q.p for q in rows])
    got = similarity_times(f.df, f.modalities[0], 3.0, np.arange(40))(x)
    assert np.allclose(got, np.exp(-3.0 * pairwise([f.modalities[0]], p, p) ** 2) @ x)


def test_measure_invariants(frame):
    labelled = frame.like(frame.df.withColumn(LABEL, F.col(CLASS)))
    renamed = frame.like(frame.df.withColumn(LABEL, (F.lit(7) - 3 * F.col(CLASS)).cast("int")))  # gaps in the labels
    random = frame.like(frame.df.withColumn(LABEL, F.pmod(F.xxhash64(ID), F.lit(3)).cast("int")))
    for m in Internal:
        v = m.evaluate(labelled)
        assert v == pytest.approx(m.evaluate(renamed), rel=1e-9), m
        if not m.name.startswith("GD5"):  # these reward spread within the clusters
            assert m.evaluate(labelled, minimise=True) < m.evaluate(random, minimise=True), m
        assert m.evaluate(labelled, minimise=False) == -m.evaluate(labelled, minimise=True)
    assert 0.8 < Internal.SILHOUETTE.evaluate(labelled) <= 1
    noisy = frame.like(frame.df.withColumn(LABEL, F.col(CLASS) - 1))
    assert Internal.CALINSKI_HARABASZ.evaluate(noisy) != Internal.CALINSKI_HARABASZ.evaluate(labelled)
    with pytest.raises(ValueError):
        Internal.DUNN.evaluate(frame.like(frame.df.withColumn(LABEL, F.lit(0))))


def test_external_edges(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], f"{CLASS} int, {LABEL} int")
    v = of(counts(same))
    assert v["rand"] == v["jaccard"] == v["fowlkes_mallows"] == v["f1"] == v["purity"] == v["adjusted_rand"] == pytest.approx(1)
    assert v["entropy"] == pytest.approx(0, abs=1e-12) and v["minkowski"] == v["goodman_kruskal"] == pytest.approx(0)
    assert set(External.pairwise(same)) | set(External.conjugate(same)) == set(v)
    with pytest.raises(ValueError):
        counts(same.limit(0))


def test_meta_features(frame):
    f = dict(zip(NAMES, meta_features(frame)))
    assert sum(f[f"md{i}"] for i in range(1, 11)) == pytest.approx(1) and f["std"] ** 2 == pytest.approx(f["variance"])
    assert 0 < sum(f[f"z{i}"] for i in range(4)) < 1


def test_tiles_of_rows_all_near_are_not_compared(spark, monkeypatch):
    """Two clumps narrower than epsilon, and a chain between them: the same counts and clusters, and only tiles at the edge are compared."""
    from mosaica.operators import dbscan

    monkeypatch.setattr(dbscan, "ROWS", 16)
    r = np.random.default_rng(8)
    x = np.concatenate([r.random((300, 2)) * 0.5, r.random((300, 2)) * 0.5 + 4, np.stack([np.arange(12) * 0.3 + 0.5] * 2, axis=1)])
    ms = (Modality("p", 2),)
    f = MultiFrame(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{ID} long, p array<double>"), ms, len(x))
    d = pairwise(ms, x, x)
    for eps in (1.0, 0.43):
        boxes = boxes_of(f, eps)
        assert {q[ID]: q.neighbours for q in neighbour_counts(f, eps, boxes).collect()} == dict(enumerate((d <= eps).sum(1).tolist()))
        got = {q[ID]: q[LABEL] for q in DBSCAN(eps, 4).labels(f).collect()}
        core = (d <= eps).sum(1) >= 4
        lab = np.arange(len(x))
        while True:
            new = np.array([lab[(d[i] <= eps) & core].min() if core[i] else i for i in range(len(x))])
            if (new == lab).all():
                break
            lab = new
        number = {k: n for n, k in enumerate(sorted(set(lab[core].tolist())))}
        assert got == {i: number[lab[i]] if core[i] else -1 for i in range(len(x))}
    b = dbscan.Bounds(dbscan.boxed(f.df, boxes_of(f, 1.0)), 2)
    some, every = dbscan.near_tiles(b, b, boxes_of(f, 1.0))
    assert len(every) > 0.4 * len(b.n) ** 2 and len(some) < 0.15 * len(b.n) ** 2


def test_neighbours_of_equal_rows_are_those_of_least_id(spark, monkeypatch):
    from mosaica.functions import tiles
    from mosaica.operators.spectral import nearest_neighbours

    monkeypatch.setattr(tiles, "ROWS", 23)
    monkeypatch.setattr(tiles, "RUN", 2)
    r = np.random.default_rng(9)
    x = np.repeat(r.standard_normal((30, 12)), 4, axis=0)[r.permutation(120)] + 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], f"{ID} long, p array<double>")
    got = {(q[ID], q["rank"]): q.neighbour for q in nearest_neighbours(df, [Modality("p", 12)], 6).collect()}
    for i in range(120):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, k + 1] for k in range(6)] == np.lexsort((np.arange(120), d))[:6].tolist()


def test_sums_of_similarities(spark, monkeypatch):
    from mosaica.functions import tiles
    from mosaica.operators.spectral import affinity_sums

    monkeypatch.setattr(tiles, "ROWS", 17)
    monkeypatch.setattr(tiles, "RUN", 2)
    r = np.random.default_rng(4)
    x, v = r.standard_normal((60, 7)), r.standard_normal((60, 3))
    df = spark.createDataFrame([(i, p.tolist(), q.tolist()) for i, (p, q) in enumerate(zip(x, v))], f"{ID} long, p array<double>, v array<double>")
    got = np.zeros((60, 3))
    for q in affinity_sums(df, [Modality("p", 7)], 0.3, "v", 3).collect():
        got[q[ID], q.k] = q.y
    assert np.allclose(got, np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2)) @ v, atol=1e-12)


def test_residuals_are_small_in_absolute_terms_too():
    r = np.random.default_rng(6)
    q = np.linalg.qr(r.standard_normal((400, 400)))[0]
    a = (q * np.concatenate([[1e6], 0.9 ** np.arange(399) * 1e4])) @ q.T
    w, v = eigenvectors(lambda x: a @ x, 400, 6)
    assert residuals(a, w, v) < 1e-7


def test_meta_features_of_many_tiles(spark, monkeypatch):
    from mosaica.functions import tiles

    monkeypatch.setattr(tiles, "ROWS", 11)
    monkeypatch.setattr(tiles, "RUN", 2)
    r = np.random.default_rng(7)
    x = r.random((70, 8)) + 10
    m = Modality("p", 8)
    d = pairwise([m], x, x)[np.triu_indices(70, 1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{ID} long, p array<double>")
    got = dict(zip(NAMES, meta_features(MultiFrame(df, (Modality("p", 8, norm=exact_diameter(df, m)),), 70))))
    d /= d.max()
    z = (d - d.mean()) / d.std()
    assert got["kurtosis"] == pytest.approx((z**4).mean() - 3) and got["skewness"] == pytest.approx((z**3).mean())
    assert [got[f"md{k + 1}"] for k in range(10)] == pytest.approx([((d >= k * 0.1) & ((d < (k + 1) * 0.1) | (k == 9))).mean() for k in range(10)], abs=1e-12)
    assert [got[f"z{k}"] for k in range(4)] == pytest.approx([((z >= k) & ((z < k + 1) | (k == 3))).mean() for k in range(4)], abs=1e-12)
