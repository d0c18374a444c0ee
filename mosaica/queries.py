"""Queries of the library's operators over whole tables, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distances as dist
from .functions.encoders import HashingEncoder, encode_column
from .functions.norms import approximate_diameter, exact_diameter, farthest
from .functions.tiles import merge, over_pairs, tiles
from .modality import CLASS, ID, LABEL, Modality, MultiFrame
from .operators import external, metafeatures
from .operators.clique import CLIQUE, first_grid
from .operators.dbscan import DBSCAN, neighbour_counts
from .operators.hierarchical import CURE, Birch
from .operators.internal import Clusters, Internal
from .operators.kmeans import BisectingKMeans, KMeans, MeanShift, lloyd_step, shift_step
from .operators.spectral import SpectralAdjacency, SpectralSimilarity, affinity_sums, nearest_neighbours
from .plans import prep
from .plans.search import SPACES, AutoCluster, RandomOpt, UcbMab, cumulative_best
from .session import shared_dir
from .sources import files
from .sources.blobs import blobs
from .sources.datasets import register_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, DIGITS)


def value(spark: SparkSession, v: float) -> DataFrame:
    return spark.createDataFrame([(round(float(v), DIGITS),)], "value double")


# ---- frames -------------------------------------------------------------------------------------------------------

E1 = Modality("e", 64)
TWO = (Modality("m1", 32, "manhattan", 0.4), Modality("m2", 32, "euclidean", 0.6))


def embedded(spark: SparkSession, sf_dir: str, metric: str = "euclidean") -> MultiFrame:
    """``embeddings`` as one modality, its label both class and cluster."""
    t = table(spark, sf_dir, "embeddings")
    df = t.select(F.col("vec_id").alias(ID), F.col("label").cast("int").alias(LABEL), F.col("embedding").cast("array<double>").alias("e"))
    return MultiFrame.of(df, [replace(E1, metric=metric)])


def halves(spark: SparkSession, sf_dir: str) -> MultiFrame:
    """``embeddings`` as two modalities, with exact norms."""
    f = embedded(spark, sf_dir)
    df = f.df.select(ID, LABEL, F.slice("e", 1, 32).alias("m1"), F.slice("e", 33, 32).alias("m2"))
    return MultiFrame(df, tuple(replace(m, norm=exact_diameter(df, m)) for m in TWO), f.amount)


def plain(frame: MultiFrame) -> MultiFrame:
    return frame.like(frame.df.drop(LABEL))


V = "v AS (SELECT vec_id AS id, label AS l, embedding::DOUBLE[] AS e FROM embeddings)"
TERM = "list_sum(list_transform(list_zip({a}, {b}), lambda p: {t}))"


def total(a: str, b: str, term: str) -> str:
    return TERM.format(a=a, b=b, t=term)


def metric_sql(name: str, a: str, b: str) -> str:
    return {
        "manhattan": total(a, b, "abs(p[1] - p[2])"),
        "euclidean": f"list_distance({a}, {b})",
        "chebyshev": f"list_max(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
        "canberra": total(a, b, "CASE WHEN abs(p[1]) + abs(p[2]) > 1e-9 THEN abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) ELSE 0 END"),
        "cosine": f"list_cosine_distance({a}, {b})",
    }[name]


# ---- distances ----------------------------------------------------------------------------------------------------


def _distance(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = embedded(spark, sf_dir, metric)
        ms = f.modalities

        def over(pairs):
            held = {}
            for a, b in pairs:
                d = dist.pairwise(ms, a.x, b.x)
                own = a.ids[:, None] == b.ids[None, :]
                low = high = d
                if own.any():
                    d, low, high = np.where(own, 0, d), np.where(own, np.inf, d), np.where(own, -np.inf, d)
                for t, axis in ((a, 1), (b, 0))[: 1 + (a.tile != b.tile)]:
                    merge(held, t, (np.add, d.sum(axis)), (np.minimum, low.min(axis)), (np.maximum, high.max(axis)))
            for ids, s, l, m in held.values():
                some = np.flatnonzero(l < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, s, l, m)], names=["id", "s", "l", "m"])

        got = over_pairs(tiles(f.df, ms), ms, over, "id long, s double, l double, m double", once=True)
        return got.groupBy(F.col("id").alias("vec_id")).agg(r6(F.sum("s")).alias("total"), r6(F.min("l")).alias("least"), r6(F.max("m")).alias("most"))

    return run


def _expression(metric: str) -> Query:
    """Each row's distance from the first, as a column expression."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embedded(spark, sf_dir).df
        first = df.agg(F.min_by("e", ID).alias("o"))
        return df.crossJoin(F.broadcast(first)).select(F.col(ID).alias("vec_id"), r6(dist.metric(metric, "e", "o", 64)).alias("d"))

    return run


for _k, _m in enumerate(("manhattan", "euclidean", "chebyshev", "canberra", "cosine"), 1):
    query(f"d{_k}_{_m}", f"WITH {V}, p AS (SELECT a.id, {metric_sql(_m, 'a.e', 'b.e')} AS d FROM v a JOIN v b ON a.id <> b.id) SELECT id AS vec_id, round(sum(d), 6) AS total, round(min(d), 6) AS least, round(max(d), 6) AS most FROM p GROUP BY id")(_distance(_m))
    query(f"d{_k}_{_m}_expression", f"WITH {V}, o AS (SELECT e FROM v ORDER BY id LIMIT 1) SELECT v.id AS vec_id, round({metric_sql(_m, 'v.e', 'o.e')}, 6) AS d FROM v, o")(_expression(_m))

HALVES = f"{V}, h AS (SELECT id, l, e[1:32] AS m1, e[33:64] AS m2 FROM v), norms AS (SELECT max({metric_sql('manhattan', 'a.m1', 'b.m1')}) AS n1, max({metric_sql('euclidean', 'a.m2', 'b.m2')}) AS n2 FROM h a JOIN h b ON a.id < b.id)"
MULTI = f"sqrt(0.4 * ({metric_sql('manhattan', 'a.m1', 'b.m1')} / n1) ** 2 + 0.6 * ({metric_sql('euclidean', 'a.m2', 'b.m2')} / n2) ** 2)"


@query("d6_normalised", f"WITH {HALVES}, o AS (SELECT m1 FROM h ORDER BY id LIMIT 1) SELECT id AS vec_id, round({metric_sql('manhattan', 'h.m1', 'o.m1')} / n1, 6) AS d FROM h, o, norms")
def d6_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = halves(spark, sf_dir)
    first = f.df.select(F.min_by("m1", ID).alias("o"))
    return f.df.crossJoin(F.broadcast(first)).select(F.col(ID).alias("vec_id"), r6(dist.metric("manhattan", "m1", "o", 32) / f.modalities[0].norm).alias("d"))


@query("d7_multimodal", f"WITH {HALVES} SELECT a.id AS vec_id, round(sum({MULTI}), 6) AS total, round(max({MULTI}), 6) AS most FROM h a JOIN h b ON a.id <> b.id, norms GROUP BY a.id")
def d7_multimodal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = halves(spark, sf_dir)
    ms = f.modalities

    def run(pairs):
        held = {}
        for a, b in pairs:
            d = dist.pairwise(ms, a.x, b.x)
            for t, axis in ((a, 1), (b, 0))[: 1 + (a.tile != b.tile)]:
                merge(held, t, (np.add, d.sum(axis)), (np.maximum, d.max(axis)))
        for ids, s, m in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s), pa.array(m)], names=["id", "s", "m"])

    got = over_pairs(tiles(f.df, ms), ms, run, "id long, s double, m double", once=True)
    return got.groupBy(F.col("id").alias("vec_id")).agg(r6(F.sum("s")).alias("total"), r6(F.max("m")).alias("most"))


@query("d7_multimodal_expression", f"WITH {HALVES}, o AS (SELECT m1, m2 FROM h ORDER BY id LIMIT 1) SELECT a.id AS vec_id, round({MULTI}, 6) AS d FROM h a, o b, norms")
def d7_multimodal_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = halves(spark, sf_dir)
    first = f.df.agg(F.min_by("m1", ID).alias("m1_2"), F.min_by("m2", ID).alias("m2_2"))
    return f.df.crossJoin(F.broadcast(first)).select(F.col(ID).alias("vec_id"), r6(dist.multimodal(f.modalities)).alias("d"))


def _rounds() -> str:
    """Five rounds of farthest rows; a pair that repeats stays, so there is no need to stop."""
    out = [f"WITH {V}", "p0 AS (SELECT e FROM v ORDER BY id LIMIT 1)"]
    for k in range(5):
        for a, b in ((f"p{k}", f"q{k}"), (f"q{k}", f"p{k + 1}")):
            out.append(f"{b} AS (SELECT v.e, list_distance(v.e, {a}.e) AS d FROM v, {a} ORDER BY d DESC, id LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT d FROM {t}" for k in range(5) for t in (f"q{k}", f"p{k + 1}"))
    return ", ".join(out) + f" SELECT round(max(d), 6) AS value FROM ({every})"


@query("d8_diameter_approximate", _rounds())
def d8_diameter_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    return value(spark, approximate_diameter(f.df, f.modalities[0]))


@query("d8_diameter_exact", f"WITH {V} SELECT round(max(list_distance(a.e, b.e)), 6) AS value FROM v a JOIN v b ON a.id < b.id")
def d8_diameter_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    return value(spark, exact_diameter(f.df, f.modalities[0]))


@query("d9_farthest", f"WITH {V}, o AS (SELECT e FROM v ORDER BY id LIMIT 1) SELECT id AS vec_id, round(list_distance(v.e, o.e), 6) AS d FROM v, o ORDER BY list_distance(v.e, o.e) DESC, id LIMIT 1")
def d9_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    pivot = f.df.agg(F.min_by("e", ID)).first()[0]
    far = farthest(f.df, f.modalities[0], pivot)
    return spark.createDataFrame([(far[0], round(far[2], DIGITS))], "vec_id long, d double")


@query("d10_one_dimension", f"WITH {HALVES}, o AS (SELECT m2 FROM h ORDER BY id LIMIT 1) SELECT id AS vec_id, round(sqrt(0.6) / n2 * abs(h.m2[1] - o.m2[1]), 6) AS d FROM h, o, norms")
def d10_one_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = halves(spark, sf_dir)
    first = f.df.agg(F.min_by("m2", ID).alias("o"))
    return f.df.crossJoin(F.broadcast(first)).select(F.col(ID).alias("vec_id"), r6(dist.one_dimension(f.modalities[1], F.col("m2")[0], F.col("o")[0])).alias("d"))


# ---- row algebra --------------------------------------------------------------------------------------------------


@query("l1_plus", f"WITH {V}, o AS (SELECT e FROM v ORDER BY id LIMIT 1) SELECT id AS vec_id, round({total('v.e', 'o.e', '(2 * p[1] - 0.5 * p[2]) * p[1]')}, 6) AS d FROM v, o")
def l1_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir).df
    first = df.agg(F.min_by("e", ID).alias("o"))
    both = df.crossJoin(F.broadcast(first)).withColumn("s", dist.plus("e", "o", 2.0, -0.5))
    return both.select(F.col(ID).alias("vec_id"), r6(dist._total(F.col("s"), F.col("e"), None, lambda a, b: a * b)).alias("d"))


@query("l2_scale", f"WITH {V} SELECT id AS vec_id, round(list_sum(list_transform(e, lambda x: 3 * x)), 6) AS d FROM v")
def l2_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).df.select(F.col(ID).alias("vec_id"), r6(F.aggregate(dist.scale("e", 3.0), F.lit(0.0), lambda a, b: a + b)).alias("d"))


@query("l4_centroid", f"WITH {V}, x AS (SELECT l, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) SELECT l::INTEGER AS label, dim::INTEGER AS dim, round(avg(x), 6) AS mean FROM x GROUP BY l, dim")
def l4_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _, c = Clusters(embedded(spark, sf_dir)).centres
    return spark.createDataFrame([(int(l), k, round(float(x), DIGITS)) for l, row in zip(labels, c) for k, x in enumerate(row)], "label int, dim int, mean double")


@query("l5_l2", f"WITH {HALVES} SELECT id AS vec_id, round(0.4 * sqrt({total('m1', 'm1', 'p[1] * p[2]')}) + 0.6 * sqrt({total('m2', 'm2', 'p[1] * p[2]')}), 6) AS d FROM h")
def l5_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir).df.select(ID, F.slice("e", 1, 32).alias("m1"), F.slice("e", 33, 32).alias("m2"))
    return f.select(F.col(ID).alias("vec_id"), r6(dist.l2(TWO)).alias("d"))


@query("l6_zero", "SELECT vec_id, 64 AS width, 0.0::DOUBLE AS total FROM embeddings")
def l6_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = embedded(spark, sf_dir).df.withColumn("z", dist.zero(E1))
    return z.select(F.col(ID).alias("vec_id"), F.size("z").alias("width"), F.aggregate("z", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("l7_flatten_wrap", f"WITH {V} SELECT id AS vec_id, round(e[41], 6) AS by_global, round(list_sum(e[33:64]), 6) AS second FROM v")
def l7_flatten_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir).df.select(ID, F.slice("e", 1, 32).alias("m1"), F.slice("e", 33, 32).alias("m2"))
    df = df.withColumn("g", dist.by_global(TWO, 40)).withColumn("flat", dist.flatten(TWO)).select(ID, "g", *dist.wrap(TWO, "flat"))
    return df.select(F.col(ID).alias("vec_id"), r6(F.col("g")).alias("by_global"), r6(F.aggregate("m2", F.lit(0.0), lambda a, b: a + b)).alias("second"))


@query("l3_elementwise", f"WITH {V}, o AS (SELECT e FROM v ORDER BY id LIMIT 1) SELECT id AS vec_id, round({total('v.e', 'o.e', 'least(p[1], p[2])')}, 6) AS low, round({total('v.e', 'o.e', 'greatest(p[1], p[2])')}, 6) AS high FROM v, o")
def l3_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir).df
    both = df.crossJoin(F.broadcast(df.agg(F.min_by("e", ID).alias("o"))))
    added = lambda f: r6(F.aggregate(dist.elementwise("e", "o", f), F.lit(0.0), lambda a, b: a + b))
    return both.select(F.col(ID).alias("vec_id"), added(F.least).alias("low"), added(F.greatest).alias("high"))


@query("l8_same_rows", "SELECT vec_id, (vec_id % 3 <> 0) AS same FROM embeddings")
def l8_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row beside a copy; of every third the last coordinate is off by more than the tolerance, of the others by less."""
    df = embedded(spark, sf_dir).df.select(F.col(ID).alias("vec_id"), "e")
    off = F.when(F.col("vec_id") % 3 == 0, 1e-9).otherwise(1e-13)
    copy = F.transform("e", lambda x, i: F.when(i == 63, x + off).otherwise(x))
    return df.withColumn("e_2", copy).select("vec_id", dist.same([E1]).alias("same"))


# ---- preparation --------------------------------------------------------------------------------------------------

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("p1_class_codes", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS _class FROM customer")
def p1_class_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.code_classes(table(spark, sf_dir, "customer"), "c_mktsegment")[0].select("c_custkey", CLASS)


@query("p2_used_rows", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey IS NOT NULL AND s_acctbal IS NOT NULL")
def p2_used_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.used_rows(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"])


@query("p3_ids", "SELECT count(*) AS rows, count(*) AS ids FROM lineitem")
def p3_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.add_ids(table(spark, sf_dir, "lineitem")).agg(F.count("*").alias("rows"), F.countDistinct(ID).alias("ids"))


@query("p4_partition_auto", "SELECT count(*) AS rows, (floor(sqrt(count(*)) / log10(count(*))) + 1)::INTEGER AS partitions FROM orders")
def p4_partition_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.partitioned(table(spark, sf_dir, "orders"), "auto")
    return spark.createDataFrame([(df.count(), df.rdd.getNumPartitions())], "rows long, partitions int")


@query("p7_auto_weights", "SELECT 'mixed' AS name, (1 + count(DISTINCT p_brand) + count(DISTINCT p_type))::INTEGER AS dim, 0.75::DOUBLE AS weight FROM part UNION ALL SELECT 'price', 1, 0.25::DOUBLE")
def p7_auto_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = prep.Builder(table(spark, sf_dir, "part")).tabular("mixed", ["p_size", "p_brand", "p_type"]).tabular("price", ["p_retailprice"]).create()
    return spark.createDataFrame([(m.name, m.dim, round(m.weight, DIGITS)) for m in f.modalities], "name string, dim int, weight double")


@query(
    "p12_normalise",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE 2 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) - 1 END, 6) AS {c}" for c in NUMBERS) + " FROM lineitem",
)
def p12_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.scale_columns(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS), NUMBERS)
    return df.select("l_orderkey", "l_linenumber", *(r6(F.col(c)).alias(c) for c in NUMBERS))


@query(
    "p13_one_hot",
    "WITH f AS (SELECT l_returnflag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) AS i FROM lineitem GROUP BY 1), g AS (SELECT l_linestatus, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) AS j FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM g) "
    "SELECT (n + i)::INTEGER AS flag_at, j::INTEGER AS status_at, count(*) AS rows FROM lineitem JOIN f USING (l_returnflag) JOIN g USING (l_linestatus), n GROUP BY ALL",
)
def p13_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prep.TabularStage("t", ["l_returnflag", "l_linestatus"])
    df = s.fit(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))
    status = s.sizes[s.strings.index("l_linestatus")]
    flag = F.array_position(F.slice("t", status + 1, 99), 1.0).cast("int") + status
    return df.select(flag.alias("flag_at"), F.array_position("t", 1.0).cast("int").alias("status_at")).groupBy("flag_at", "status_at").agg(F.count("*").alias("rows"))


@query("p16_vector_dim", "SELECT max(len(embedding))::INTEGER AS dim FROM embeddings")
def p16_vector_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(prep.dim_of(table(spark, sf_dir, "embeddings"), "embedding"),)], "dim int")


class LengthEncoder:
    """Characters and words of a text: an encoder whose vectors SQL can check."""

    dim = 2

    def load(self) -> None:
        pass

    def encode(self, values: list):
        return np.array([[len(v or ""), len((v or "").split(" "))] for v in values], float).reshape(len(values), 2)


_LENGTHS = "x AS (SELECT doc_id, length(coalesce(text, ''))::FLOAT::DOUBLE AS a, len(string_split(coalesce(text, ''), ' '))::FLOAT::DOUBLE AS b FROM documents)"
_LENGTHS_SCALED = f"WITH {_LENGTHS}, y AS (SELECT doc_id, 2 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) - 1 AS a, 2 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) - 1 AS b FROM x)"


@query("p17_pca", f"{_LENGTHS_SCALED}, c AS (SELECT var_samp(a) AS p, var_samp(b) AS q, covar_samp(a, b) AS r FROM y), l AS (SELECT (p + q) / 2 + sqrt(((p - q) / 2) ** 2 + r * r) AS big, p, q, r FROM c), z AS (SELECT doc_id, (r * a + (big - p) * b) / sqrt(r * r + (big - p) ** 2) AS t, big / (p + q) AS share FROM y, l) SELECT doc_id, round(share, 6) AS share, round(abs(2 * (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) - 1), 4) AS place FROM z")
def p17_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of two scaled features, scaled again; without its sign, which PCA leaves open."""
    s = prep.DeepStage("text", LengthEncoder())
    df = s.fit(table(spark, sf_dir, "documents").select("doc_id", "text"))
    share = float(s.pca.explainedVariance.toArray()[0])
    return df.select("doc_id", F.lit(round(share, DIGITS)).alias("share"), F.round(F.abs(F.col("text")[0]), 4).alias("place"))


@query(
    "p19_tabular",
    "WITH b AS (SELECT c_nationkey, c_acctbal, c_custkey, c_mktsegment FROM customer), s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS i FROM b GROUP BY 1) "
    "SELECT c_custkey, round(2 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) - 1, 6) AS balance, round(2.0 * (c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ()) - 1, 6)::DOUBLE AS nation, i::INTEGER AS segment_at FROM b JOIN s USING (c_mktsegment)",
)
def p19_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.TabularStage("t", ["c_acctbal", "c_nationkey", "c_mktsegment"]).fit(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment"))
    return df.select("c_custkey", r6(F.col("t")[0]).alias("balance"), r6(F.col("t")[1]).alias("nation"), F.array_position(F.slice("t", 3, 99), 1.0).cast("int").alias("segment_at"))


@query("p22_builder", "SELECT vec_id AS _id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS _class, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], lo, hi), lambda p: 2 * (p[1] - p[2]) / (p[3] - p[2]) - 1)), 6) AS total FROM embeddings, (SELECT list(lo ORDER BY d) AS lo, list(hi ORDER BY d) AS hi FROM (SELECT d, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY d))")
def p22_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ID), F.col("embedding").alias("e"), "label")
    f = prep.Builder(raw, class_col="label").vector("e").create()
    return f.df.select(ID, CLASS, r6(F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("p23_frame", "SELECT count(*) AS amount, 64 AS global_dim, (count(*) * 640)::BIGINT AS memory FROM embeddings")
def p23_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    return spark.createDataFrame([(f.amount, f.global_dim, f.estimate_mem)], "amount long, global_dim int, memory long")


@query("p24_clean", "SELECT n_nationkey AS key, trim(n_name) AS name FROM nation")
def p24_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("n_name"), F.concat(F.lit(" "), F.col("n_nationkey").cast("string")).alias("k"))
    return files.clean(t, trims=["n_name"], ints=["k"], renames={"n_name": "name", "k": "key"}).select("key", "name")


@query("p24_split_concat_contains", "SELECT c_custkey, c_name[instr(c_name, '#') + 1 :] AS number, c_mktsegment || '/' || c_nationkey::VARCHAR AS place FROM customer WHERE contains(c_mktsegment, 'U')")
def p24_split_concat_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = files.clean(table(spark, sf_dir, "customer"), splits={"number": ("c_name", "#", 1)}, joins={"place": ["c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")]}, holding={"c_mktsegment": "U"})
    return t.select("c_custkey", "number", "place")


# ---- sources ------------------------------------------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s1_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "csv")
    table(spark, sf_dir, "nation").write.csv(p, header=True)
    return files.read_csv(spark, p)


@query("s2_delimited", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def s2_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "csv")
    table(spark, sf_dir, "customer").drop("c_acctbal").write.csv(p, sep="|", header=True)
    return files.read_csv(spark, p, sep="|", schema="c_custkey long, c_name string, c_nationkey int, c_mktsegment string")


@query("s3_headerless", "SELECT r_regionkey AS _c0, r_name AS _c1 FROM region")
def s3_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "csv")
    table(spark, sf_dir, "region").write.csv(p)
    return files.read_csv(spark, p, header=False)


@query("s4_saved_frame", f"WITH {V} SELECT id AS _id, round(list_sum(e), 6) AS total FROM v")
def s4_saved_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "frame")
    files.save(embedded(spark, sf_dir), p)
    f = files.load(spark, p)
    return f.df.select(ID, r6(F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query("s5_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, name)")
def s5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_rows(spark, [(1, "a"), (2, "b")], "k int, name string")


@query("s6_pandas", "SELECT r_regionkey, r_name FROM region")
def s6_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.from_pandas(spark, table(spark, sf_dir, "region").toPandas())


@query("s7_list_files", "SELECT r_regionkey::INTEGER AS folder, 1::BIGINT AS files FROM region")
def s7_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file in a folder for each region, and others that the pattern leaves out."""
    p = _path(spark, "text")
    t = table(spark, sf_dir, "region").coalesce(1).select("r_name", F.col("r_regionkey").alias("folder"))
    t.write.partitionBy("folder").text(p)
    t.write.mode("append").partitionBy("folder").csv(p)
    found = files.list_files(spark, p, "*.txt")
    return found.select(F.regexp_extract("img_path", "folder=([0-9]+)/", 1).cast("int").alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


@query("s8_read_bytes", "SELECT sum(length(r_name) + 1)::BIGINT AS bytes FROM region")
def s8_read_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _path(spark, "text")
    table(spark, sf_dir, "region").select("r_name").write.text(p)
    return files.read_bytes(spark, p, "*.txt").agg(F.sum(F.length("content")).alias("bytes"))


@query("s9_modalities", "SELECT 'm1' AS name, 32 AS dim, 'manhattan' AS metric, 0.4::DOUBLE AS weight UNION ALL SELECT 'm2', 32, 'euclidean', 0.6::DOUBLE")
def s9_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    df = f.df.select(ID, F.slice("e", 1, 32).alias("m1"), F.slice("e", 33, 32).alias("m2"))
    again = MultiFrame.restore(df, MultiFrame(df, TWO, f.amount).modal_dict)
    return spark.createDataFrame([(m.name, m.dim, m.metric, m.weight) for m in again.modalities], "name string, dim int, metric string, weight double")


@query("s11_zip", "WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) SELECT s_suppkey, n_name FROM a JOIN b USING (n)")
def s11_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.zip_rows(table(spark, sf_dir, "supplier").select("s_suppkey"), table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "s_suppkey", "n_nationkey").select("s_suppkey", "n_name")


@query("s12_blobs", "SELECT 2000::BIGINT AS rows, 5::BIGINT AS classes, 2000::BIGINT AS ids, 30 AS first, 20 AS second")
def s12_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = blobs(spark, 2000, 5)
    return f.df.agg(F.count("*").alias("rows"), F.countDistinct(CLASS).alias("classes"), F.countDistinct(ID).alias("ids"), F.max(F.size("m1")).alias("first"), F.max(F.size("m2")).alias("second"))


@query("a15_fetchers", "SELECT 'customers' AS name, count(*) AS rows, count(DISTINCT c_mktsegment) AS classes, 2::INTEGER AS width FROM customer UNION ALL SELECT 'embeddings', count(*), count(DISTINCT label), 64 FROM embeddings UNION ALL SELECT 'lines', count(*), count(DISTINCT l_linestatus), (4 + count(DISTINCT l_returnflag))::INTEGER FROM lineitem")
def a15_fetchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets by name: prepared and written at first, read again the second time."""
    register_tables(sf_dir)
    cache, out = _path(spark, "fetched"), []
    for name in ("customers", "embeddings", "lines"):
        f = [files.by_name(name).preprocessed(spark, cache) for _ in range(2)][1]
        out.append((name, f.df.count(), f.df.select(CLASS).distinct().count(), f.global_dim))
    return spark.createDataFrame(out, "name string, rows long, classes long, width int")


# ---- internal measures --------------------------------------------------------------------------------------------

PARTS = f"""{V},
x AS (SELECT id, l, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
c AS (SELECT l, list(x ORDER BY d) AS e FROM (SELECT l, d, avg(x) AS x FROM x GROUP BY l, d) GROUP BY l),
g AS (SELECT list(x ORDER BY d) AS e FROM (SELECT d, avg(x) AS x FROM x GROUP BY d)),
n AS (SELECT l, count(*) AS n FROM v GROUP BY l),
own AS (SELECT v.id, v.l, list_distance(v.e, c.e) AS d FROM v JOIN c USING (l)),
s AS (SELECT l, sum(d) AS s, n, sum(d) / n AS m FROM own JOIN n USING (l) GROUP BY l, n),
k AS (SELECT a.l, b.l AS l2, list_distance(a.e, b.e) AS d FROM c a JOIN c b ON a.l <> b.l),
p AS (SELECT a.id, a.l, b.id AS id2, b.l AS l2, list_distance(a.e, b.e) AS d FROM v a CROSS JOIN v b),
far AS (SELECT l, arg_max(e, d) AS e FROM (SELECT v.l, v.e, own.d FROM v JOIN own ON own.id = v.id) GROUP BY l)"""
_NEAR = {"1": "(SELECT min(d) FROM p WHERE l <> l2)", "3": "(SELECT min(z) FROM (SELECT 0.5 * sum(d) / (a.n * b.n) AS z FROM p JOIN n a ON a.l = p.l JOIN n b ON b.l = p.l2 WHERE p.l <> p.l2 GROUP BY p.l, p.l2, a.n, b.n))", "4": "(SELECT min(d) FROM k)", "5": "(SELECT min((a.s + b.s) / (a.n + b.n)) FROM s a JOIN s b ON a.l <> b.l)"}
_WIDE = {"1": "(SELECT max(d) FROM p WHERE l = l2)", "1*": "(SELECT max(d) FROM (SELECT max(list_distance(v.e, far.e)) AS d FROM v JOIN far ON far.l = v.l GROUP BY v.l))", "3": "(SELECT max(2 * m) FROM s)"}
_MEASURES = {
    "ch": "SELECT ((SELECT sum(n) FROM n) - (SELECT count(*) FROM n)) / ((SELECT count(*) FROM n) - 1) * (SELECT sum(n * list_distance(c.e, g.e)) FROM c JOIN n USING (l), g) / (SELECT sum(s) FROM s)",
    "db": "SELECT avg(z) FROM (SELECT max((a.m + b.m) / k.d) AS z FROM k JOIN s a ON a.l = k.l JOIN s b ON b.l = k.l2 GROUP BY k.l)",
    "db*": "SELECT avg(z) FROM (SELECT max(a.m + b.m) / min(k.d) AS z FROM k JOIN s a ON a.l = k.l JOIN s b ON b.l = k.l2 GROUP BY k.l)",
    "sil": "SELECT avg((b - a) / greatest(a, b)) FROM (SELECT id, max(m) FILTER (l = l2) AS a, min(m) FILTER (l <> l2) AS b FROM (SELECT id, p.l, l2, sum(d) / n AS m FROM p JOIN n ON n.l = l2 GROUP BY id, p.l, l2, n) GROUP BY id)",
    "sil*": "SELECT avg((b - a) / greatest(a, b)) FROM (SELECT v.id, max(list_distance(v.e, c.e)) FILTER (v.l = c.l) AS a, min(list_distance(v.e, c.e)) FILTER (v.l <> c.l) AS b FROM v CROSS JOIN c GROUP BY v.id)",
    "sf": "SELECT (SELECT sum(z) FROM (SELECT min(d) AS z FROM k GROUP BY l)) / (SELECT sum(d) FROM (SELECT d, row_number() OVER (PARTITION BY l ORDER BY d, id) - 1 AS r, n FROM own JOIN n USING (l)) WHERE r >= floor(0.9 * n))",
    "dunn": f"SELECT {_NEAR['1']} / {_WIDE['1']}",
    "gd31": f"SELECT {_NEAR['3']} / {_WIDE['1']}",
    "gd33": f"SELECT {_NEAR['3']} / {_WIDE['3']}",
    "gd41": f"SELECT {_NEAR['4']} / {_WIDE['1']}",
    "gd41*": f"SELECT {_NEAR['4']} / {_WIDE['1*']}",
    "gd43": f"SELECT {_NEAR['4']} / {_WIDE['3']}",
    "gd51": f"SELECT {_NEAR['5']} / {_WIDE['1']}",
    "gd51*": f"SELECT {_NEAR['5']} / {_WIDE['1*']}",
    "gd53": f"SELECT {_NEAR['5']} / {_WIDE['3']}",
}


def _internal(m: Internal) -> Query:
    return lambda spark, sf_dir: value(spark, m.evaluate(embedded(spark, sf_dir)))


for _k, _i in enumerate(Internal, 1):
    query(f"m{_k}_{_i.name.lower()}", f"WITH {PARTS}, result(value) AS ({_MEASURES[_i.key]}) SELECT round(value, 6) AS value FROM result")(_internal(_i))


@query("p25_noise_filter", "SELECT count(*) AS rows FROM embeddings WHERE label <> 0")
def p25_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    noisy = f.like(f.df.withColumn(LABEL, F.col(LABEL) - 1))
    return Clusters(noisy).df.agg(F.count("*").alias("rows"))


# ---- external measures --------------------------------------------------------------------------------------------

_SETS = {
    "": ("embeddings", "label", "vec_id % 3", lambda t: t.select(F.col("label").alias(CLASS), (F.col("vec_id") % 3).cast("int").alias(LABEL))),
    "_orders": ("orders", "o_orderstatus", "o_orderpriority", lambda t: t.select(F.col("o_orderstatus").alias(CLASS), F.col("o_orderpriority").alias(LABEL))),
    "_labels": ("labels", "quality", "toxic", lambda t: t.select(F.col("quality").alias(CLASS), F.col("toxic").alias(LABEL))),
}
_EXTERNAL = {
    "rand": "(tp + tn) / pairs",
    "jaccard": "tp / (tp + fp + fn)",
    "fowlkes_mallows": "sqrt(tp / (tp + fp) * tp / (tp + fn))",
    "phi": "(tp / pairs * tn / pairs - fp / pairs * fn / pairs) / ((tp + fn) / pairs * (tp + fp) / pairs * (fn + tn) / pairs * (fp + tn) / pairs)",
    "f1": "(SELECT sum(b * f) FROM (SELECT j, b, max(2 * (n / a) * (n / b) / (n / a + n / b)) AS f FROM z GROUP BY j, b)) / total",
    "purity": "(SELECT sum(m) FROM (SELECT max(n) AS m FROM z GROUP BY i)) / total",
    "entropy": "-(SELECT sum(n * ln(n / a)) FROM z) / total",
    "minkowski": "sqrt(ca + cb - 2 * tp) / sqrt(cb)",
    "adjusted_rand": "(tp - (ca::HUGEINT * cb::HUGEINT // pairs::HUGEINT)) / ((ca + cb)::HUGEINT // 2 - (ca::HUGEINT * cb::HUGEINT // pairs::HUGEINT))",
    "goodman_kruskal": "1 - (SELECT sum(m) FROM (SELECT max(n) AS m FROM z GROUP BY i)) / total",
    "var_info": "-(SELECT sum(a / total * ln(a / total)) FROM (SELECT DISTINCT i, a FROM z)) - (SELECT sum(b / total * ln(b / total)) FROM (SELECT DISTINCT j, b FROM z)) - 2 * (SELECT sum(n / total * ln(n / (a * b))) FROM z)",
}


def _cells(t: str, i: str, j: str) -> str:
    return f"""WITH z AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i) AS a, sum(n) OVER (PARTITION BY j) AS b FROM (SELECT {i} AS i, {j} AS j, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2)),
q AS (SELECT total, total * (total - 1) / 2 AS pairs, tp, ca, cb, cb - tp AS fp, ca - tp AS fn, total * (total - 1) / 2 - ca - cb + tp AS tn FROM
(SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS tp FROM z), (SELECT sum(a * (a - 1) / 2) AS ca FROM (SELECT DISTINCT i, a FROM z)), (SELECT sum(b * (b - 1) / 2) AS cb FROM (SELECT DISTINCT j, b FROM z)))"""


def _external(t: str, f, m: external.External) -> Query:
    return lambda spark, sf_dir: value(spark, m.evaluate(f(table(spark, sf_dir, t))))


for _tag, (_t, _a, _b, _f) in _SETS.items():
    for _k, _x in enumerate(external.External, 1):
        query(f"e{_k}_{_x.value}{_tag}", f"{_cells(_t, _a, _b)} SELECT round(({_EXTERNAL[_x.value]})::DOUBLE, 6) AS value FROM q")(_external(_t, _f, _x))


@query("e12_pair_counts", "SELECT count(*) FILTER (a.label = b.label AND a.vec_id % 3 = b.vec_id % 3)::BIGINT AS tp, count(*) FILTER (a.label <> b.label AND a.vec_id % 3 = b.vec_id % 3)::BIGINT AS fp, count(*) FILTER (a.label = b.label AND a.vec_id % 3 <> b.vec_id % 3)::BIGINT AS fn, count(*) FILTER (a.label <> b.label AND a.vec_id % 3 <> b.vec_id % 3)::BIGINT AS tn FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def e12_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = external.counts(_SETS[""][3](table(spark, sf_dir, "embeddings"))).pairs
    return spark.createDataFrame([(c["tp"], c["fp"], c["fn"], c["tn"])], "tp long, fp long, fn long, tn long")


@query("e13_contingency", "SELECT label::INTEGER AS _class, (vec_id % 3)::INTEGER AS _label, count(*) AS rows FROM embeddings GROUP BY 1, 2")
def e13_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SETS[""][3](table(spark, sf_dir, "embeddings")).groupBy(CLASS, LABEL).agg(F.count("*").alias("rows"))


_CONJUGATE = [m.value for m in external.External if m.value not in ("rand", "jaccard", "fowlkes_mallows", "phi")]


@query("e13_conjugate", f"{_cells('orders', 'o_orderstatus', 'o_orderpriority')} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, round(({_EXTERNAL[m]})::DOUBLE, 6) AS value FROM q" for m in _CONJUGATE))
def e13_conjugate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = external.External.conjugate(_SETS["_orders"][3](table(spark, sf_dir, "orders")))
    return spark.createDataFrame([(m, round(float(v), DIGITS)) for m, v in got.items()], "measure string, value double")


@query("e12_pairwise", f"{_cells('orders', 'o_orderstatus', 'o_orderpriority')} " + " UNION ALL ".join(f"SELECT '{m}' AS measure, round(({_EXTERNAL[m]})::DOUBLE, 6) AS value FROM q" for m in ("rand", "jaccard", "fowlkes_mallows", "phi")))
def e12_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = external.External.pairwise(_SETS["_orders"][3](table(spark, sf_dir, "orders")))
    return spark.createDataFrame([(m, round(float(v), DIGITS)) for m, v in got.items()], "measure string, value double")


# ---- meta-features and search -------------------------------------------------------------------------------------

_META = f"WITH {V}, nrm AS (SELECT max(list_distance(a.e, b.e)) AS m FROM v a JOIN v b ON a.id < b.id), p AS (SELECT list_distance(a.e, b.e) / m AS d FROM v a JOIN v b ON a.id < b.id, nrm), s AS (SELECT avg(d) AS mu, sqrt(avg(d * d) - avg(d) ** 2) AS sd0, count(*) AS n FROM p), t AS (SELECT mu, n, avg((d - mu) ** 2) AS v2, avg((d - mu) ** 3) AS v3, avg((d - mu) ** 4) AS v4 FROM p, s GROUP BY mu, n), q AS (SELECT *, sqrt(v2) AS sd FROM t) "
_META += "SELECT round(any_value(mu), 6) AS mean, round(any_value(v2), 6) AS variance, round(any_value(sd), 6) AS std, round(any_value(v3 / sd ** 3), 6) AS skewness, round(any_value(v4 / sd ** 4 - 3), 6) AS kurtosis, "
_META += ", ".join(f"round(count(*) FILTER (d >= {i} * 0.1::DOUBLE AND {'d <= 10 * 0.1::DOUBLE' if i == 9 else f'd < {i + 1} * 0.1::DOUBLE'}) / any_value(n), 6) AS md{i + 1}" for i in range(10)) + ", "
_META += ", ".join(f"round(count(*) FILTER ((d - mu) / sd >= {i}{'' if i == 3 else f' AND (d - mu) / sd < {i + 1}'}) / any_value(n), 6) AS z{i}" for i in range(4)) + " FROM p, q"


@query("a1_meta_features", _META)
def a1_meta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    m = replace(f.modalities[0], norm=exact_diameter(f.df, f.modalities[0]))
    got = metafeatures.meta_features(replace(f, modalities=(m,)))
    return spark.createDataFrame([tuple(round(float(x), DIGITS) for x in got)], ", ".join(f"{n} double" for n in metafeatures.NAMES))


@query("a2_recommend")
def a2_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.recommend import recommend

    return spark.createDataFrame([(recommend(_normed(spark, sf_dir)).name,)], "measure string")


@query("a12_search")
def a12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = plain(_normed(spark, sf_dir))
    s = AutoCluster(f, [SPACES["KMeans"], SPACES["BisectingKMeans"]], UcbMab, RandomOpt, Internal.SILHOUETTE_APPROX)
    s.run(4)
    return s.history_frame(spark)


@query("a14_cumulative_best", "SELECT event_id AS step, event_type AS algo, round(min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS best, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events")
def a14_cumulative_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("algo"), "value")
    return cumulative_best(h).select("step", "algo", r6(F.col("best")).alias("best"), F.round("rolling", 4).alias("rolling"))


def _normed(spark: SparkSession, sf_dir: str) -> MultiFrame:
    f = embedded(spark, sf_dir)
    return replace(f, modalities=(replace(f.modalities[0], norm=approximate_diameter(f.df, f.modalities[0])),))


# ---- clustering ---------------------------------------------------------------------------------------------------


@query("c1_lloyd_step", f"WITH {PARTS}, a AS (SELECT v.id, arg_min(c.l, list_distance(v.e, c.e)) AS k FROM v CROSS JOIN c GROUP BY v.id) SELECT k::INTEGER AS cluster, count(*) AS rows, round(sum(list_sum(v.e)) / count(*), 6) AS mean_total FROM a JOIN v USING (id) GROUP BY k")
def c1_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    labels, _, c = Clusters(f).centres
    new, n, _ = lloyd_step(f, c)
    return spark.createDataFrame([(int(l), int(k), round(float(x.sum()), DIGITS)) for l, k, x in zip(labels, n, new) if k], "cluster int, rows long, mean_total double")


@query("c1_nearest_centroid", f"WITH {PARTS} SELECT v.id AS vec_id, arg_min(c.l, list_distance(v.e, c.e))::INTEGER AS _label FROM v CROSS JOIN c GROUP BY v.id")
def c1_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.base import CentreModel

    f = embedded(spark, sf_dir)
    labels, _, c = Clusters(f).centres
    return CentreModel(c, f.modalities, labels).predict(plain(f)).df.select(F.col(ID).alias("vec_id"), LABEL)


_RADIUS = 1.2


@query("c3_shift_step", f"WITH {PARTS}, w AS (SELECT c.l, v.e FROM v JOIN c ON list_distance(v.e, c.e) <= {_RADIUS}) SELECT l::INTEGER AS mode, count(*) AS rows, round(sum(list_sum(e)) / count(*), 6) AS mean_total FROM w GROUP BY l")
def c3_shift_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    labels, _, c = Clusters(f).centres
    return spark.createDataFrame([(int(labels[k]), n, round(float(m.sum()), DIGITS)) for k, (n, m) in shift_step(f, c, _RADIUS).items()], "mode int, rows long, mean_total double")


_EPS, _MIN = 1.2, 5


@query("c5e_neighbour_counts", f"WITH {V} SELECT a.id AS _id, count(*) AS neighbours FROM v a JOIN v b ON list_distance(a.e, b.e) <= {_EPS} GROUP BY a.id")
def c5e_neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_counts(embedded(spark, sf_dir), _EPS)


def _dbscan_sql(border_noise: bool) -> str:
    border = "" if border_noise else f", b AS (SELECT v.id, arg_min(g.root, (list_distance(v.e, w.e), w.id)) AS root FROM v CROSS JOIN g JOIN v w ON w.id = g.id WHERE v.id NOT IN (SELECT id FROM core) AND list_distance(v.e, w.e) <= {_EPS} GROUP BY v.id)"
    own = "g" if border_noise else "(SELECT * FROM g UNION ALL SELECT * FROM b)"
    return f"""WITH RECURSIVE {V}, near AS (SELECT a.id, b.id AS id2 FROM v a JOIN v b ON list_distance(a.e, b.e) <= {_EPS}),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= {_MIN}),
ce AS (SELECT near.id, id2 FROM near WHERE id IN (SELECT id FROM core) AND id2 IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.id2, reach.root FROM reach JOIN ce ON ce.id = reach.id),
g AS (SELECT id, min(root) AS root FROM reach GROUP BY id){border},
k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM g))
SELECT v.id AS _id, coalesce(k, -1)::INTEGER AS _label FROM v LEFT JOIN {own} o ON o.id = v.id LEFT JOIN k ON k.root = o.root"""


for _noise in (True, False):
    query("c5_dbscan" + ("" if _noise else "_borders"), _dbscan_sql(_noise))(lambda spark, sf_dir, noise=_noise: DBSCAN(_EPS, _MIN, noise).labels(plain(embedded(spark, sf_dir))).select(ID, LABEL))


_SPLITS, _SHARE = 4, 0.015
_SCALED = ", ".join(f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0 ELSE 2 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) - 1 END AS x{i}" for i, c in enumerate(NUMBERS))
_GRID = f"WITH sc AS (SELECT l_orderkey, l_linenumber, {_SCALED} FROM lineitem), tau AS (SELECT floor({_SHARE} * count(*)) AS t FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"floor((x{i} * {_SPLITS}) % {_SPLITS})::INTEGER AS b{i}" for i in range(4)) + " FROM sc)"
_ONE = " UNION ALL ".join(f"SELECT {i} AS dim, b{i} AS bucket, count(*) AS n FROM b GROUP BY b{i}" for i in range(4))
_TWO = " UNION ALL ".join(f"SELECT {i} AS dim1, b{i} AS bucket1, {j} AS dim2, b{j} AS bucket2, count(*) AS n FROM b GROUP BY b{i}, b{j}" for i in range(4) for j in range(i + 1, 4))


def scaled_lines(spark: SparkSession, sf_dir: str) -> MultiFrame:
    df = prep.scale_columns(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMBERS), NUMBERS)
    df = df.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias(ID), F.array(*NUMBERS).alias("x"))
    return MultiFrame.of(df, [Modality("x", 4)])


@query("c6a_dense_units", f"{_GRID} SELECT u.* FROM ({_ONE}) u, tau WHERE n >= t")
def c6a_dense_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scaled_lines(spark, sf_dir)
    return first_grid(f, _SPLITS, int(f.amount * _SHARE))


@query("c6b_two_dimensions", f"{_GRID} SELECT u.dim1, u.bucket1, u.dim2, u.bucket2 FROM ({_TWO}) u, tau WHERE n >= t")
def c6b_two_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = CLIQUE(_SHARE, _SPLITS, 2).units(scaled_lines(spark, sf_dir))
    return spark.createDataFrame([(a[0], a[1], b[0], b[1]) for a, b in units], "dim1 int, bucket1 int, dim2 int, bucket2 int")


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_CLIQUE_SQL = (
    _GRID.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", u AS MATERIALIZED (SELECT u.*, row_number() OVER (ORDER BY dim1, bucket1, dim2, bucket2) AS i FROM ({_TWO}) u, tau WHERE n >= t),
e AS (SELECT x.i, y.i AS j FROM u x JOIN u y ON x.dim1 = y.dim1 AND x.dim2 = y.dim2 AND abs(x.bucket1 - y.bucket1) + abs(x.bucket2 - y.bucket2) = 1),
reach(i, j) AS (SELECT i, i FROM u UNION SELECT r.i, e.j FROM reach r JOIN e ON e.i = r.j),
k AS (SELECT u.*, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS label FROM u JOIN (SELECT j AS i, min(i) AS root FROM reach GROUP BY j) USING (i)),
cell AS (SELECT b0, b1, b2, b3, count(*) AS c FROM b GROUP BY ALL), """
    + f"held AS ({' UNION ALL '.join(f'SELECT b0, b1, b2, b3, label FROM cell JOIN k ON dim1 = {i} AND dim2 = {j} AND bucket1 = b{i} AND bucket2 = b{j}' for i, j in _PAIRS)}) "
    + "SELECT coalesce(label, -1)::INTEGER AS _label, sum(c)::BIGINT AS rows FROM cell LEFT JOIN (SELECT b0, b1, b2, b3, min(label) AS label FROM held GROUP BY ALL) USING (b0, b1, b2, b3) GROUP BY 1"
)


@query("c6_clique", _CLIQUE_SQL)
def c6_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scaled_lines(spark, sf_dir)
    return CLIQUE(_SHARE, _SPLITS, 2).fit_predict(f).df.groupBy(LABEL).agg(F.count("*").alias("rows"))


@query("c8_neighbours", f"WITH {V}, r AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS rank, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id) SELECT id AS _id, neighbour, rank::INTEGER AS rank, round(d, 6) AS d FROM r WHERE rank <= 8")
def c8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    return nearest_neighbours(f.df, f.modalities, 8).select(ID, "neighbour", "rank", r6(F.col("d")).alias("d"))


@query("c9_affinity", f"WITH {V} SELECT a.id AS _id, round(sum(exp(-0.5 * list_distance(a.e, b.e) ** 2)), 6) AS total FROM v a CROSS JOIN v b GROUP BY a.id")
def c9_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = embedded(spark, sf_dir)
    return affinity_sums(f.df.withColumn("x", F.array(F.lit(1.0))), f.modalities, 0.5, "x", 1).select(ID, r6(F.col("y")).alias("total"))


def _fitted(make) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make().fit_predict(plain(_normed(spark, sf_dir))).df.groupBy(LABEL).agg(F.count("*").alias("rows"))

    return run


for _name, _make in {
    "c1_kmeans": lambda: KMeans(10, 10, seed=1),
    "c2_bisecting": lambda: BisectingKMeans(8, 10, min_cluster_size=0.0, seed=1),
    "c3_mean_shift": lambda: MeanShift(0.55, 60, 10, initial=40, seed=1),
    "c4_birch": lambda: Birch(10, 20, 0.3, 5, seed=1),
    "c7_cure": lambda: CURE(10, 5, 0.3),
    "c8_spectral_adjacency": lambda: SpectralAdjacency(10, 8, 10, 20, seed=1),
    "c9_spectral_similarity": lambda: SpectralSimilarity(2.0, 8, 10, 20, seed=1),
}.items():
    query(_name)(_fitted(_make))


@query("u1_text_encoder", f"WITH {_LENGTHS} SELECT doc_id, a AS chars, b AS words FROM x")
def u1_text_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = encode_column(LengthEncoder(), "text")
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.col("e")[0].alias("chars"), F.col("e")[1].alias("words"))


@query("u1_hashing_encoder", "SELECT doc_id, 64 AS dim, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '\\S+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents")
def u1_hashing_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", encode_column(HashingEncoder(64), "text").alias("e"))
    return t.select("doc_id", F.size("e").alias("dim"), F.round(dist.norm2("e", 64), 5).alias("length"))


# Clusterings of rows whose groups SQL knows: five groups of customers, far from each other and of a nation's numbers each.

_GROUPS = 5
_GROUP_SQL = f"SELECT (c_nationkey % {_GROUPS})::INTEGER AS grp, 1::BIGINT AS labels, {_GROUPS}::BIGINT AS clusters, count(*) AS rows FROM customer GROUP BY 1"


def grouped(spark: SparkSession, sf_dir: str) -> MultiFrame:
    """Customers on a plane: the group's place on a circle and a little of the account's balance."""
    g = F.col("c_nationkey") % _GROUPS
    at = lambda f, c: F.lit(10.0) * f(g * (2 * np.pi / _GROUPS)) + c
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ID), g.cast("int").alias(CLASS), F.array(at(F.cos, F.col("c_acctbal") / 10_000), at(F.sin, (F.col("c_custkey") % 97) / 97.0)).alias("p"))
    f = MultiFrame.of(df, [Modality("p", 2)])
    return replace(f, modalities=(replace(f.modalities[0], norm=exact_diameter(df, f.modalities[0])),))


def _found(make) -> Query:
    """Each group's rows, and in how many clusters they are and how many there are in all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = grouped(spark, sf_dir)
        got = make().fit_predict(f.like(f.df.drop(CLASS))).df.select(ID, LABEL).join(f.df.select(ID, CLASS), ID)
        every = got.agg(F.countDistinct(LABEL).alias("clusters"))
        return got.groupBy(F.col(CLASS).alias("grp")).agg(F.countDistinct(LABEL).alias("labels"), F.count("*").alias("rows")).crossJoin(F.broadcast(every))

    return run


for _name, _make in {
    "c1_kmeans": lambda: KMeans(_GROUPS, 20, seed=1),
    "c2_bisecting": lambda: BisectingKMeans(_GROUPS, 20, min_cluster_size=0.0, seed=1),
    "c3_mean_shift": lambda: MeanShift(0.2, 10, 20, initial=30, seed=1),
    "c4_birch": lambda: Birch(_GROUPS, 20, 0.02, 10, seed=1, group_rows=400),
    "c5_dbscan": lambda: DBSCAN(0.1, 5),
    "c7_cure": lambda: CURE(_GROUPS, 6, 0.3, group_rows=400),
    "c7_cure_outliers": lambda: CURE(_GROUPS, 4, 0.3, remove_outliers=True, group_rows=400),
    "c9_spectral_similarity": lambda: SpectralSimilarity(200.0, _GROUPS, _GROUPS, 20, seed=1),
}.items():
    query(f"{_name}_groups", _GROUP_SQL)(_found(_make))


def _eigen(make) -> Query:
    """Of each pair the residual, by a join of the graph's entries with the vector or by sums over all pairs of rows, the vector's length, and its product with the next one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, a = plain(_normed(spark, sf_dir)), make()
        m = f.modalities[0]
        ids, [(w, x)] = a.eigenvectors(f)
        v = spark.createDataFrame(pa.table({ID: ids, "x": pa.array(x.tolist())}))
        if hasattr(a, "entries"):
            other = v.select(F.col(ID).alias("neighbour"), F.posexplode("x").alias("k", "y"))
            product = a.entries(f, m).join(other, "neighbour").groupBy(ID, "k").agg(F.sum(F.col("v") * F.col("y")).alias("ax"))
        else:
            product = affinity_sums(f.df.join(v, ID), [m], a.params["gamma"], "x", x.shape[1]).withColumnRenamed("y", "ax")
        own = v.select(ID, "x", F.posexplode("x").alias("k", "y"))
        values = F.element_at(F.array(*(F.lit(float(e)) for e in w)), F.col("k") + 1)
        r = product.join(own, [ID, "k"]).withColumn("r", F.col("ax") - values * F.col("y"))
        turned = lambda c: F.abs(F.round(c, 6)) + 0.0
        return r.groupBy("k").agg(turned(F.sqrt(F.sum(F.col("r") ** 2))).alias("residual"), r6(F.sum(F.col("y") ** 2)).alias("length"), turned(F.sum(F.col("y") * F.coalesce(F.get("x", F.col("k") + 1), F.lit(0.0)))).alias("next"))

    return run


_EIGEN_SQL = "SELECT k::INTEGER AS k, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, 0.0::DOUBLE AS next FROM range(8) t(k)"
query("c8_eigenvectors", _EIGEN_SQL)(_eigen(lambda: SpectralAdjacency(10, 8, 10, 20, seed=1)))
query("c9_eigenvectors", _EIGEN_SQL)(_eigen(lambda: SpectralSimilarity(2.0, 8, 10, 20, seed=1)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepare ``embeddings``, label by nearest class centroid, and report cluster sizes with the Calinski-Harabasz measure."""
    f = prep.Builder(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ID), F.col("embedding").alias("e"), "label"), class_col="label").vector("e").create()
    from .operators.base import CentreModel

    labels, _, c = Clusters(f.like(f.df.withColumnRenamed(CLASS, LABEL))).centres
    out = CentreModel(c, f.modalities, labels).predict(f)
    ch = Internal.CALINSKI_HARABASZ.evaluate(out)
    return out.df.groupBy(LABEL).agg(F.count("*").alias("rows")).withColumn("calinski_harabasz", F.lit(round(ch, DIGITS)))
