"""Descriptive statistics, normalisation, kernels and row-vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays
from quern.operators import kernels, normalize
from quern.sources.tables import read


def corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation by group; a constant column gives 0."""
    r = F.coalesce(F.nanvl(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)), F.lit(0.0))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(r, 8).alias("r"))


def cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    cells = [F.round(F.covar_samp(a, b), 4).alias(f"c_{a[2:5]}_{b[2:5]}") for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_extendedprice"), ("l_discount", "l_discount"))]
    return rows.groupBy("l_returnflag").agg(*cells)


def weighted_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of price and discount weighted by quantity: denominator sum w - sum w^2 / sum w."""
    x, y, w = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity")
    s = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * y).alias("wxy"))
    value = (F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")) / (F.col("w") - F.col("ww") / F.col("w"))
    return s.select("l_returnflag", F.round(value, 4).alias("wcov"))


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def _normal(op, column: str, keys: tuple[str, ...] = ("l_partkey",), value: str = "l_quantity", **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(_line(spark, sf_dir), list(keys), value, **options)
        return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(column, 6).alias(column))

    return query


def _event(op, column: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", **options)
        return out.select("event_id", F.round(column, 6).alias(column))

    return query


def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.mad(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").withColumn("mad", F.round("mad", 4))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("v"))


def _lp(p: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.lp_normalize(F.col("v"), p)).alias("i", "x"))
        return rows.select("vec_id", "i", F.round("x", 7).alias("x"))

    return query


def _kernel(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _vectors(spark, sf_dir)
        asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec"))
        out = kernels.kernel(asked, rows.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), kind)
        return out.select("q_id", "id", F.round("value", 6).alias("value"))

    return query


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec"))
    out = kernels.nearest(asked, rows.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), 10)
    return out.select("q_id", "id", F.col("rank").cast("long").alias("rank"), F.round("value", 6).alias("value"))


def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return pairs.select("vec_id", F.round(arrays.eta_squared(F.col("v"), F.col("u")), 8).alias("eta"))


def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows whose label is among the places of the 3 largest entries."""
    rows = _vectors(spark, sf_dir).withColumn("c", F.pmod(F.col("label"), F.lit(64)))
    hit = F.array_contains(arrays.top_k(F.col("v"), 3), F.col("c"))
    return rows.agg(F.round(F.avg(hit.cast("double")), 8).alias("accuracy"), F.count("*").alias("n"))


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("c", F.pmod(F.col("label"), F.lit(64)))
    loss = -F.get(arrays.log_softmax(F.col("v")), F.col("c"))
    return rows.select("vec_id", F.round(loss, 7).alias("loss"))


def kl_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = arrays.kl_diagonal_gaussian(F.slice("v", 1, 32), F.slice("v", 33, 32))
    return _vectors(spark, sf_dir).select("vec_id", F.round(value, 6).alias("kl"))


def mean_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector by label."""
    rows = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg("x"), 7).alias("mean"))


QUERIES = {
    "corr": corr, "cov": cov, "weighted_cov": weighted_cov, "mad": mad, "l2_normalize": _lp(2.0), "lp_normalize": _lp(3.0),
    "demean": _normal(normalize.demean, "demeaned"), "zscore": _normal(normalize.zscore, "z"), "psc": _normal(normalize.psc, "psc"),
    "instance_norm": _normal(normalize.instance_norm, "normed"), "robust_z": _normal(normalize.robust_zscore, "robust_z"),
    "winsorize": _event(normalize.winsorize, "clipped", lower=0.05, upper=0.95), "intensity_normalize": _event(normalize.intensity_normalize, "scaled"),
    "percentile_rescale": _event(normalize.percentile_rescale, "rescaled"), "knn": knn, "eta_squared": eta_squared, "topk_accuracy": topk_accuracy,
    "cross_entropy": cross_entropy, "kl_gaussian": kl_gaussian, "mean_euclidean": mean_euclidean,
    **{f"kernel_{kind}": _kernel(kind) for kind in kernels.KERNELS if kind != "geodesic"},
}

_N = "SELECT l_orderkey, l_linenumber, l_partkey, round({}, 6) AS {} FROM lineitem"
_G = "OVER (PARTITION BY l_partkey)"
_PAIRS = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT q.vec_id AS q_id, r.vec_id AS id, round({}, 6) AS value FROM e q, e r WHERE q.vec_id % 100 = 0"
_D2 = "list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"
_EV = "WITH p AS (SELECT event_type AS t, quantile_cont(value, {lo}) AS lo, quantile_cont(value, {hi}) AS hi FROM events GROUP BY 1) SELECT event_id, round({e}, 6) AS {n} FROM events JOIN p ON t = event_type"
_LP = "SELECT vec_id, i::INT AS i, round(v[i + 1] / greatest({}, 1e-12), 7) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(64)) AS i FROM embeddings)"

ORACLE_SQL = {
    "corr": "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 8) AS r FROM lineitem GROUP BY 1",
    "cov": "SELECT l_returnflag, round(covar_samp(l_quantity, l_quantity), 4) AS c_qua_qua, round(covar_samp(l_quantity, l_discount), 4) AS c_qua_dis, round(covar_samp(l_quantity, l_extendedprice), 4) AS c_qua_ext, round(covar_samp(l_discount, l_discount), 4) AS c_dis_dis FROM lineitem GROUP BY 1",
    "weighted_cov": "SELECT l_returnflag, round((sum(l_quantity * l_extendedprice * l_discount) - sum(l_quantity * l_extendedprice) * sum(l_quantity * l_discount) / sum(l_quantity)) / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity)), 4) AS wcov FROM lineitem GROUP BY 1",
    "mad": "WITH m AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1) SELECT o_orderpriority, round(1.4826 * quantile_cont(abs(o_totalprice - m), 0.5), 4) AS mad FROM orders JOIN m ON p = o_orderpriority GROUP BY 1",
    "demean": _N.format(f"l_quantity - avg(l_quantity) {_G}", "demeaned"),
    "zscore": _N.format(f"(l_quantity - avg(l_quantity) {_G}) / (stddev_pop(l_quantity) {_G} + 1e-12)", "z"),
    "psc": _N.format(f"100 * (l_quantity - avg(l_quantity) {_G}) / (avg(l_quantity) {_G} + 1e-12)", "psc"),
    "instance_norm": _N.format(f"(l_quantity - avg(l_quantity) {_G}) / sqrt(var_pop(l_quantity) {_G} + 1e-5)", "normed"),
    "robust_z": "WITH m AS (SELECT l_partkey AS p, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, m, abs(l_quantity - m) AS d FROM lineitem JOIN m ON p = l_partkey), s AS (SELECT l_partkey AS p, quantile_cont(d, 0.5) AS s FROM d GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / (1.4826 * s + 1e-12), 6) AS robust_z FROM d JOIN s ON p = l_partkey",
    "winsorize": _EV.format(lo=0.05, hi=0.95, e="least(greatest(value, lo), hi)", n="clipped"),
    "intensity_normalize": _EV.format(lo=0.01, hi=0.99, e="(least(greatest(value, lo), hi) - lo) / (hi - lo + 1e-12)", n="scaled"),
    "percentile_rescale": _EV.format(lo=0.0, hi=0.99, e="least(greatest((value - lo) / (hi + 1e-12), 0.0), 1.0)", n="rescaled"),
    "l2_normalize": _LP.format("sqrt(list_sum(list_transform(v, lambda z: z * z)))"),
    "lp_normalize": _LP.format("pow(list_sum(list_transform(v, lambda z: pow(abs(z), 3))), 1.0 / 3)"),
    "kernel_linear": _PAIRS.format(_DOT), "kernel_distance": _PAIRS.format(_D2), "kernel_rbf": _PAIRS.format(f"exp(-{_D2} / 64)"),
    "kernel_polynomial": _PAIRS.format(f"pow({_DOT} / 64, 3)"), "kernel_sigmoid": _PAIRS.format(f"tanh({_DOT} / 64)"),
    "kernel_cosine": _PAIRS.format(f"{_DOT} / (greatest({_NORM.format('q.v')}, 1e-12) * greatest({_NORM.format('r.v')}, 1e-12))"),
    "knn": f"SELECT q_id, id, rank, value FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, id) - 1 AS rank FROM (WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT q.vec_id AS q_id, r.vec_id AS id, {_D2} AS d, round({_D2}, 6) AS value FROM e q, e r WHERE q.vec_id % 100 = 0)) WHERE rank < 10",
    "eta_squared": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS x, b.v AS y, (list_sum(a.v) + list_sum(b.v)) / 128 AS g FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(1 - list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / 2)) / list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - g) * (z[1] - g) + (z[2] - g) * (z[2] - g))), 8) AS eta FROM p",
    "topk_accuracy": "WITH e AS (SELECT vec_id, (label % 64 + 64) % 64 AS c, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, c, i, row_number() OVER (PARTITION BY vec_id ORDER BY v[i + 1] DESC, i) AS r FROM (SELECT *, unnest(range(64)) AS i FROM e)) SELECT round(sum(CASE WHEN i = c AND r <= 3 THEN 1 ELSE 0 END)::DOUBLE / count(DISTINCT vec_id), 8) AS accuracy, count(DISTINCT vec_id) AS n FROM u",
    "cross_entropy": "WITH e AS (SELECT vec_id, (label % 64 + 64) % 64 AS c, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(ln(list_sum(list_transform(v, lambda z: exp(z)))) - v[c + 1], 7) AS loss FROM e",
    "kl_gaussian": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(0.5 * list_sum(list_transform(list_zip(v[1:32], v[33:64]), lambda z: z[1] * z[1] + exp(z[2]) - 1 - z[2])), 6) AS kl FROM e",
    "mean_euclidean": "SELECT label, i::INT AS i, round(avg(v[i + 1]), 7) AS mean FROM (SELECT label, embedding::DOUBLE[] AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2",
}
