"""Model, shrinkage, clustering and transport queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import tails
from quern.functions.arrays import doubles
from quern.operators import augment, models
from quern.sources.tables import read

KEY = ["l_suppkey"]


def _x():
    return [F.lit(1.0), F.col("l_quantity"), F.col("l_discount")]


def _y():
    return F.col("l_extendedprice") / 1000


def _fit(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return models.solved(models.design_sums(read(spark, sf_dir, "lineitem"), KEY, _x()[:n], _y()), KEY, n)


def glm_ols(spark, sf_dir):
    fit = models.with_statistics(_fit(spark, sf_dir, 2), 2)
    cols = [F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 6).alias("b1")]
    return fit.select("l_suppkey", *cols, *(F.round(c, 6).alias(c) for c in ("dispersion", "r2", "adj_r2", "aic", "bic")))


def t_contrast(spark, sf_dir):
    out = models.t_contrast(_fit(spark, sf_dir, 2), [0.0, 1.0])
    return out.select("l_suppkey", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"))


def compare_models(spark, sf_dir):
    out = models.compare(_fit(spark, sf_dir, 2), _fit(spark, sf_dir, 1), KEY)
    return out.select("l_suppkey", F.round("f", 4).alias("f"), "df1", "df2")


def residualise(spark, sf_dir):
    out = models.residualise(read(spark, sf_dir, "lineitem"), KEY, _x()[:2], _y())
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("residual", 6).alias("residual"))


def sandwich(spark, sf_dir):
    out = models.sandwich_hc0(read(spark, sf_dir, "lineitem"), KEY, _x()[:2], _y())
    return out.select("l_suppkey", F.round(F.col("cov")[3], 8).alias("var_slope"))


def glm_multiple(spark, sf_dir):
    fit = _fit(spark, sf_dir, 3)
    return fit.select("l_suppkey", *(F.round(F.col("beta")[i], 5).alias(f"b{i}") for i in range(3)), F.round("rss", 4).alias("rss"), "rank")


def poisson_irls(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("c", F.floor("l_quantity"))
    fit = models.irls(rows, ["l_returnflag"], [F.lit(1.0), F.col("l_discount")], F.col("c"), "poisson")
    return fit.select("l_returnflag", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 6).alias("b1"), "n")


def logistic_irls(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("c", (F.col("l_tax") > 0.04).cast("double"))
    fit = models.irls(rows, ["l_returnflag"], [F.lit(1.0), F.col("l_discount")], F.col("c"), "binomial")
    return fit.select("l_returnflag", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 6).alias("b1"), "n")


def group_grams(spark, sf_dir):
    out = models.group_grams(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_quantity"), F.col("l_discount"))
    return out.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("ztz", "xtz", "xtx")), "n")


def crossed_counts(spark, sf_dir):
    return models.crossed_counts(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def nested_counts(spark, sf_dir):
    out = models.nested_counts(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", F.col("l_quantity"))
    return out.select("l_suppkey", "l_linenumber", "n", F.round("s", 4).alias("s"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))


def shrinkage(spark, sf_dir):
    return models.shrinkage(_vectors(spark, sf_dir), "v").select(*(F.round(c, 6).alias(c) for c in ("ledoit_wolf", "oas", "mu")))


def pca(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    components, _, mean = models.pca(rows, "v", 2)
    return models.projected(rows, "v", components, mean).select("vec_id", F.round(F.col("z")[0], 6).alias("z0"), F.round(F.col("z")[1], 6).alias("z1"))


def whiten(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    mean, cov, _ = models.covariance(rows, "v")
    return models.projected(rows, "v", models.whitening(cov), mean).select("vec_id", "z")


def kmeans(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    start = np.array([r["v"] for r in rows.orderBy("vec_id").limit(4).collect()])  # k given starts
    return models.assigned(rows, "v", models.kmeans(rows, "v", start)).select("vec_id", "cluster")


def nmf(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    width = rows.agg(F.max(F.size("v"))).first()[0]
    rows, _ = models.nmf(rows, "v", np.abs(np.sin(np.arange(2 * width) + 1.0)).reshape(2, width), 5)
    return rows.select("vec_id", F.round(F.col("basis")[0], 6).alias("w0"), F.round(F.col("basis")[1], 6).alias("w1"))


def _transport(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cost, marginals and targets: every part of a size and brand group to the regions."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_size") / 10).alias("x"))
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("j"), F.col("r_regionkey").cast("double").alias("y"))
    cost = parts.select("i", "x", F.explode(F.sequence(F.lit(0), F.lit(regions.count() - 1))).alias("j")).join(F.broadcast(regions), "j")
    n, m = parts.count(), regions.count()
    return cost.select("i", "j", (F.abs(F.col("x") - F.col("y")) / 2).alias("cost")), parts.select("i", F.lit(1.0 / n).alias("a")), regions.select("j", F.lit(1.0 / m).alias("b")), regions


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost, a, b, _ = _transport(spark, sf_dir)
    return models.sinkhorn(spark, cost, a, b, 0.5, 4)


def sinkhorn(spark, sf_dir):
    return _plan(spark, sf_dir).select("i", "j", F.round(F.col("p") * 1000, 7).alias("p"))


QUERIES = {
    "glm_ols": glm_ols, "t_contrast": t_contrast, "compare_models": compare_models, "residualise": residualise, "sandwich_hc0": sandwich, "glm_multiple": glm_multiple,
    "poisson_irls": poisson_irls, "logistic_irls": logistic_irls, "group_grams": group_grams, "crossed_counts": crossed_counts, "nested_counts": nested_counts,
    "shrinkage": shrinkage, "pca": pca, "whiten": whiten, "kmeans": kmeans, "nmf": nmf, "sinkhorn": sinkhorn,
}

_R = "WITH r AS (SELECT l_suppkey, count(*) AS n, regr_slope(l_extendedprice / 1000, l_quantity) AS b1, regr_intercept(l_extendedprice / 1000, l_quantity) AS b0, regr_sxx(l_extendedprice / 1000, l_quantity) AS sxx, regr_syy(l_extendedprice / 1000, l_quantity) AS syy, regr_sxy(l_extendedprice / 1000, l_quantity) AS sxy, avg(l_quantity) AS mx FROM lineitem GROUP BY 1), f AS (SELECT *, syy - sxy * sxy / sxx AS rss FROM r)"

ORACLE_SQL = {
    "glm_ols": f"{_R}, l AS (SELECT *, -0.5 * n * (ln(2 * pi() * rss / n) + 1) AS ll, 1 - rss / syy AS r FROM f) SELECT l_suppkey, round(b0, 6) AS b0, round(b1, 6) AS b1, round(rss / (n - 2), 6) AS dispersion, round(r, 6) AS r2, round(1 - (1 - r) * (n - 1) / (n - 2), 6) AS adj_r2, round(-2 * ll + 6, 6) AS aic, round(-2 * ll + 3 * ln(n), 6) AS bic FROM l",
    "t_contrast": f"{_R} SELECT l_suppkey, round(b1, 6) AS effect, round(sqrt(rss / (n - 2) / sxx), 6) AS se, round(b1 / sqrt(rss / (n - 2) / sxx), 5) AS t FROM f",
    "compare_models": f"{_R} SELECT l_suppkey, round((syy - rss) / (rss / (n - 2)), 4) AS f, 1::BIGINT AS df1, n - 2 AS df2 FROM f",
    "residualise": f"{_R} SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 1000 - b0 - b1 * l_quantity, 6) AS residual FROM lineitem JOIN f USING (l_suppkey)",
    "sandwich_hc0": f"{_R} SELECT l_suppkey, round(sum(pow(l_quantity - mx, 2) * pow(l_extendedprice / 1000 - b0 - b1 * l_quantity, 2)) / pow(any_value(sxx), 2), 8) AS var_slope FROM lineitem JOIN f USING (l_suppkey) GROUP BY 1",
    "group_grams": "SELECT l_suppkey, round(sum(l_discount * l_discount), 6) AS ztz, round(sum(l_quantity * l_discount), 6) AS xtz, round(sum(l_quantity * l_quantity), 6) AS xtx, count(*) AS n FROM lineitem GROUP BY 1",
    "crossed_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))",
    "nested_counts": "SELECT l_suppkey, l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS s FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_linenumber), (l_suppkey))",
}


def t_test(spark, sf_dir):
    """Slope of price on discount beside quantity by supplier, its t and two-sided p-value."""
    out = models.t_contrast(_fit(spark, sf_dir, 3), [0.0, 0.0, 1.0])
    p = tails.t_pvalue(F.col("t"), (F.col("n") - F.col("rank")).cast("double"))
    return out.select("l_suppkey", F.round("t", 5).alias("t"), F.round(p, 7).alias("p"))


def confidence_interval(spark, sf_dir):
    out = models.t_contrast(_fit(spark, sf_dir, 3), [0.0, 0.0, 1.0])
    half = tails.t_quantiles(F.lit(0.975), (F.col("n") - F.col("rank")).cast("double")) * F.col("se")
    return out.select("l_suppkey", F.round(F.col("effect") - half, 5).alias("low"), F.round(F.col("effect") + half, 5).alias("high"))


def gamma_contrast(spark, sf_dir):
    out = augment.gamma_contrast(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 0.7, ["event_type"])
    return out.select("event_id", F.round("contrast", 6).alias("contrast"))


def wasserstein(spark, sf_dir):
    """Transport cost of the plan of `sinkhorn`."""
    plan, cost = _plan(spark, sf_dir), _transport(spark, sf_dir)[0]
    return plan.join(cost, ["i", "j"]).agg(F.round(F.sum(F.col("p") * F.col("cost")), 6).alias("cost"))


def barycentric(spark, sf_dir):
    """Where the plan takes each part: the mean of its targets."""
    _, a, _, regions = _transport(spark, sf_dir)
    out = models.barycentric_map(_plan(spark, sf_dir), a, regions)
    return out.select("i", F.round("y", 6).alias("y"))


def _family(family: str, y: str, link: str | None = None):
    def query(spark, sf_dir):
        fit = models.irls(read(spark, sf_dir, "lineitem"), ["l_returnflag"], [F.lit(1.0), F.col("l_discount")], F.expr(y), family, link=link)
        return fit.select("l_returnflag", F.round(F.col("beta")[0], 5).alias("b0"), F.round(F.col("beta")[1], 5).alias("b1"), "n")

    return query


QUERIES |= {
    "t_test": t_test, "confidence_interval": confidence_interval, "gamma_contrast": gamma_contrast, "wasserstein": wasserstein, "barycentric_map": barycentric, "glm_gamma": _family("gamma", "l_extendedprice / 1000"),
    "glm_negative_binomial": _family("negative_binomial", "floor(l_quantity)"), "glm_tweedie": _family("tweedie", "l_quantity"), "glm_sqrt_link": _family("poisson", "floor(l_quantity)", "sqrt"),
    "glm_cloglog": _family("binomial", "double(l_tax > 0.04)", "cloglog"),
}


def _irls_sql(y: str, begin: str, mean: str, slope: str, variance: str, rounds: int, digits: int = 5) -> str:
    """Rounds of weighted least squares by flag, with an intercept and the discount; e is the linear predictor, m the mean."""
    solve = "(sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b, (sy * sxx - sx * sxy) / (sw * sxx - sx * sx) AS a"
    parts = [f"x AS (SELECT l_returnflag AS k, l_discount AS x, ({y})::DOUBLE AS y FROM lineitem), f0 AS (SELECT k, regr_slope(z, x) AS b, regr_intercept(z, x) AS a FROM (SELECT k, x, {begin} AS z FROM x) GROUP BY 1)"]
    for n in range(rounds):
        parts.append(f"e{n} AS (SELECT x.k, x, y, least(greatest(a + b * x, -30), 30) AS e FROM x JOIN f{n} USING (k)), m{n} AS (SELECT *, {mean} AS m, {slope} AS d FROM e{n}), w{n} AS (SELECT k, x, e + (y - m) / d AS z, d * d / greatest({variance}, 1e-10) AS w FROM m{n}), s{n} AS (SELECT k, sum(w) AS sw, sum(w * x) AS sx, sum(w * z) AS sy, sum(w * x * x) AS sxx, sum(w * x * z) AS sxy FROM w{n} GROUP BY 1), f{n + 1} AS (SELECT k, {solve} FROM s{n})")
    return "WITH " + ", ".join(parts) + f" SELECT k AS l_returnflag, round(a, {digits}) AS b0, round(b, {digits}) AS b1, (SELECT count(*) FROM x WHERE x.k = f{rounds}.k) AS n FROM f{rounds}"


_LOG = ("exp(e)", "exp(e)")
_COSTS = "p AS (SELECT p_partkey AS i, p_size / 10.0::DOUBLE AS x FROM part), c AS (SELECT i, r_regionkey AS j, abs(x - r_regionkey) / 2 AS c FROM p, region), n AS (SELECT ln(1.0::DOUBLE / count(*)) AS la FROM p), m AS (SELECT ln(1.0::DOUBLE / count(*)) AS lb FROM region), g0 AS (SELECT r_regionkey AS j, 0.0::DOUBLE AS g FROM region)"


def _sinkhorn_sql(rounds: int) -> str:
    parts = [_COSTS]
    for n in range(rounds):
        parts.append(f"f{n + 1} AS (SELECT i, 0.5 * (any_value(la) - ln(sum(exp((g - c) / 0.5)))) AS f FROM c JOIN g{n} USING (j), n GROUP BY 1), g{n + 1} AS (SELECT j, 0.5 * (any_value(lb) - ln(sum(exp((f - c) / 0.5)))) AS g FROM c JOIN f{n + 1} USING (i), m GROUP BY 1)")
    return "WITH " + ", ".join(parts) + f", t AS (SELECT i, j, c, exp((f + g - c) / 0.5) AS p FROM c JOIN f{rounds} USING (i) JOIN g{rounds} USING (j))"


def _kmeans_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds from the first k vectors."""
    parts = ["e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM e ORDER BY vec_id LIMIT {k})"]
    near = "SELECT vec_id, arg_min(c, (round(d, 9), c)) AS c FROM (SELECT e.vec_id, z.c, list_sum(list_transform(list_zip(e.v, z.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM e, {t} z) GROUP BY 1"
    for n in range(rounds):
        parts.append(f"a{n} AS ({near.format(t=f'c{n}')})")
        means = f"SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, avg(v[i]) AS x FROM (SELECT a{n}.c, e.v, unnest(range(1, 65)) AS i FROM a{n} JOIN e USING (vec_id)) GROUP BY 1, 2) GROUP BY 1"
        parts.append(f"c{n + 1} AS ({means})")
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, c::INT AS cluster FROM ({near.format(t=f'c{rounds}')})"


_MULTI = "WITH m AS (SELECT l_suppkey, count(*) AS n, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM (SELECT l_suppkey, l_quantity AS a, l_discount AS b, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1), b AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS b1, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS b2 FROM m)"

_SLOPE = f"{_MULTI}, t AS (SELECT l_suppkey, b2, n - 3.0::DOUBLE AS nu, sqrt((syy - b1 * say - b2 * sby) / (n - 3) * saa / (saa * sbb - sab * sab)) AS se, b2 / sqrt((syy - b1 * say - b2 * sby) / (n - 3) * saa / (saa * sbb - sab * sab)) AS t FROM b)"
_SHRINK = "WITH u AS (SELECT vec_id, i, v[i + 1] AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(64)) AS i FROM embeddings)), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM u), n AS (SELECT count(DISTINCT vec_id)::DOUBLE AS n FROM c), s AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / any_value(n) AS s FROM c a JOIN c b USING (vec_id), n GROUP BY 1, 2), m AS (SELECT sum(s * s) AS q, sum(CASE WHEN i = j THEN s ELSE 0 END) / 64 AS mu FROM s), f AS (SELECT sum(r * r) AS f FROM (SELECT sum(x * x) AS r FROM c GROUP BY vec_id)), d AS (SELECT *, q - 64 * mu * mu AS delta FROM m, f, n) SELECT round(least((f / n - q) / n, delta) / delta, 6) AS ledoit_wolf, round(least((q / 4096 + mu * mu) / ((n + 1) * (q / 4096 - mu * mu / 64)), 1), 6) AS oas, round(mu, 6) AS mu FROM d"


def _nmf_sql(rounds: int) -> str:
    parts = ["x AS (SELECT vec_id, d, greatest(v[d + 1], 0) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(64)) AS d FROM embeddings)), h0 AS (SELECT r, d, abs(sin(r * 64 + d + 1.0::DOUBLE)) AS h FROM range(2) a(r), range(64) b(d)), w0 AS (SELECT DISTINCT vec_id, r, 1.0::DOUBLE AS w FROM x, range(2) a(r))"]
    for n in range(rounds):
        parts.append(
            f"g{n} AS (SELECT a.r, b.r AS s, sum(a.h * b.h) AS g FROM h{n} a JOIN h{n} b USING (d) GROUP BY 1, 2), n{n} AS (SELECT vec_id, r, sum(x * h) AS num FROM x JOIN h{n} USING (d) GROUP BY 1, 2), d{n} AS (SELECT vec_id, g.r, sum(w * g) AS den FROM w{n} w JOIN g{n} g ON g.s = w.r GROUP BY 1, 2), "
            f"w{n + 1} AS (SELECT w.vec_id, w.r, w * num / (den + 1e-10) AS w FROM w{n} w JOIN n{n} USING (vec_id, r) JOIN d{n} USING (vec_id, r)), "
            f"p{n} AS (SELECT r, d, sum(w * x) AS wx FROM w{n + 1} JOIN x USING (vec_id) GROUP BY 1, 2), q{n} AS (SELECT a.r, b.r AS s, sum(a.w * b.w) AS ww FROM w{n + 1} a JOIN w{n + 1} b USING (vec_id) GROUP BY 1, 2), k{n} AS (SELECT q.r, h.d, sum(ww * h) AS whh FROM q{n} q JOIN h{n} h ON h.r = q.s GROUP BY 1, 2), "
            f"h{n + 1} AS (SELECT h.r, h.d, h * wx / (whh + 1e-10) AS h FROM h{n} h JOIN p{n} USING (r, d) JOIN k{n} USING (r, d))"
        )
    return "WITH " + ", ".join(parts) + f" SELECT vec_id, round(max(CASE WHEN r = 0 THEN w END), 6) AS w0, round(max(CASE WHEN r = 1 THEN w END), 6) AS w1 FROM w{rounds} GROUP BY 1"


ORACLE_SQL |= {
    "glm_multiple": f"{_MULTI} SELECT l_suppkey, round(my - b1 * ma - b2 * mb, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(syy - b1 * say - b2 * sby, 4) AS rss, 3::INT AS rank FROM b",
    "poisson_irls": _irls_sql("floor(l_quantity)", "ln(y + 0.5)", *_LOG, "m", 6, 6), "logistic_irls": _irls_sql("CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END", "ln((y + 0.5) / 2 / (1 - (y + 0.5) / 2))", "1 / (1 + exp(-e))", "exp(-e) / pow(1 + exp(-e), 2)", "m * (1 - m)", 6, 6),
    "glm_gamma": _irls_sql("l_extendedprice / 1000", "ln(greatest(y, 1e-6))", *_LOG, "m * m", 12), "glm_negative_binomial": _irls_sql("floor(l_quantity)", "ln(y + 0.5)", *_LOG, "m + m * m", 12),
    "glm_tweedie": _irls_sql("l_quantity", "ln(y + 0.5)", *_LOG, "pow(m, 1.5)", 12), "glm_sqrt_link": _irls_sql("floor(l_quantity)", "sqrt(y + 0.5)", "e * e", "2 * e", "m", 8),
    "glm_cloglog": _irls_sql("CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END", "ln(-ln(1 - (y + 0.5) / 2))", "1 - exp(-exp(e))", "exp(e - exp(e))", "m * (1 - m)", 8),
    "sinkhorn": f"{_sinkhorn_sql(4)} SELECT i, j, round(p * 1000, 7) AS p FROM t", "wasserstein": f"{_sinkhorn_sql(4)} SELECT round(sum(p * c), 6) AS cost FROM t",
    "barycentric_map": f"{_sinkhorn_sql(4)} SELECT i, round(sum(p * j) * (SELECT count(*) FROM p), 6) AS y FROM t GROUP BY 1",
    "kmeans": _kmeans_sql(4, 20),
    "t_test": f"{_SLOPE}, p AS (SELECT l_suppkey, t, nu, (pi() / 2 - atan(abs(t) / sqrt(nu))) / 4000 AS h FROM t), i AS (SELECT l_suppkey, t, h / 3 * sum((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(sin(k * h), nu - 1)) AS s, any_value(nu) AS nu FROM p, range(4001) r(k) GROUP BY l_suppkey, t, h) SELECT l_suppkey, round(t, 5) AS t, round(least(1.0, 2 * s * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(pi())), 7) AS p FROM i",
    "confidence_interval": f"{_SLOPE}, q AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM t), c AS (SELECT *, z + (pow(z, 3) + z) / (4 * nu) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * nu * nu) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(nu, 3)) + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(nu, 4)) AS q FROM q) SELECT l_suppkey, round(b2 - q * se, 5) AS low, round(b2 + q * se, 5) AS high FROM c",
    "shrinkage": _SHRINK, "nmf": _nmf_sql(5),
}
ORACLE_SQL |= {
    "gamma_contrast": "SELECT event_id, round(pow(least(greatest((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-12), 0), 1), 0.7) * greatest(max(value) OVER w - min(value) OVER w, 1e-12) + min(value) OVER w, 6) AS contrast FROM events WINDOW w AS (PARTITION BY event_type)",
}
