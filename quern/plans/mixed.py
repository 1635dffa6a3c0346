"""Mixed models over the components of vectors.

`reml_*`: every component of the vectors is an element, a vector is an observation, its label the group (64 models at once,
groups of unequal size). `lme_*`: labels of equal parity are an element, a vector the group, its components the observations, with the
component's mean over all vectors as the regressor, so that all groups have the same design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import mixed
from quern.sources.tables import read


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return rows.select("vec_id", "label", "i", F.col("v").cast("double").alias("v"))


def _intercepts(spark: SparkSession, sf_dir: str) -> mixed.Fit:
    return mixed.reml_fit(_components(spark, sf_dir), ["i"], "label", [F.lit(1.0)], F.col("v"))


def reml_fit(spark, sf_dir):
    out = _intercepts(spark, sf_dir).table
    return out.select("i", F.round(F.col("beta")[0], 6).alias("mean"), F.round(F.col("g")[0], 7).alias("between"), F.round("s", 7).alias("within"), F.round("loglik", 4).alias("loglik"), "n")


def reml_ranef(spark, sf_dir):
    return _intercepts(spark, sf_dir).ranef().select("i", "label", F.round(F.col("blup")[0], 6).alias("effect"))


def _slopes(spark: SparkSession, sf_dir: str) -> tuple[mixed.Fit, DataFrame]:
    rows = _components(spark, sf_dir)
    means = rows.groupBy("i").agg(F.avg("v").alias("x"))  # a row a component
    met = rows.join(means, "i").withColumn("x", 100 * F.col("x")).withColumn("half", F.pmod("label", F.lit(2)))
    return mixed.lme_fit(met, ["half"], "vec_id", [F.col("x")], F.col("v"), [F.col("x")]), met


def lme_fit(spark, sf_dir):
    out = _slopes(spark, sf_dir)[0].table
    return out.select("half", F.round(F.col("beta")[0], 6).alias("slope"), F.round(F.col("g")[0], 7).alias("between"), F.round("s", 7).alias("within"), "n")


def lme_t_contrast(spark, sf_dir):
    out = _slopes(spark, sf_dir)[0].t_contrast([1.0])
    return out.select("half", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), F.round("t", 3).alias("t"), F.round("df", 2).alias("df"))


def lme_f_contrast(spark, sf_dir):
    out = _slopes(spark, sf_dir)[0].f_contrast([[1.0]])
    return out.select("half", F.round("f", 2).alias("f"), F.round("df1", 1).alias("df1"), F.round("df2", 1).alias("df2"))


def lme_ranef(spark, sf_dir):
    """Each vector's departure from its half's slope."""
    out = _slopes(spark, sf_dir)[0].ranef()
    return out.select("half", "vec_id", (F.round(F.col("blup")[0], 6) + 0.0).alias("effect"))


def lme_predict(spark, sf_dir):
    fit, rows = _slopes(spark, sf_dir)
    return fit.predict(rows, [F.col("x")], [F.col("x")]).select("vec_id", "i", (F.round("predicted", 3) + 0.0).alias("predicted"))


def lme_intercept_slope(spark, sf_dir):
    """Independent intercept and slope of price on quantity by part, a model for each flag."""
    rows = read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity") / 50)
    x = [F.lit(1.0), F.col("q")]
    fit = mixed.lme_fit(rows, ["l_returnflag"], "l_partkey", x, F.col("l_extendedprice") / 1000, x, diagonal=True)
    f = fit.f_contrast([[1.0, 0.0], [0.0, 1.0]])
    table = fit.table.select("l_returnflag", "beta", "s", "n", "loglik", "converged")
    out = table.join(f, "l_returnflag")
    return out.select("l_returnflag", F.round(F.col("beta")[0], 4).alias("b0"), F.round(F.col("beta")[1], 4).alias("b1"), F.round("s", 4).alias("s"), F.round("loglik", 2).alias("loglik"), F.round("f", 2).alias("f"), "n", "converged")


QUERIES = {
    "reml_fit": reml_fit, "reml_ranef": reml_ranef, "lme_fit": lme_fit, "lme_t_contrast": lme_t_contrast, "lme_f_contrast": lme_f_contrast, "lme_ranef": lme_ranef, "lme_predict": lme_predict, "lme_intercept_slope": lme_intercept_slope,
}


def _profiled(steps: int = 90) -> str:
    """The ratio l of variances of each component where the profiled restricted likelihood has no slope, by bisecting its
    logarithm u: w = n / (1 + n l) weighs the groups' means y, q is the residual."""
    weights = "list_transform(g, lambda p: p.n / (1 + p.n * exp({u})))"
    mean = f"(list_sum(list_transform(g, lambda p: p.n / (1 + p.n * exp({{u}})) * p.y)) / list_sum({weights}))"
    slope = "list_sum({w}) - list_sum(list_transform({w}, lambda a: a * a)) / list_sum({w}) - (n - 1) * list_sum(list_transform(g, lambda p: pow(p.n / (1 + p.n * exp({u})) * (p.y - m), 2))) / (ssw + list_sum(list_transform(g, lambda p: p.n / (1 + p.n * exp({u})) * pow(p.y - m, 2))))"
    parts = [
        "x AS (SELECT label, i, embedding[i + 1]::DOUBLE AS v FROM (SELECT label, embedding, unnest(range(64)) AS i FROM embeddings)), k AS (SELECT i, label, count(*)::DOUBLE AS n, avg(v) AS y, var_pop(v) * count(*) AS ss FROM x GROUP BY 1, 2), b0 AS (SELECT i, list({'n': n, 'y': y, 'label': label}) AS g, sum(ss) AS ssw, sum(n) AS n, -25.0::DOUBLE AS lo, 15.0::DOUBLE AS hi FROM k GROUP BY 1)"
    ]
    for step in range(steps):
        u = "u"
        parts.append(
            f"m{step} AS (SELECT *, {mean.format(u=u)} AS m FROM (SELECT *, (lo + hi) / 2 AS u FROM b{step})), b{step + 1} AS (SELECT i, g, ssw, n, CASE WHEN s < 0 THEN u ELSE lo END AS lo, CASE WHEN s < 0 THEN hi ELSE u END AS hi FROM (SELECT *, {slope.format(w=weights.format(u=u), u=u)} AS s FROM m{step}))"
        )
    last = f"f AS (SELECT *, exp(lo) AS l, {mean.format(u='lo')} AS m FROM b{steps}), r AS (SELECT *, (ssw + list_sum(list_transform(g, lambda p: p.n / (1 + p.n * l) * pow(p.y - m, 2)))) / (n - 1) AS s FROM f)"
    return f"WITH {', '.join(parts)}, {last}"


#: Where the slopes vary less between vectors than their errors let expect, nothing is left between, and all residuals are pooled.
_SLOPES = "WITH x AS (SELECT vec_id, label % 2 AS half, i, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings)), c AS (SELECT i, 100 * avg(v) AS x FROM x GROUP BY 1), xx AS (SELECT sum(x * x) AS sxx FROM c), b AS (SELECT half, vec_id, sum(v * x) / any_value(sxx) AS b, sum(v * v) - pow(sum(v * x), 2) / any_value(sxx) AS rss FROM x JOIN c USING (i), xx GROUP BY 1, 2), f AS (SELECT half, count(*) AS m, avg(b) AS b, var_samp(b) AS vb, sum(rss) / (63 * count(*)) AS w FROM b GROUP BY 1), v AS (SELECT *, CASE WHEN vb > w / sxx THEN w ELSE (63 * m * w + sxx * (m - 1) * vb) / (64 * m - 1) END AS s, greatest(vb - w / sxx, 0) AS g, CASE WHEN vb > w / sxx THEN m - 1 ELSE 64 * m - 1 END AS df FROM f, xx)"

ORACLE_SQL = {
    "reml_fit": f"{_profiled()} SELECT i::INT AS i, round(m, 6) AS mean, round(l * s, 7) AS between, round(s, 7) AS within, round(-0.5 * (n * ln(s) + list_sum(list_transform(g, lambda p: ln(1 + p.n * l))) + ln(list_sum(list_transform(g, lambda p: p.n / (1 + p.n * l))) / s) + (n - 1) * (1 + ln(2 * pi()))), 4) AS loglik, n::BIGINT AS n FROM r",
    "reml_ranef": f"{_profiled()} SELECT i::INT AS i, p.label AS label, round(l * p.n / (1 + p.n * l) * (p.y - m), 6) AS effect FROM (SELECT i, l, m, unnest(g) AS p FROM r)",
    "lme_fit": f"{_SLOPES} SELECT half, round(b, 6) AS slope, round(g, 7) AS between, round(s, 7) AS within, m * 64 AS n FROM v",
    "lme_t_contrast": f"{_SLOPES} SELECT half, round(b, 6) AS effect, round(sqrt((g + s / sxx) / m), 6) AS se, round(b / sqrt((g + s / sxx) / m), 3) AS t, round(df::DOUBLE, 2) AS df FROM v",
    "lme_f_contrast": f"{_SLOPES} SELECT half, round(b * b / ((g + s / sxx) / m), 2) AS f, 1.0::DOUBLE AS df1, round(df::DOUBLE, 1) AS df2 FROM v",
    "lme_ranef": f"{_SLOPES} SELECT half, vec_id, round(v.g / (v.g + s / sxx) * (b.b - v.b), 6) + 0.0::DOUBLE AS effect FROM b JOIN v USING (half)",
    "lme_predict": f"{_SLOPES} SELECT vec_id, c.i::INT AS i, round((v.b + v.g / (v.g + s / sxx) * (b.b - v.b)) * c.x, 3) + 0.0::DOUBLE AS predicted FROM b JOIN v USING (half), c",
}
