"""Covariance, small-matrix, contrast and robust-fit queries over line items by flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry as g
from quern.functions.arrays import doubles
from quern.operators import covariance, inference, models
from quern.sources.tables import read

KEYS = ["l_returnflag"]
#: Rounds of weights of the robust fits, as many as the operator's default.
ROUNDS = 20
MEASURES = {"a": "l_quantity", "b": "l_discount * 100", "c": "l_tax * 100", "y": "l_extendedprice / 1000", "z": "double(l_linenumber)"}


def _m(names: str) -> dict:
    return {n: F.expr(MEASURES[n]) for n in names}



def _v(name: str):
    return F.expr(MEASURES[name])


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def _long(op, *names, digits: int = 7):
    return lambda spark, sf_dir: op(_line(spark, sf_dir), KEYS, *map(_m, names)).select(*KEYS, "i", "j", (F.round("value", digits) + 0.0).alias("value"))


def ebic(spark, sf_dir):
    return covariance.extended_bic(_line(spark, sf_dir), KEYS, _m("abc")).select(*KEYS, F.round("ebic", 3).alias("ebic"))


def _small(values, digits: int = 7):
    """Columns of the covariance of three variables and its Cholesky factor by flag."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, m, lower = covariance.cholesky_cells(_line(spark, sf_dir), KEYS, _m("abc"))
        return table.select(*KEYS, *((F.round(v, digits) + 0.0).alias(n) for n, v in values(m, lower).items()))

    return query


def _lower(m, lower):
    return {f"l{i}{j}": lower[i][j] for i in range(3) for j in range(i + 1)}


def _solution(m, lower):
    return dict(zip("xyz", g.cholesky_solve(lower, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])))


def _solved_directly(m, lower):
    return {n: row[0] for n, row in zip("xyz", g.product(g.inverse(m), [[F.lit(1.0)], [F.lit(2.0)], [F.lit(3.0)]]))}


def _log_det(m, lower):
    return {"by_det": F.log(g.det(m)), "by_cholesky": 2 * sum((F.log(lower[i][i]) for i in range(3)), F.lit(0.0))}


def _eigen2(m, lower):
    """Eigenvalues of the leading 2 x 2 part."""
    middle, gap = (m[0][0] + m[1][1]) / 2, F.sqrt(F.pow((m[0][0] - m[1][1]) / 2, F.lit(2.0)) + m[0][1] * m[1][0])
    return {"w0": middle - gap, "w1": middle + gap}


def _fit(spark, sf_dir, n: int = 3):
    return models.solved(models.design_sums(_line(spark, sf_dir), ["l_suppkey"], [F.lit(1.0), _v("a"), _v("b")][:n], _v("y")), ["l_suppkey"], n)


def f_contrast(spark, sf_dir):
    out = models.f_contrast(_fit(spark, sf_dir), [[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    return out.select("l_suppkey", F.round("f", 4).alias("f"), "df1", "df2")


def predict(spark, sf_dir):
    rows = _line(spark, sf_dir)
    out = models.predicted(rows, _fit(spark, sf_dir), ["l_suppkey"], [F.lit(1.0), _v("a"), _v("b")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("predicted", 5).alias("predicted"))


def deviance_explained(spark, sf_dir):
    return _fit(spark, sf_dir).select("l_suppkey", F.round(1 - F.col("rss") / F.col("tss"), 7).alias("explained"))


def standardized_effect(spark, sf_dir):
    fit = models.with_statistics(_fit(spark, sf_dir), 3)
    return models.t_contrast(fit, [0.0, 1.0, 0.0]).select("l_suppkey", F.round(F.try_divide(F.col("effect"), F.sqrt("dispersion")), 7).alias("d"))


def _robust(kind: str, rounds: int):
    def query(spark, sf_dir):
        fit = models.robust_fit(_line(spark, sf_dir), KEYS, [F.lit(1.0), _v("a")], _v("y") + _v("z") * _v("z"), kind, rounds)
        return fit.select(*KEYS, *(F.round(F.col("beta")[i], 6).alias(f"b{i}") for i in range(2)), F.round("scale", 6).alias("scale"))

    return query


def sandwich_cluster(spark, sf_dir):
    out = models.sandwich_cluster(_line(spark, sf_dir), KEYS, [F.lit(1.0), _v("a")], _v("y"), "l_suppkey")
    return out.select(*KEYS, *(F.round(F.col("cov")[i] * 1e6, 5).alias(f"c{i}") for i in (0, 1, 3)))


def sandwich_hc1(spark, sf_dir):
    out = models.sandwich_hc1(_line(spark, sf_dir), ["l_suppkey"], [F.lit(1.0), _v("a")], _v("y"))
    return out.select("l_suppkey", F.round(F.col("cov")[3], 8).alias("var_slope"))


def fdr_dispatch(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.pow((k * 7919 % 10007) / F.lit(10007.0), F.lit(4.0)).alias("p"))
    out = None
    for method in ("bh", "by", "storey", "bonferroni"):
        part = inference.fdr(rows, "p", method).select("s_suppkey", F.lit(method).alias("method"), F.round("q", 8).alias("q"))
        out = part if out is None else out.union(part)
    return out


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))


def pca_inverse(spark, sf_dir):
    """What two components keep of each vector: share of its squared length about the mean."""
    rows = _vectors(spark, sf_dir)
    components, _, mean = models.pca(rows, "v", 2)
    held = models.projected(rows, "v", components, mean)
    back = models.restored(held, "z", components.T, mean)
    return back.select("vec_id", F.size("restored").alias("n"), F.round(F.get("restored", F.lit(0)), 6).alias("first"))


def whiten_inverse(spark, sf_dir):
    """Vectors after whitening and its inverse, entry by entry as they were."""
    rows = _vectors(spark, sf_dir)
    mean, cov, _ = models.covariance(rows, "v")
    held = models.projected(rows, "v", models.whitening(cov), mean)
    back = models.restored(held, "z", models.whitening(cov, -1.0), mean)
    return back.select("vec_id", F.posexplode("restored").alias("i", "x")).select("vec_id", "i", (F.round("x", 4) + 0.0).alias("x"))


QUERIES = {
    "paired_cov": _long(covariance.paired_covariance, "ab", "yz"), "paired_corr": _long(covariance.paired_correlation, "ab", "yz"),
    "precision": _long(covariance.precision, "abc"), "partial_cov": _long(covariance.partial_covariance, "abc"), "partial_corr": _long(covariance.partial_correlation, "abc"),
    "conditional_cov": _long(covariance.conditional_covariance, "ab", "z"), "conditional_corr": _long(covariance.conditional_correlation, "ab", "z"),
    "ebic_score": ebic, "small_cholesky": _small(_lower), "cholesky_solve": _small(_solution), "small_solve": _small(_solved_directly),
    "small_det": _small(lambda m, lower: {"d": g.det(m)}, 4), "small_inverse_log_det": _small(_log_det), "symmetric_eigen": _small(_eigen2),
    "f_contrast": f_contrast, "predict": predict, "deviance_explained": deviance_explained, "standardized_effect": standardized_effect,
    "huber_regress": _robust("huber", ROUNDS), "tukey_regress": _robust("tukey", ROUNDS), "sandwich_cluster": sandwich_cluster, "sandwich_hc1": sandwich_hc1,
    "fdr_methods": fdr_dispatch, "pca_inverse": pca_inverse, "whiten_inverse": whiten_inverse,
}

_L = "l AS (SELECT *, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_extendedprice / 1000 AS y, l_linenumber::DOUBLE AS z FROM lineitem)"


def _pairs(x: str, y: str, fn: str) -> str:
    return " UNION ALL ".join(f"SELECT l_returnflag, '{i}' AS i, '{j}' AS j, (round({fn.format(i=i, j=j)}, 7) + 0.0::DOUBLE) AS value FROM l GROUP BY 1" for i in x for j in y)


_S = f"WITH {_L}, s AS (SELECT l_returnflag, " + ", ".join(f"covar_samp({i}, {j}) AS {i}{j}" for i in "abc" for j in "abc") + ", count(*) AS n FROM l GROUP BY 1), d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM s), p AS (SELECT *, (bb * cc - bc * bc) / d AS paa, (aa * cc - ac * ac) / d AS pbb, (aa * bb - ab * ab) / d AS pcc, (ac * bc - ab * cc) / d AS pab, (ab * bc - ac * bb) / d AS pac, (ac * ab - aa * bc) / d AS pbc FROM d)"
_P = {"aa": "paa", "bb": "pbb", "cc": "pcc", "ab": "pab", "ba": "pab", "ac": "pac", "ca": "pac", "bc": "pbc", "cb": "pbc"}


def _matrix(cell) -> str:
    return f"{_S} " + " UNION ALL ".join(f"SELECT l_returnflag, '{i}' AS i, '{j}' AS j, (round({cell(i, j)}, 7) + 0.0::DOUBLE) AS value FROM p" for i in "abc" for j in "abc")


_COND = f"WITH {_L}, s AS (SELECT l_returnflag, sum(z * a) / sum(z * z) AS ea, sum(z * b) / sum(z * z) AS eb FROM l GROUP BY 1), r AS (SELECT l.l_returnflag, l.a - ea * z AS a, l.b - eb * z AS b FROM l JOIN s USING (l_returnflag))"
_COND_CELLS = lambda fn: " UNION ALL ".join(f"SELECT l_returnflag, '{i}' AS i, '{j}' AS j, (round({fn}({i}, {j}), 7) + 0.0::DOUBLE) AS value FROM r GROUP BY 1" for i in "ab" for j in "ab")
_CHOL = f"{_S}, h AS (SELECT *, sqrt(aa) AS l00, ab / sqrt(aa) AS l10, ac / sqrt(aa) AS l20 FROM p), i AS (SELECT *, sqrt(bb - l10 * l10) AS l11, (bc - l20 * l10) / sqrt(bb - l10 * l10) AS l21 FROM h), k AS (SELECT *, sqrt(cc - l20 * l20 - l21 * l21) AS l22 FROM i)"
_SOLVE = f"{_S} SELECT l_returnflag, round(paa + 2 * pab + 3 * pac, 7) AS x, round(pab + 2 * pbb + 3 * pbc, 7) AS y, round(pac + 2 * pbc + 3 * pcc, 7) AS z FROM p"
_FIT = f"WITH {_L}, m AS (SELECT l_suppkey AS k, count(*) AS n, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM l GROUP BY 1), b AS (SELECT *, saa * sbb - sab * sab AS d, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS b1, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS b2 FROM m), f AS (SELECT *, my - b1 * ma - b2 * mb AS b0, syy - b1 * say - b2 * sby AS rss FROM b)"


def _robust_sql(weight: str, rounds: int) -> str:
    """Least squares, then rounds of weights of residuals by their median absolute deviation."""
    out = [f"WITH {_L}, x AS (SELECT l_returnflag AS k, a, y + z * z AS y FROM l), f0 AS (SELECT k, regr_slope(y, a) AS b, regr_intercept(y, a) AS c FROM x GROUP BY 1)"]
    for n in range(rounds + 1):
        out.append(f"e{n} AS (SELECT x.k, a, y, y - c - b * a AS e FROM x JOIN f{n} USING (k)), m{n} AS (SELECT k, quantile_cont(e, 0.5) AS m FROM e{n} GROUP BY 1), s{n} AS (SELECT k, 1.4826 * quantile_cont(abs(e - m), 0.5) AS s FROM e{n} JOIN m{n} USING (k) GROUP BY 1)")
        if n < rounds:
            out.append(f"w{n} AS (SELECT e{n}.k, a, y, {weight} AS w FROM e{n} JOIN s{n} USING (k)), q{n} AS (SELECT k, sum(w) AS w, sum(w * a) AS wa, sum(w * y) AS wy, sum(w * a * a) AS waa, sum(w * a * y) AS way FROM w{n} GROUP BY 1), f{n + 1} AS (SELECT k, (w * way - wa * wy) / (w * waa - wa * wa) AS b, (wy * waa - wa * way) / (w * waa - wa * wa) AS c FROM q{n})")
    return ", ".join(out) + f" SELECT k AS l_returnflag, round(c, 6) AS b0, round(b, 6) AS b1, round(s, 6) AS scale FROM f{rounds} JOIN s{rounds} USING (k)"


_OLS = f"WITH {_L}, f AS (SELECT l_returnflag, regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0, count(*)::DOUBLE AS n, sum(a) AS sa, sum(a * a) AS saa FROM l GROUP BY 1), e AS (SELECT l.l_returnflag, l_suppkey, a, y - b0 - b1 * a AS e FROM l JOIN f USING (l_returnflag)), q AS (SELECT l_returnflag, l_suppkey, sum(e) AS u, sum(e * a) AS v FROM e GROUP BY 1, 2), t AS (SELECT l_returnflag, count(*)::DOUBLE AS g, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv FROM q GROUP BY 1), z AS (SELECT *, n * saa - sa * sa AS d FROM f JOIN t USING (l_returnflag)), i AS (SELECT *, saa / d AS p, -sa / d AS q, n / d AS r, g / (g - 1) * (n - 1) / (n - 2) * 1e6 AS k FROM z)"
_METHODS = "WITH p AS (SELECT s_suppkey, pow((s_suppkey * 7919 % 10007) / 10007.0::DOUBLE, 4) AS p FROM supplier), m AS (SELECT count(*)::DOUBLE AS m, least(greatest(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) / (count(*) * 0.5), 1.0 / count(*)), 1.0) AS pi0 FROM p), r AS (SELECT s_suppkey, p, row_number() OVER (ORDER BY p, s_suppkey) AS k FROM p)"

ORACLE_SQL = {
    "paired_cov": f"WITH {_L} " + _pairs("ab", "yz", "covar_samp({i}, {j})"), "paired_corr": f"WITH {_L} " + _pairs("ab", "yz", "corr({i}, {j})"),
    "precision": _matrix(lambda i, j: _P[i + j]), "partial_cov": _matrix(lambda i, j: _P[i + j] if i == j else f"-{_P[i + j]}"),
    "partial_corr": _matrix(lambda i, j: "1.0" if i == j else f"-{_P[i + j]} / sqrt({_P[i + i]} * {_P[j + j]})"),
    "conditional_cov": f"{_COND} {_COND_CELLS('covar_samp')}", "conditional_corr": f"{_COND} {_COND_CELLS('corr')}",
    "ebic_score": f"{_S} SELECT l_returnflag, round(n * (ln(d * pow((n - 1) / n::DOUBLE, 3)) + 3) + 3 * ln(n) + 6 * ln(3), 3) AS ebic FROM p",
    "small_cholesky": f"{_CHOL} SELECT l_returnflag, " + ", ".join(f"(round({n}, 7) + 0.0::DOUBLE) AS {n}" for n in ("l00", "l10", "l11", "l20", "l21", "l22")) + " FROM k",
    "cholesky_solve": _SOLVE, "small_solve": _SOLVE, "small_det": f"{_S} SELECT l_returnflag, round(d, 4) AS d FROM p",
    "small_inverse_log_det": f"{_S} SELECT l_returnflag, round(ln(d), 7) AS by_det, round(ln(d), 7) AS by_cholesky FROM p",
    "symmetric_eigen": f"{_S} SELECT l_returnflag, round((aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab), 7) AS w0, round((aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab), 7) AS w1 FROM p",
    "f_contrast": f"{_FIT} SELECT k AS l_suppkey, round((syy - rss) / 2 / (rss / (n - 3)), 4) AS f, 2::BIGINT AS df1, n - 3 AS df2 FROM f",
    "predict": f"{_FIT} SELECT l_orderkey, l_linenumber, l_partkey, round(b0 + b1 * l.a + b2 * l.b, 5) AS predicted FROM l JOIN f ON k = l_suppkey",
    "deviance_explained": f"{_FIT} SELECT k AS l_suppkey, round(1 - rss / syy, 7) AS explained FROM f",
    "standardized_effect": f"{_FIT} SELECT k AS l_suppkey, round(b1 / sqrt(rss / (n - 3)), 7) AS d FROM f",
    "huber_regress": _robust_sql("CASE WHEN abs(e / s) <= 1.345 THEN 1 ELSE 1.345 / abs(e / s) END", ROUNDS), "tukey_regress": _robust_sql("CASE WHEN abs(e / s) <= 4.685 THEN pow(1 - pow(e / s / 4.685, 2), 2) ELSE 0 END", ROUNDS),
    "sandwich_cluster": f"{_OLS} SELECT l_returnflag, round(k * (p * p * uu + 2 * p * q * uv + q * q * vv), 5) AS c0, round(k * (p * q * uu + (p * r + q * q) * uv + q * r * vv), 5) AS c1, round(k * (q * q * uu + 2 * q * r * uv + r * r * vv), 5) AS c3 FROM i",
    "sandwich_hc1": f"WITH {_L}, r AS (SELECT l_suppkey, regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0, regr_sxx(y, a) AS sxx, avg(a) AS m, count(*) AS n FROM l GROUP BY 1) SELECT l_suppkey, round(sum(pow(a - m, 2) * pow(y - b0 - b1 * a, 2)) / pow(any_value(sxx), 2) * any_value(n) / (any_value(n) - 2.0::DOUBLE), 8) AS var_slope FROM l JOIN r USING (l_suppkey) GROUP BY 1",
    "fdr_methods": _METHODS + " " + " UNION ALL ".join([*(f"SELECT s_suppkey, '{n}' AS method, round(least(1.0, min({f} * p / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r, m" for n, f in (("bh", "m"), ("by", "m * (SELECT sum(1.0::DOUBLE / k) FROM r)"), ("storey", "m * pi0"))), "SELECT s_suppkey, 'bonferroni', round(least(1.0, p * m), 8) FROM r, m"]),
    "whiten_inverse": "SELECT vec_id, i::INT AS i, (round(v[i + 1], 4) + 0.0::DOUBLE) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v, unnest(range(64)) AS i FROM embeddings)",
}
