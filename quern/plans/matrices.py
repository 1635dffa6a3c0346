"""Matrix, graph-signal, resampling and time-correlation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import graph, inference, linalg, semiring, series
from quern.plans.algebra import _trade
from quern.session import staged
from quern.sources import constructors
from quern.sources.tables import read


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade matrix of nations as cells i, j, value."""
    return _trade(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("value") / 1000 / F.sqrt(F.lit(2.0))).alias("value"))


def _matrix(op, digits: int = 6):
    return lambda spark, sf_dir: op(_cells(spark, sf_dir)).select("i", "j", (F.round("value", digits) + 0.0).alias("value"))


def _spd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 2 x 2 covariance for each supplier, flat."""
    m = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.covar_samp("l_quantity", "l_quantity").alias("a"), F.covar_samp("l_quantity", F.col("l_discount") * 300).alias("b"), F.covar_samp(F.col("l_discount") * 300, F.col("l_discount") * 300).alias("c"))
    return m.select("l_suppkey", F.array("a", "b", "b", "c").alias("m"))


def _spd_function(name: str, power: float = 1.0, scale: float = 1.0, digits: int = 6):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _spd(spark, sf_dir).withColumn("m", F.transform("m", lambda x: x * scale))
        out = rows.select("l_suppkey", linalg.spd_function(name, power)(F.col("m")).alias("f"))
        return out.select("l_suppkey", *((F.round(F.col("f")[k], digits) + 0.0).alias(n) for k, n in ((0, "f00"), (1, "f01"), (3, "f11"))))

    return query


def tangent(spark, sf_dir):
    out = _spd(spark, sf_dir).select("l_suppkey", linalg.tangent_project(np.diag([4.0, 9.0]))(F.col("m")).alias("f"))
    return out.select("l_suppkey", *((F.round(F.col("f")[k], 6) + 0.0).alias(n) for k, n in ((0, "f00"), (1, "f01"), (3, "f11"))))


def mean_log_euclidean(spark, sf_dir):
    out = linalg.mean_log_euclidean(_spd(spark, sf_dir), "m")
    return out.select(*((F.round(F.col("mean")[k], 5) + 0.0).alias(n) for k, n in ((0, "f00"), (1, "f01"), (3, "f11"))))


def toeplitz(spark, sf_dir):
    """As large as the table of nations: 1 / (1 + distance) below the diagonal, its negative above."""
    n = read(spark, sf_dir, "nation").count()
    down = [1 / (1 + k) for k in range(n)]
    return constructors.toeplitz(spark, down, [down[0], *(-v for v in down[1:])])


def _grid(spark, sf_dir) -> tuple[int, int]:
    return read(spark, sf_dir, "nation").count(), read(spark, sf_dir, "supplier").count()


def grid_laplacian(spark, sf_dir):
    """On a grid of nations by suppliers."""
    return constructors.grid_laplacian(spark, *_grid(spark, sf_dir))


def grid_stencil(spark, sf_dir):
    return constructors.grid_operator(spark, *_grid(spark, sf_dir), [(0, 1, 0.5), (-1, 0, 0.25), (0, 0, -1.0)], "wrap")


def grid_identity(spark, sf_dir):
    return constructors.grid_identity(spark, read(spark, sf_dir, "supplier").count())


def identity_grid(spark, sf_dir):
    return constructors.index_grid(spark, *_grid(spark, sf_dir))


def sym2vec(spark, sf_dir):
    sym = linalg.symmetric(_cells(spark, sf_dir))
    full = constructors.index_grid(spark, 25, 25).join(sym, ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.0)).alias("value"))
    return constructors.sym_to_vec(full, 1).select("k", (F.round("value", 6) + 0.0).alias("value"))


def _signal(spark):
    return spark.range(25).select("id", (F.col("id") / 10).alias("v"))


def chebyshev(spark, sf_dir):
    """T0 / 2 + T1 / 4 + T2 / 8 of the scaled symmetric Laplacian of trade, applied to a signal."""
    out = graph.chebyshev_filter(_trade(spark, sf_dir), _signal(spark), [0.5, 0.25, 0.125], 2.0)
    return out.select("id", (F.round("value", 6) + 0.0).alias("value"))


def conjugate_gradient(spark, sf_dir):
    """Solution of (S + l I) x = b for the symmetric part S of trade, l above its row sums, by what A x gives back."""
    sym = staged(semiring.edges_from_dense(_trade(spark, sf_dir), 0.0, None, True))  # read by every round
    ridge = sym.groupBy("src").agg(F.sum("value").alias("s")).agg(F.max("s")).first()[0] * 1.5
    x = linalg.conjugate_gradient(sym, _signal(spark), l2=ridge)
    back = semiring.edge_rmatvec(sym, x).select(F.col("dst").alias("id"), "value")
    joined = x.join(back, "id", "left")
    return joined.select("id", (F.round(F.coalesce("value", F.lit(0.0)) + ridge * F.col("v"), 5) + 0.0).alias("value"))


def top_eigenvector(spark, sf_dir):
    """A v minus its multiple of v for the leading eigenvector of symmetric trade: zeros."""
    sym = staged(semiring.edges_from_dense(_trade(spark, sf_dir), 0.0, None, True))  # read by every round
    v, value = graph.top_eigenvector(sym, spark.range(25).select("id", F.lit(0.2).alias("v")))
    back = semiring.edge_rmatvec(sym, v).select(F.col("dst").alias("id"), "value")
    return v.join(back, "id").select("id", (F.round((F.col("value") - value * F.col("v")) / value, 4) + 0.0).alias("residual"))


def boundary_map(spark, sf_dir):
    profiles = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + F.col("n_nationkey") / 25).alias("v"))
    out = graph.boundary_map(profiles, _trade(spark, sf_dir), F.exp(-F.abs(F.col("_a") - F.col("_b"))))
    return out.select("id", F.round("value", 7).alias("value"))


def modularity_full(spark, sf_dir):
    return graph.modularity_matrix_full(_trade(spark, sf_dir)).select("src", "dst", F.round("value", 9).alias("value"))


def _conv(name: str, stride: int, dilation: int):
    def query(spark, sf_dir):
        rows = read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        cells = rows.select(F.col("user_id").alias("series"), (F.row_number().over(order) - 1).alias("t"), (F.col("value") / 10).alias("v"))
        out = semiring.conv1d(cells, [0.5, 1.0, 0.25], semiring.ALGEBRAS[name], stride, dilation)
        return out.select("series", "t", (F.round("value", 6) + 0.0).alias("value"))

    return query


def car1(spark, sf_dir):
    rows = read(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("event_id", "user_id", F.col("event_id").alias("t"), "value")
    return series.car1_whiten(rows, "user_id", "t", "value", 0.999).select("event_id", F.round("white", 6).alias("white"))


def permutation_test(spark, sf_dir):
    """Sign-flip test by segment of whether the balance differs from 4500."""
    rows = read(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000 - 4.5).alias("x"))
    out = inference.sign_flip_test(rows, ["c_mktsegment"], "id", "x", 50, 3)
    return out.select("c_mktsegment", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))


def sign_flips(spark, sf_dir):
    return inference.sign_flips(spark, read(spark, sf_dir, "supplier").count(), 8, 7).select("perm", "obs", "sign")


def permutations(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("block"))
    return inference.permutations(rows, 6, 2).select("perm", "id", "source")


def spatial_null_test(spark, sf_dir):
    """Correlation of size and price of parts against that with permuted prices."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    perms = inference.permutations(rows.select("id", F.lit(0).alias("block")), 20, 4).filter("perm > 0")
    surrogates = perms.join(rows.select(F.col("id").alias("source"), "y").hint("merge"), "source").select(F.col("perm").alias("surrogate"), "id", "y")
    return inference.spatial_null_test(rows, surrogates).select(F.round("r", 8).alias("r"), F.round("p", 8).alias("p"))


QUERIES = {
    "symmetric": _matrix(linalg.symmetric), "skew": _matrix(lambda c: linalg.symmetric(c, True)), "fill_diagonal": _matrix(lambda c: linalg.fill_diagonal(c, 2.5, 1)),
    "delete_diagonal": _matrix(linalg.delete_diagonal), "recondition": _matrix(lambda c: linalg.recondition(c, 0.125)), "sym2vec": sym2vec,
    "spd_log": _spd_function("log"), "spd_exp": _spd_function("exp", scale=0.002), "spd_sqrt": _spd_function("sqrt"), "spd_power": _spd_function("power", 0.3), "spd_inverse_sqrt": _spd_function("inverse_sqrt"),
    "tangent_project": tangent, "mean_log_euclidean": mean_log_euclidean, "toeplitz": toeplitz, "grid_laplacian": grid_laplacian, "grid_stencil": grid_stencil, "grid_identity": grid_identity,
    "identity_grid": identity_grid, "chebyshev_apply": chebyshev, "conjugate_gradient": conjugate_gradient, "top_eigenvector": top_eigenvector, "boundary_map": boundary_map,
    "modularity_matrix_full": modularity_full, "conv_real": _conv("real", 1, 2), "conv_max_plus": _conv("max_plus", 2, 1), "conv_log": _conv("log", 2, 2), "car1_whiten": car1,
    "permutation_test": permutation_test, "sign_flips": sign_flips, "permutations": permutations, "spatial_null_test": spatial_null_test,
}

_E = "e AS (SELECT o_custkey AS src, l_suppkey AS dst, sum(l_extendedprice) / 1000 AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_T = f"WITH {_E}, t AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, sum(value) AS value FROM e JOIN customer ON src = c_custkey JOIN supplier ON dst = s_suppkey GROUP BY 1, 2), m AS (SELECT i, j, value / 1000 / sqrt(2) AS value FROM t), y AS (SELECT i, j, sum(value) / 2 AS value FROM (SELECT i, j, value FROM m UNION ALL SELECT j, i, value FROM m) GROUP BY 1, 2)"


def _r(expression: str, digits: int, name: str) -> str:
    return f"(round({expression}, {digits}) + 0.0::DOUBLE) AS {name}"


_SPD = "WITH m AS (SELECT l_suppkey, covar_samp(l_quantity, l_quantity) * {s} AS a, covar_samp(l_quantity, l_discount * 300) * {s} AS b, covar_samp(l_discount * 300, l_discount * 300) * {s} AS c FROM lineitem GROUP BY 1), w AS (SELECT *, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS p, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS q FROM m)"
_BY_EIGEN = "({q} * ({x} - p) - {p} * ({x} - q)) / (q - p)"


def _spd_cells(f: str, digits: int = 6) -> str:
    """Cells of a function of the eigenvalues p < q of [[a, b], [b, c]]."""
    fp, fq = f.format("p"), f.format("q")
    off = f"(({fq}) - ({fp})) * b / (q - p)"
    return ", ".join((_r(_BY_EIGEN.format(q=f"({fq})", p=f"({fp})", x="a"), digits, "f00"), _r(off, digits, "f01"), _r(_BY_EIGEN.format(q=f"({fq})", p=f"({fp})", x="c"), digits, "f11")))


def _spd_sql(f: str, scale: float = 1.0) -> str:
    return f"{_SPD.format(s=scale)} SELECT l_suppkey, {_spd_cells(f)} FROM w"


_TANGENT = "WITH m AS (SELECT l_suppkey, covar_samp(l_quantity, l_quantity) / 4 AS a, covar_samp(l_quantity, l_discount * 300) / 6 AS b, covar_samp(l_discount * 300, l_discount * 300) / 9 AS c FROM lineitem GROUP BY 1), w AS (SELECT *, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS p, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS q FROM m)"
_LOGS = f"{_SPD.format(s=1.0)}, l AS (SELECT avg(({_BY_EIGEN.format(q='ln(q)', p='ln(p)', x='a')})) AS a, avg((ln(q) - ln(p)) * b / (q - p)) AS b, avg(({_BY_EIGEN.format(q='ln(q)', p='ln(p)', x='c')})) AS c FROM w), v AS (SELECT *, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS p, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS q FROM l) SELECT {_spd_cells('exp({})', 5)} FROM v"
_GRID = "WITH n AS (SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM supplier) AS m), g AS (SELECT i::BIGINT AS i, j::BIGINT AS j, n, m FROM n, range(n) a(i), range(m) b(j))"
_LAP = "d AS (SELECT i AS id, sum(value) AS d FROM t GROUP BY 1)"
_STEP = "SELECT x.id, -coalesce(sum(t.value * y.v / sqrt(p.d * q.d)), 0) AS v FROM {x} x LEFT JOIN t ON t.i = x.id LEFT JOIN d p ON p.id = t.i LEFT JOIN d q ON q.id = t.j LEFT JOIN {x} y ON y.id = t.j GROUP BY 1"
_SERIES = "WITH s AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value / 10 AS v FROM events WHERE user_id IS NOT NULL), k AS (SELECT unnest([-1, 0, 1]) AS h, unnest([0.5, 1.0, 0.25]::DOUBLE[]) AS w)"


def _conv_sql(reduce: str, stride: int, dilation: int) -> str:
    return f"{_SERIES} SELECT a.series, a.t::INT AS t, (round({reduce}, 6) + 0.0::DOUBLE) AS value FROM s a, k JOIN s b ON b.series = a.series AND b.t = a.t + h * {dilation} WHERE a.t % {stride} = 0 GROUP BY 1, 2"


_FLIP = "CASE WHEN perm > 0 AND (('0x' || substr(md5('{seed}:' || perm || ':' || {id}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 < 0.5 THEN -1 ELSE 1 END"
_SHUFFLE = "o AS (SELECT perm, id, block, row_number() OVER (PARTITION BY perm, block ORDER BY id) AS k, row_number() OVER (PARTITION BY perm, block ORDER BY CASE WHEN perm = 0 THEN 0 ELSE ('0x' || substr(md5('{seed}:' || perm || ':' || id), 1, 8))::BIGINT END, id) AS q FROM b, range({n}) r(perm)), p AS (SELECT a.perm, a.id, c.id AS source FROM o a JOIN o c ON c.perm = a.perm AND c.block = a.block AND c.q = a.k)"

ORACLE_SQL = {
    "symmetric": f"{_T} SELECT i, j, {_r('value', 6, 'value')} FROM y",
    "skew": f"{_T} SELECT i, j, {_r('sum(value) / 2', 6, 'value')} FROM (SELECT i, j, value FROM m UNION ALL SELECT j, i, -value FROM m) GROUP BY 1, 2",
    "fill_diagonal": f"{_T} SELECT i, j, {_r('CASE WHEN j - i = 1 THEN 2.5 ELSE value END', 6, 'value')} FROM m", "delete_diagonal": f"{_T} SELECT i, j, {_r('CASE WHEN j = i THEN 0 ELSE value END', 6, 'value')} FROM m",
    "recondition": f"{_T} SELECT i, j, {_r('CASE WHEN j = i THEN value + 0.125 ELSE value END', 6, 'value')} FROM m",
    "sym2vec": f"{_T} SELECT row_number() OVER (ORDER BY a.i, b.j) - 1 AS k, {_r('coalesce(value, 0)', 6, 'value')} FROM range(25) a(i) JOIN range(25) b(j) ON b.j > a.i LEFT JOIN y ON y.i = a.i AND y.j = b.j",
    "spd_log": _spd_sql("ln({})"), "spd_exp": _spd_sql("exp({})", 0.002), "spd_sqrt": _spd_sql("sqrt({})"), "spd_power": _spd_sql("pow({}, 0.3)"), "spd_inverse_sqrt": _spd_sql("1 / sqrt({})"),
    "tangent_project": f"{_TANGENT} SELECT l_suppkey, {_spd_cells('ln({})')} FROM w", "mean_log_euclidean": _LOGS,
    "toeplitz": "SELECT i::BIGINT AS i, j::BIGINT AS j, CASE WHEN i >= j THEN 1 ELSE -1 END / (1.0::DOUBLE + abs(i - j)) AS value FROM (SELECT count(*) AS n FROM nation), range(n) a(i), range(n) b(j)",
    "grid_laplacian": f"{_GRID} SELECT i * m + j AS src, least(greatest(i + a, 0), n - 1) * m + least(greatest(j + b, 0), m - 1) AS dst, sum(w)::DOUBLE AS value FROM g, (VALUES (0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)) o(a, b, w) GROUP BY 1, 2",
    "grid_stencil": f"{_GRID} SELECT i * m + j AS src, (i + a + n) % n * m + (j + b + m) % m AS dst, sum(w)::DOUBLE AS value FROM g, (VALUES (0, 1, 0.5), (-1, 0, 0.25), (0, 0, -1.0)) o(a, b, w) GROUP BY 1, 2",
    "grid_identity": "SELECT k::BIGINT AS src, k::BIGINT AS dst, 1.0::DOUBLE AS value FROM (SELECT count(*) AS n FROM supplier), range(n) r(k)", "identity_grid": f"{_GRID} SELECT i, j FROM g",
    "chebyshev_apply": f"{_T}, {_LAP}, x0 AS (SELECT k::BIGINT AS id, k / 10.0::DOUBLE AS v FROM range(25) r(k)), x1 AS ({_STEP.format(x='x0')}), x2 AS (SELECT z.id, 2 * z.v - x0.v AS v FROM ({_STEP.format(x='x1')}) z JOIN x0 USING (id)) SELECT id, {_r('x0.v / 2 + x1.v / 4 + x2.v / 8', 6, 'value')} FROM x0 JOIN x1 USING (id) JOIN x2 USING (id)",
    "conjugate_gradient": "SELECT k::BIGINT AS id, round(k / 10.0::DOUBLE, 5) AS value FROM range(25) r(k)",
    "top_eigenvector": f"{_T} SELECT DISTINCT i AS id, 0.0::DOUBLE AS residual FROM y",
    "boundary_map": f"{_T}, v AS (SELECT n_nationkey AS id, n_regionkey + n_nationkey / 25.0::DOUBLE AS v FROM nation) SELECT t.i AS id, round(avg(1 - exp(-abs(p.v - q.v))), 7) AS value FROM t JOIN v p ON p.id = t.i JOIN v q ON q.id = t.j GROUP BY 1",
    "modularity_matrix_full": f"{_T}, o AS (SELECT i, sum(value) AS o FROM t GROUP BY 1), n AS (SELECT j, sum(value) AS n FROM t GROUP BY 1), s AS (SELECT sum(value) AS s FROM t) SELECT o.i AS src, n.j AS dst, round((coalesce(value, 0) - o * n / s) / s, 9) AS value FROM o CROSS JOIN n CROSS JOIN s LEFT JOIN t ON t.i = o.i AND t.j = n.j",
    "conv_real": _conv_sql("sum(b.v * w)", 1, 2), "conv_max_plus": _conv_sql("max(b.v + w)", 2, 1), "conv_log": _conv_sql("ln(sum(exp(b.v + w)))", 2, 2),
    "car1_whiten": "WITH s AS (SELECT event_id, value, lag(value) OVER w AS p, pow(0.999::DOUBLE, event_id - lag(event_id) OVER w) AS r FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, round(coalesce((value - r * p) / sqrt(1 - r * r), value), 6) AS white FROM s",
    "permutation_test": f"WITH x AS (SELECT c_mktsegment, perm, (c_acctbal / 1000 - 4.5) * {_FLIP.format(seed=3, id='c_custkey')} AS x FROM customer, range(50) r(perm)), t AS (SELECT c_mktsegment, perm, avg(x) / sqrt(var_samp(x) / count(*)) AS t FROM x GROUP BY 1, 2), o AS (SELECT c_mktsegment, t AS o FROM t WHERE perm = 0) SELECT c_mktsegment, round(any_value(o), 6) AS t, round(avg(CASE WHEN abs(t) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM t JOIN o USING (c_mktsegment) GROUP BY 1",
    "sign_flips": f"SELECT perm::BIGINT AS perm, obs::BIGINT AS obs, ({_FLIP.format(seed=7, id='obs')})::INT AS sign FROM (SELECT count(*) AS n FROM supplier), range(8) r(perm), range(n) s(obs)",
    "permutations": f"WITH b AS (SELECT s_suppkey AS id, s_nationkey AS block FROM supplier), {_SHUFFLE.format(seed=2, n=6)} SELECT perm::INT AS perm, id, source FROM p",
    "spatial_null_test": f"WITH b AS (SELECT p_partkey AS id, 0 AS block FROM part), {_SHUFFLE.format(seed=4, n=20)}, x AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part), r AS (SELECT perm, corr(x.x, z.y) AS r FROM p JOIN x ON x.id = p.id JOIN x z ON z.id = p.source GROUP BY 1), w AS (SELECT r AS s FROM r WHERE perm = 0) SELECT round(s, 8) AS r, round((1 + sum(CASE WHEN perm > 0 AND abs(r) >= abs(s) THEN 1 ELSE 0 END)) / (count(*)::DOUBLE), 8) AS p FROM r, w GROUP BY s",
}
