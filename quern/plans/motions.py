"""Rotations, affine and rigid maps, points on the sphere and distances. Parameters of the maps come from line items."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry as g
from quern.functions.arrays import doubles
from quern.operators import kernels, models
from quern.sources.tables import read

KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def Q():  # noqa: N802
    return F.col("l_quantity")


def D():  # noqa: N802
    return F.col("l_discount")


def T():  # noqa: N802
    return F.col("l_tax")



def _angles():
    return [Q() * 3 - 75, D() * 800 - 40, T() * 1000 - 40]


def _named(names, values, digits: int = 7):
    return [(F.round(v, digits) + 0.0).alias(n) for n, v in zip(names, values)]


def _cells(m, digits: int = 7):
    return _named([f"m{i}{j}" for i in range(len(m)) for j in range(len(m[0]))], [v for row in m for v in row], digits)


def _rows(op):
    """A query of columns for each line item."""
    return lambda spark, sf_dir: read(spark, sf_dir, "lineitem").select(*KEY, *op())


def _planar():
    """A planar affine map: shift, angle, scales and shear."""
    return g.affine([Q(), D() * 100, T() * 500 - 20, D() + 0.5, T() + 1.5, D() * 2 - 0.1], 2)


def rotation_angles(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    m = g.rotation(_angles())
    held = rows.select(*KEY, *(v.alias(f"m{i}{j}") for i, r in enumerate(m) for j, v in enumerate(r)))
    again = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    return held.select(*KEY, *_named("abc", g.rotation_angles(again), 6))


def _held(rows: DataFrame, m) -> tuple[DataFrame, list]:
    """rows with a matrix as columns, and the matrix of these."""
    held = rows.select(*rows.columns, *(v.alias(f"_m{i}{j}") for i, r in enumerate(m) for j, v in enumerate(r)))
    return held, [[F.col(f"_m{i}{j}") for j in range(len(m[0]))] for i in range(len(m))]


def affine_params(spark, sf_dir):
    held, m = _held(read(spark, sf_dir, "lineitem"), _planar())
    return held.select(*KEY, *_named(("tx", "ty", "angle", "sx", "sy", "shear"), g.affine_params(m), 6))


def affine_inverse(spark, sf_dir):
    held, m = _held(read(spark, sf_dir, "lineitem"), _planar())
    return held.select(*KEY, *_cells(g.inverse_affine(m), 5))


def affine_compose(spark, sf_dir):
    held, m = _held(read(spark, sf_dir, "lineitem"), _planar())
    turn = g.affine([F.lit(1.0), F.lit(2.0), F.lit(30.0)], 2)
    return held.select(*KEY, *_cells(g.compose([turn, m])[:2], 6))


def affine_apply(spark, sf_dir):
    held, m = _held(read(spark, sf_dir, "lineitem"), _planar())
    return held.select(*KEY, *_named("xy", g.apply_affine(m, [Q() / 10, F.col("l_linenumber").cast("double")], [F.lit(2.0), F.lit(3.0)]), 6))


def affine_grid(spark, sf_dir):
    """Where the cells of the image of events go under one map about the middle of a row."""
    e = F.col("event_id")
    m = g.affine([F.lit(0.5), F.lit(-1.0), F.lit(12.0), F.lit(1.1), F.lit(0.9)], 2)
    point = [F.floor(e / 100).cast("double"), (e % 100).cast("double")]
    return read(spark, sf_dir, "events").select("event_id", *_named("xy", g.apply_affine(m, point, [F.lit(0.0), F.lit(50.0)]), 6))


def _rigid():
    return [D() * 8 - 0.4, T() * 10 - 0.4, Q() / 30, Q(), D(), T()]


def rigid_log(spark, sf_dir):
    held, m = _held(read(spark, sf_dir, "lineitem"), g.rigid_exp(_rigid()))
    return held.select(*KEY, *_named(("wx", "wy", "wz", "tx", "ty", "tz"), g.rigid_log(m), 6))


def fit_affine(spark, sf_dir):
    """Least-squares map of (quantity, discount) to (price, tax) by flag, weighted by line number."""
    rows = read(spark, sf_dir, "lineitem")
    x, w, out = [Q(), D() * 100, F.lit(1.0)], F.col("l_linenumber").cast("double"), None
    for name, y in (("u", F.col("l_extendedprice") / 1000), ("v", T() * 100)):
        fit = models.solved(models.design_sums(rows, ["l_returnflag"], x, y, w), ["l_returnflag"], 3)
        cells = fit.select("l_returnflag", *(F.round(F.col("beta")[i], 5).alias(f"{name}{i}") for i in range(3)))
        out = cells if out is None else out.join(cells, "l_returnflag")
    return out


def _sphere():
    return (Q() - 25) * math.pi / 60, D() * 60 - 3


def geodesic(spark, sf_dir):
    """Distances on the sphere between every hundredth part and all parts."""
    lat, lon = (F.col("p_size") - 25) * math.pi / 60, F.col("p_retailprice") / 300 - 3
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(*g.latlong_to_cartesian(lat, lon)).alias("vec"))
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    return kernels.kernel(asked, rows, "geodesic", 7)


def nearest_distance(spark, sf_dir):
    """Squared distance of every hundredth embedding to the nearest other one."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("vec"))
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    pairs = kernels.nearest(asked, rows, 2).filter("q_id <> id")  # two, as a row is near to itself
    return pairs.groupBy("q_id").agg(F.round(F.min("value"), 6).alias("d2"))


def _segments():
    n = F.col("l_linenumber").cast("double")
    return g.segment_distance2([Q(), n, D() * 100], [Q() + n, n, T() * 100], [n, Q() / 5, F.lit(0.0)], [n + 5, Q() / 5, D() * 50])


QUERIES = {
    "rotation_planar": _rows(lambda: _cells(g.rotation([Q() * 7]))), "rotation_matrix": _rows(lambda: _cells(g.rotation(_angles()))), "rotation_angles": rotation_angles,
    "affine_matrix": _rows(lambda: _cells(_planar())), "affine_params": affine_params, "affine_square": _rows(lambda: _cells(g.squared_affine(_planar()), 6)),
    "affine_inverse": affine_inverse, "affine_compose": affine_compose, "affine_apply": affine_apply, "affine_grid": affine_grid, "fit_affine": fit_affine,
    "rigid_exp": _rows(lambda: _cells(g.rigid_exp(_rigid())[:3])), "rigid_log": rigid_log,
    "latlong_to_cartesian": _rows(lambda: _named("xyz", g.latlong_to_cartesian(*_sphere(), 2.0))),
    "cartesian_to_latlong": _rows(lambda: _named(("lat", "lon"), g.cartesian_to_latlong([Q() - 25, D() * 100 - 5, T() * 100 - 4.5]))),
    "geodesic_distance": geodesic, "nearest_distance": nearest_distance, "segment_distance": _rows(lambda: _named(["d2"], [_segments()], 5)),
}


def _r(expression: str, digits: int, name: str) -> str:
    return f"(round({expression}, {digits}) + 0.0::DOUBLE) AS {name}"


_K = "l_orderkey, l_linenumber, l_partkey"
_A = f"WITH a AS (SELECT *, radians(l_quantity * 3 - 75) AS a, radians(l_discount * 800 - 40) AS b, radians(l_tax * 1000 - 40) AS c FROM lineitem)"  # noqa: F541
_ROT = ("cos(b) * cos(c)", "-cos(b) * sin(c)", "sin(b)", "sin(a) * sin(b) * cos(c) + cos(a) * sin(c)", "-sin(a) * sin(b) * sin(c) + cos(a) * cos(c)", "-sin(a) * cos(b)", "-cos(a) * sin(b) * cos(c) + sin(a) * sin(c)", "cos(a) * sin(b) * sin(c) + sin(a) * cos(c)", "cos(a) * cos(b)")
_P = "WITH p AS (SELECT *, l_quantity AS tx, l_discount * 100 AS ty, l_tax * 500 - 20 AS deg, radians(l_tax * 500 - 20) AS a, l_discount + 0.5 AS sx, l_tax + 1.5 AS sy, l_discount * 2 - 0.1 AS e FROM lineitem), m AS (SELECT *, cos(a) * sx AS m00, cos(a) * sx * e - sin(a) * sy AS m01, sin(a) * sx AS m10, sin(a) * sx * e + cos(a) * sy AS m11 FROM p)"
_RIGID = "WITH w AS (SELECT *, l_discount * 8 - 0.4 AS wx, l_tax * 10 - 0.4 AS wy, l_quantity / 30 AS wz FROM lineitem), s AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS t FROM w), k AS (SELECT *, sin(t) / t AS a, (1 - cos(t)) / (t * t) AS b FROM s)"
_RODRIGUES = ("1 - b * (wy * wy + wz * wz)", "-a * wz + b * wx * wy", "a * wy + b * wx * wz", "a * wz + b * wx * wy", "1 - b * (wx * wx + wz * wz)", "-a * wx + b * wy * wz", "-a * wy + b * wx * wz", "a * wx + b * wy * wz", "1 - b * (wx * wx + wy * wy)")
_FIT = "SELECT l_returnflag, l_quantity AS x, l_discount * 100 AS y, l_linenumber::DOUBLE AS w, l_extendedprice / 1000 AS u, l_tax * 100 AS v FROM lineitem"
_M9 = [f"m{i}{j}" for i in range(3) for j in range(3)]
_COV = "sum(w * {0} * {1}) - sum(w * {0}) * sum(w * {1}) / sum(w) AS s{0}{1}"


def _fitted(t: str) -> list[str]:
    b0, b1 = f"((syy * sx{t} - sxy * sy{t}) / d)", f"((sxx * sy{t} - sxy * sx{t}) / d)"
    return [f"round({b0}, 5) AS {t}0", f"round({b1}, 5) AS {t}1", f"round(m{t} - {b0} * mx - {b1} * my, 5) AS {t}2"]


_SEG = "WITH s AS (SELECT *, l_linenumber::DOUBLE AS n FROM lineitem), g AS (SELECT *, n AS ux, 0.0::DOUBLE AS uy, l_tax * 100 - l_discount * 100 AS uz, 5.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, l_discount * 50 AS vz, l_quantity - n AS rx, n - l_quantity / 5 AS ry, l_discount * 100 AS rz FROM s), h AS (SELECT *, ux * ux + uy * uy + uz * uz AS a, vx * vx + vy * vy + vz * vz AS e, vx * rx + vy * ry + vz * rz AS f, ux * rx + uy * ry + uz * rz AS c, ux * vx + uy * vy + uz * vz AS b FROM g), i AS (SELECT *, CASE WHEN a * e - b * b > 1e-12 THEN least(greatest((b * f - c * e) / (a * e - b * b), 0), 1) ELSE 0 END AS s0 FROM h), j AS (SELECT *, (b * s0 + f) / e AS t0 FROM i), k AS (SELECT *, least(greatest(t0, 0), 1) AS t, CASE WHEN t0 < 0 THEN least(greatest(-c / a, 0), 1) WHEN t0 > 1 THEN least(greatest((b - c) / a, 0), 1) ELSE s0 END AS s FROM j)"

ORACLE_SQL = {
    "rotation_planar": f"SELECT {_K}, {_r('cos(radians(l_quantity * 7))', 7, 'm00')}, {_r('-sin(radians(l_quantity * 7))', 7, 'm01')}, {_r('sin(radians(l_quantity * 7))', 7, 'm10')}, {_r('cos(radians(l_quantity * 7))', 7, 'm11')} FROM lineitem",
    "rotation_matrix": f"{_A} SELECT {_K}, " + ", ".join(_r(x, 7, n) for x, n in zip(_ROT, _M9)) + " FROM a",
    "rotation_angles": f"{_A} SELECT {_K}, {_r('degrees(a)', 6, 'a')}, {_r('degrees(b)', 6, 'b')}, {_r('degrees(c)', 6, 'c')} FROM a",
    "affine_matrix": f"{_P} SELECT {_K}, {_r('m00', 7, 'm00')}, {_r('m01', 7, 'm01')}, {_r('tx', 7, 'm02')}, {_r('m10', 7, 'm10')}, {_r('m11', 7, 'm11')}, {_r('ty', 7, 'm12')} FROM m",
    "affine_square": f"{_P} SELECT {_K}, {_r('m00', 6, 'm00')}, {_r('m01', 6, 'm01')}, {_r('tx', 6, 'm02')}, {_r('m10', 6, 'm10')}, {_r('m11', 6, 'm11')}, {_r('ty', 6, 'm12')}, 0.0::DOUBLE AS m20, 0.0::DOUBLE AS m21, 1.0::DOUBLE AS m22 FROM m",
    "affine_params": f"{_P} SELECT {_K}, {_r('tx', 6, 'tx')}, {_r('ty', 6, 'ty')}, {_r('deg', 6, 'angle')}, {_r('sx', 6, 'sx')}, {_r('sy', 6, 'sy')}, {_r('e', 6, 'shear')} FROM m",
    "affine_inverse": f"{_P}, d AS (SELECT *, m00 * m11 - m01 * m10 AS d FROM m) SELECT {_K}, {_r('m11 / d', 5, 'm00')}, {_r('-m01 / d', 5, 'm01')}, {_r('(m01 * ty - m11 * tx) / d', 5, 'm02')}, {_r('-m10 / d', 5, 'm10')}, {_r('m00 / d', 5, 'm11')}, {_r('(m10 * tx - m00 * ty) / d', 5, 'm12')} FROM d",
    "affine_compose": f"{_P}, r AS (SELECT *, cos(radians(30)) AS c, sin(radians(30)) AS s FROM m) SELECT {_K}, {_r('c * m00 - s * m10', 6, 'm00')}, {_r('c * m01 - s * m11', 6, 'm01')}, {_r('c * tx - s * ty + 1', 6, 'm02')}, {_r('s * m00 + c * m10', 6, 'm10')}, {_r('s * m01 + c * m11', 6, 'm11')}, {_r('s * tx + c * ty + 2', 6, 'm12')} FROM r",
    "affine_apply": f"{_P} SELECT {_K}, {_r('m00 * (l_quantity / 10 - 2) + m01 * (l_linenumber - 3) + tx + 2', 6, 'x')}, {_r('m10 * (l_quantity / 10 - 2) + m11 * (l_linenumber - 3) + ty + 3', 6, 'y')} FROM m",
    "affine_grid": f"WITH g AS (SELECT event_id, event_id // 100 AS x, event_id % 100 - 50 AS y, radians(12) AS a FROM events) SELECT event_id, {_r('1.1 * cos(a) * x - 0.9 * sin(a) * y + 0.5', 6, 'x')}, {_r('1.1 * sin(a) * x + 0.9 * cos(a) * y - 1 + 50', 6, 'y')} FROM g",
    "fit_affine": f"WITH r AS ({_FIT}), s AS (SELECT l_returnflag, {', '.join(_COV.format(a, b) for a, b in ('xx', 'xy', 'yy', 'xu', 'yu', 'xv', 'yv'))}, {', '.join(f'sum(w * {c}) / sum(w) AS m{c}' for c in 'xyuv')} FROM r GROUP BY 1), t AS (SELECT *, sxx * syy - sxy * sxy AS d FROM s) SELECT l_returnflag, {', '.join(_fitted('u') + _fitted('v'))} FROM t",
    "rigid_exp": f"{_RIGID} SELECT {_K}, " + ", ".join(_r(x, 7, f"m{n // 3}{n % 3}") for n, x in enumerate(_RODRIGUES)) + f", {_r('l_quantity', 7, 'm03')}, {_r('l_discount', 7, 'm13')}, {_r('l_tax', 7, 'm23')} FROM k",
    "rigid_log": f"{_RIGID} SELECT {_K}, {_r('wx', 6, 'wx')}, {_r('wy', 6, 'wy')}, {_r('wz', 6, 'wz')}, {_r('l_quantity', 6, 'tx')}, {_r('l_discount', 6, 'ty')}, {_r('l_tax', 6, 'tz')} FROM k",
    "latlong_to_cartesian": f"WITH a AS (SELECT *, (l_quantity - 25) * pi() / 60 AS t, l_discount * 60 - 3 AS n FROM lineitem) SELECT {_K}, {_r('2 * cos(t) * cos(n)', 7, 'x')}, {_r('2 * cos(t) * sin(n)', 7, 'y')}, {_r('2 * sin(t)', 7, 'z')} FROM a",
    "cartesian_to_latlong": f"WITH p AS (SELECT *, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax * 100 - 4.5 AS z FROM lineitem) SELECT {_K}, {_r('atan2(z, sqrt(x * x + y * y))', 7, 'lat')}, {_r('atan2(y, x)', 7, 'lon')} FROM p",
    "geodesic_distance": f"WITH a AS (SELECT p_partkey AS id, (p_size - 25) * pi() / 60 AS t, p_retailprice / 300 - 3 AS n FROM part), p AS (SELECT id, cos(t) * cos(n) AS x, cos(t) * sin(n) AS y, sin(t) AS z FROM a) SELECT q.id AS q_id, p.id, {_r('atan2(sqrt(pow(q.y * p.z - q.z * p.y, 2) + pow(q.z * p.x - q.x * p.z, 2) + pow(q.x * p.y - q.y * p.x, 2)), q.x * p.x + q.y * p.y + q.z * p.z)', 7, 'value')} FROM p q, p WHERE q.id % 100 = 0",
    "nearest_distance": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT q.vec_id AS q_id, round(min(list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS d2 FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1",
    "segment_distance": f"{_SEG} SELECT {_K}, {_r('pow(rx + s * ux - t * vx, 2) + pow(ry + s * uy - t * vy, 2) + pow(rz + s * uz - t * vz, 2)', 5, 'd2')} FROM k",
}
