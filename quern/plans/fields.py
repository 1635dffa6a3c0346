"""Image queries: sampling, fields of displacement, bilateral smoothing, boundaries and distances, pooling, noise by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import augment, fields, grid
from quern.plans.spatial import _cells


def _rounded(out: DataFrame, digits: int = 6, **renamed) -> DataFrame:
    return out.select("x", "y", (F.round("v", digits) + 0.0).alias("v"))


def _image(op, digits: int = 6):
    return lambda spark, sf_dir: _rounded(op(_cells(spark, sf_dir)), digits)


def _sampled(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = _cells(spark, sf_dir)
        points = cells.select("img", (F.col("x") * 100 + F.col("y")).alias("pid"), (F.col("x") + 0.3).alias("px"), (F.col("y") - 0.4).alias("py"))
        return fields.sample(cells, points, method).select("pid", (F.round("v", 6) + 0.0).alias("v"))

    return query


def multi_label(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 20).cast("double"))
    points = cells.select("img", (F.col("x") * 100 + F.col("y")).alias("pid"), (F.col("x") + 0.3).alias("px"), (F.col("y") - 0.4).alias("py"))
    return fields.sample_labels(cells, points).select("pid", F.col("label").cast("long").alias("label"))


def _displacement(spark, sf_dir) -> DataFrame:
    """A displacement of each cell, from its value and its row."""
    return _cells(spark, sf_dir).select("img", "x", "y", (F.col("v") / 97 - 0.4).alias("ux"), ((F.col("v") % 7) / 11).alias("uy"))


def jacobian(spark, sf_dir):
    out = fields.jacobian(_displacement(spark, sf_dir))
    return out.select("x", "y", *((F.round(c, 7) + 0.0).alias(c) for c in ("jxx", "jxy", "jyx", "jyy", "det")))


def compose(spark, sf_dir):
    u = _displacement(spark, sf_dir)
    return fields.composed(u, u).select("x", "y", *((F.round(c, 6) + 0.0).alias(c) for c in ("ux", "uy")))


def warp(spark, sf_dir):
    return _rounded(fields.warped(_cells(spark, sf_dir), _displacement(spark, sf_dir)))


def downsample(spark, sf_dir):
    return _rounded(fields.downsample(_cells(spark, sf_dir), 1.0))


def largest_component(spark, sf_dir):
    return fields.largest_component(_cells(spark, sf_dir), F.col("v") > 60).select("x", "y")


def distance(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("v", (F.col("v") > 8).cast("double"))
    return augment.squared_distance_transform(cells).select("x", "y", F.col("d2").cast("long").alias("d2"))


def _masks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells = _cells(spark, sf_dir)
    on = lambda c: cells.select("img", "x", "y", c.cast("double").alias("v"))
    return on(F.col("v") > 50), on((F.col("v") > 45) & (F.col("v") < 97))


def hausdorff(spark, sf_dir):
    return fields.hausdorff95(*_masks(spark, sf_dir)).select(F.round("hd95", 6).alias("hd95"))


def surface_dice(spark, sf_dir):
    return fields.surface_dice(*_masks(spark, sf_dir), 1.0).select(F.round("dice", 8).alias("dice"))


def local_correlation(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    fixed = cells.withColumn("v", F.abs(F.col("v") - 50))
    return _rounded(fields.local_correlation(cells, fixed, 1))


def crop(spark, sf_dir):
    return _rounded(fields.crop_to_multiple(_cells(spark, sf_dir), 8))


def pad(spark, sf_dir):
    return _rounded(fields.pad_to_multiple(_cells(spark, sf_dir), 8, -1.0))


def max_pool(spark, sf_dir):
    out = augment.max_pool(_cells(spark, sf_dir), 2)
    return out.select("px", "py", F.round("v", 6).alias("v"), "x", "y")


def max_unpool(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return _rounded(augment.max_unpool(cells, augment.max_pool(cells, 2)))


def gaussian_noise(spark, sf_dir):
    return augment.gaussian_noise(_cells(spark, sf_dir), "v", 2.0, 5, ["x", "y"]).select("x", "y", (F.round("noisy", 6) + 0.0).alias("v"))


def rician_noise(spark, sf_dir):
    return augment.rician_noise(_cells(spark, sf_dir), "v", 2.0, 5, ["x", "y"]).select("x", "y", (F.round("noisy", 6) + 0.0).alias("v"))


def label_image(spark, sf_dir):
    labels = _cells(spark, sf_dir).select("img", "x", "y", F.floor(F.col("v") / 20).cast("int").alias("label"))
    table = labels.select("label").distinct().select("label", (F.col("label") * 10 + 5.0).alias("mean"), (F.col("label") / 2 + 1.0).alias("std"))
    return _rounded(augment.label_image(labels, table, 9, ["x", "y"]))


def flip(spark, sf_dir):
    return _rounded(augment.random_flip(_cells(spark, sf_dir), 3))


def random_crop(spark, sf_dir):
    return _rounded(augment.random_crop(_cells(spark, sf_dir), 4, 5, 60))


def displaced_centre(spark, sf_dir):
    out = fields.displacement_from_reference(_cells(spark, sf_dir), 3.0, 40.0)
    return out.select((F.round("dx", 6) + 0.0).alias("dx"), (F.round("dy", 6) + 0.0).alias("dy"))


def compactness(spark, sf_dir):
    cells = _cells(spark, sf_dir).select((F.col("x") % 4).alias("region"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), (F.col("v") / 100).alias("w"))
    return fields.compactness(cells, 2.0).select("region", F.round("penalty", 6).alias("penalty"), F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


QUERIES = {
    "sample_nearest": _sampled("nearest"), "sample_linear": _sampled("linear"), "sample_catmull_rom": _sampled("catmull_rom"), "sample_lanczos": _sampled("lanczos"),
    "sample_labels": multi_label, "jacobian": jacobian, "compose_displacement": compose, "spatial_transform": warp, "downsample": downsample,
    "bilateral": _image(lambda c: fields.bilateral(c, 1, 1.0, 20.0)), "susan": _image(lambda c: fields.susan(c, 1.0, 20.0)), "largest_component": largest_component,
    "distance_transform": distance, "hausdorff95": hausdorff, "surface_dice": surface_dice, "local_correlation": local_correlation, "crop_to_multiple": crop,
    "pad_to_multiple": pad, "max_pool": max_pool, "max_unpool": max_unpool, "gaussian_noise": gaussian_noise, "rician_noise": rician_noise, "label_image": label_image,
    "random_flip": flip, "random_crop": random_crop, "displaced_centre": displaced_centre, "compactness": compactness,
    "histogram_shift": _image(lambda c: augment.histogram_shift(c, "v", [0.0, 0.1, -0.05, 0.0])),
}

_C = "WITH c AS (SELECT event_id // 100 AS x, event_id % 100 AS y, value AS v FROM events)"
_V = "(round({}, 6) + 0.0::DOUBLE) AS v"
_POINTS = "p AS (SELECT x * 100 + y AS pid, x + 0.3::DOUBLE AS px, y - 0.4::DOUBLE AS py FROM c)"
_TAPS = {
    "linear": (1, "greatest(1 - abs({d}), 0)"),
    "catmull_rom": (2, "CASE WHEN abs({d}) < 1 THEN 1.5 * pow(abs({d}), 3) - 2.5 * pow({d}, 2) + 1 WHEN abs({d}) < 2 THEN -0.5 * pow(abs({d}), 3) + 2.5 * pow({d}, 2) - 4 * abs({d}) + 2 ELSE 0 END"),
    "lanczos": (3, "CASE WHEN abs({d}) >= 3 THEN 0 WHEN abs({d}) < 1e-9 THEN 1 ELSE 3 * sin(pi() * ({d})) * sin(pi() * ({d}) / 3) / (pi() * pi() * ({d}) * ({d})) END"),
}


def _taps(method: str) -> str:
    reach, w = _TAPS[method]
    wx, wy = w.format(d="(px - x)"), w.format(d="(py - y)")
    scale = f" / sum({wx} * {wy})" if method == "lanczos" else ""
    # all taps of a point count for the scale, also those off the image
    all_taps = f"t AS (SELECT pid, px, py, floor(px)::BIGINT + i AS x, floor(py)::BIGINT + j AS y FROM p, range({1 - reach}, {reach + 1}) a(i), range({1 - reach}, {reach + 1}) b(j))"
    return f"{_C}, {_POINTS}, {all_taps} SELECT pid, {_V.format(f'sum({wx} * {wy} * coalesce(v, 0)){scale}')} FROM t LEFT JOIN c USING (x, y) GROUP BY 1"


_U = f"{_C}, u AS (SELECT x, y, v / 97 - 0.4 AS ux, (v % 7) / 11 AS uy FROM c), b AS (SELECT max(x) AS mx, max(y) AS my FROM c)"
_WARP = "{0}, p AS (SELECT u.x AS ox, u.y AS oy, ux, uy, least(greatest(u.x + ux, 0), mx) AS px, least(greatest(u.y + uy, 0), my) AS py FROM u, b), t AS (SELECT *, least(floor(px)::BIGINT + i, mx) AS x, least(floor(py)::BIGINT + j, my) AS y, (CASE i WHEN 0 THEN 1 - (px - floor(px)) ELSE px - floor(px) END) * (CASE j WHEN 0 THEN 1 - (py - floor(py)) ELSE py - floor(py) END) AS w FROM p, b, range(2) a(i), range(2) d(j))"
_BI = f"{_C}, w AS (SELECT a.x, a.y, b.v, exp(-0.5 * ((pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 1.0 + pow((a.v - b.v) / 20.0, 2))) AS w FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1), s AS (SELECT x, y, sum(w * v) / sum(w) AS v FROM w GROUP BY 1, 2)"
_HD = f"{_C}, m AS (SELECT x, y, v > 50 AS p, v > 45 AND v < 97 AS t FROM c), e AS (SELECT a.x, a.y, a.p AND count(*) FILTER (WHERE b.p) < 4 AS p, a.t AND count(*) FILTER (WHERE b.t) < 4 AS t FROM m a LEFT JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.x, a.y, a.p, a.t), f AS (SELECT a.x, a.y, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM e a, e b WHERE a.p AND b.t GROUP BY 1, 2), g AS (SELECT a.x, a.y, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM e a, e b WHERE a.t AND b.p GROUP BY 1, 2)"
_N1 = "sqrt(-2 * ln((('0x' || substr(md5('{s}:' || x || ':' || y), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * (('0x' || substr(md5('{t}:' || x || ':' || y), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


def _normal(seed: int) -> str:
    return _N1.format(s=seed, t=seed + 1)


_DRAW = "(('0x' || substr(md5('{}:0'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296"
_REFLECT = "n AS (SELECT a.x, a.y, b.v AS m, abs(b.v - 50) AS f FROM (SELECT x, y, CASE WHEN x + i < 0 THEN -1 - (x + i) WHEN x + i > mx THEN 2 * mx + 1 - (x + i) ELSE x + i END AS bx, CASE WHEN y + j < 0 THEN -1 - (y + j) WHEN y + j > my THEN 2 * my + 1 - (y + j) ELSE y + j END AS by_ FROM c, b, range(-1, 2) r(i), range(-1, 2) s(j)) a JOIN c b ON b.x = a.bx AND b.y = a.by_)"

ORACLE_SQL = {
    "sample_nearest": f"{_C}, {_POINTS} SELECT pid, {_V.format('coalesce(v, 0)')} FROM p LEFT JOIN c ON c.x = floor(px + 0.5) AND c.y = floor(py + 0.5)",
    "sample_linear": _taps("linear"), "sample_catmull_rom": _taps("catmull_rom"), "sample_lanczos": _taps("lanczos"),
    "sample_labels": f"{_C}, {_POINTS}, t AS (SELECT pid, floor(v / 20)::BIGINT AS label, sum((1 - abs(px - x)) * (1 - abs(py - y))) AS w FROM p JOIN c ON abs(px - x) < 1 AND abs(py - y) < 1 GROUP BY 1, 2) SELECT pid, label FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(w, 9) DESC, label) AS k FROM t) WHERE k = 1",
    "jacobian": f"{_U}, k AS (SELECT u.*, least(x + 1, mx) AS xr, greatest(x - 1, 0) AS xl, least(y + 1, my) AS yd, greatest(y - 1, 0) AS ye FROM u, b), j AS (SELECT u.x, u.y, (r.ux - l.ux) / 2 AS gxx, (r.uy - l.uy) / 2 AS gyx, (d.ux - e.ux) / 2 AS gxy, (d.uy - e.uy) / 2 AS gyy FROM k u JOIN u r ON r.x = u.xr AND r.y = u.y JOIN u l ON l.x = u.xl AND l.y = u.y JOIN u d ON d.x = u.x AND d.y = u.yd JOIN u e ON e.x = u.x AND e.y = u.ye) SELECT x, y, " + ", ".join(f"(round({e}, 7) + 0.0::DOUBLE) AS {n}" for e, n in (("1 + gxx", "jxx"), ("gxy", "jxy"), ("gyx", "jyx"), ("1 + gyy", "jyy"), ("(1 + gxx) * (1 + gyy) - gxy * gyx", "det"))) + " FROM j",
    "compose_displacement": _WARP.format(_U) + ", k AS (SELECT ox, oy, t.ux AS ix, t.uy AS iy, u.ux, u.uy, w FROM t JOIN u USING (x, y)) SELECT ox AS x, oy AS y, (round(any_value(ix) + sum(w * ux), 6) + 0.0::DOUBLE) AS ux, (round(any_value(iy) + sum(w * uy), 6) + 0.0::DOUBLE) AS uy FROM k GROUP BY 1, 2",
    "spatial_transform": _WARP.format(_U) + f" SELECT ox AS x, oy AS y, {_V.format('sum(w * v)')} FROM t JOIN c USING (x, y) GROUP BY 1, 2",
    "downsample": f"{_C}, d AS (SELECT a.x, a.y, sum(b.v * exp(-0.5 * pow(a.x - b.x, 2))) / sum(exp(-0.5 * pow(a.x - b.x, 2))) AS v FROM c a JOIN c b ON a.y = b.y AND abs(a.x - b.x) <= 4 GROUP BY 1, 2), e AS (SELECT a.x, a.y, sum(b.v * exp(-0.5 * pow(a.y - b.y, 2))) / sum(exp(-0.5 * pow(a.y - b.y, 2))) AS v FROM d a JOIN d b ON a.x = b.x AND abs(a.y - b.y) <= 4 GROUP BY 1, 2) SELECT x // 2 AS x, y // 2 AS y, {_V.format('v')} FROM e WHERE x % 2 = 0 AND y % 2 = 0",
    "bilateral": f"{_BI} SELECT x, y, {_V.format('v')} FROM s",
    "susan": f"{_BI} SELECT a.x, a.y, round(quantile_cont(b.v, 0.5), 6) AS v FROM s a JOIN s b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2",
    "largest_component": f"{_C.replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT x * 100 + y AS id, x, y FROM c WHERE v > 60), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), r AS (SELECT id, id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(root) AS root FROM r GROUP BY 1), g AS (SELECT root, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, root LIMIT 1) SELECT x, y FROM m JOIN l USING (id) JOIN g USING (root)",
    "distance_transform": f"{_C}, z AS (SELECT x, y FROM c WHERE v <= 8) SELECT c.x, c.y, min((c.x - z.x) * (c.x - z.x) + (c.y - z.y) * (c.y - z.y)) AS d2 FROM c, z GROUP BY 1, 2",
    "hausdorff95": f"{_HD} SELECT round(greatest((SELECT quantile_cont(d, 0.95) FROM f), (SELECT quantile_cont(d, 0.95) FROM g)), 6) AS hd95",
    "surface_dice": f"{_HD} SELECT round(((SELECT count(*) FROM f WHERE d <= 1) + (SELECT count(*) FROM g WHERE d <= 1))::DOUBLE / ((SELECT count(*) FROM f) + (SELECT count(*) FROM g)), 8) AS dice",
    "local_correlation": f"{_C}, b AS (SELECT max(x) AS mx, max(y) AS my FROM c), {_REFLECT}, s AS (SELECT x, y, sum(m * f) - sum(m) * sum(f) / 9 AS k, sum(m * m) - sum(m) * sum(m) / 9 AS p, sum(f * f) - sum(f) * sum(f) / 9 AS q FROM n GROUP BY 1, 2) SELECT x, y, {_V.format('k * k / (p * q + 1e-5)')} FROM s",
    "crop_to_multiple": f"{_C}, b AS (SELECT (max(x) + 1) // 8 * 8 AS h, (max(y) + 1) // 8 * 8 AS w, (max(x) + 1) % 8 // 2 AS i, (max(y) + 1) % 8 // 2 AS j FROM c) SELECT x - i AS x, y - j AS y, round(v, 6) AS v FROM c, b WHERE x >= i AND x < i + h AND y >= j AND y < j + w",
    "pad_to_multiple": f"{_C}, b AS (SELECT (max(x) + 8) // 8 * 8 AS h, (max(y) + 8) // 8 * 8 AS w, max(x) + 1 AS n, max(y) + 1 AS m FROM c) SELECT r.x::BIGINT AS x, s.y::BIGINT AS y, round(coalesce(v, -1), 6) AS v FROM b, range(h) r(x), range(w) s(y) LEFT JOIN c ON c.x = r.x - (h - n) // 2 AND c.y = s.y - (w - m) // 2",
    "max_pool": f"{_C} SELECT px, py, round(v, 6) AS v, x, y FROM (SELECT x // 2 AS px, y // 2 AS py, v, x, y, row_number() OVER (PARTITION BY x // 2, y // 2 ORDER BY v DESC, x, y) AS k FROM c) WHERE k = 1",
    "max_unpool": f"{_C} SELECT x, y, round(CASE WHEN k = 1 THEN v ELSE 0 END, 6) AS v FROM (SELECT v, x, y, row_number() OVER (PARTITION BY x // 2, y // 2 ORDER BY v DESC, x, y) AS k FROM c)",
    "gaussian_noise": f"{_C} SELECT x, y, {_V.format(f'v + 2 * {_normal(5)}')} FROM c",
    "rician_noise": f"{_C} SELECT x, y, {_V.format(f'sqrt(pow(v + 2 * {_normal(5)}, 2) + pow(2 * {_normal(12)}, 2))')} FROM c",
    "label_image": f"{_C} SELECT x, y, {_V.format(f'greatest(floor(v / 20) * 10 + 5 + (floor(v / 20) / 2 + 1) * {_normal(9)}, 0)')} FROM c",
    "random_flip": f"{_C}, b AS (SELECT max(x) AS mx, max(y) AS my FROM c) SELECT CASE WHEN {_DRAW.format(3)} < 0.5 THEN mx - x ELSE x END AS x, CASE WHEN {_DRAW.format(4)} < 0.5 THEN my - y ELSE y END AS y, round(v, 6) AS v FROM c, b",
    "random_crop": f"{_C}, b AS (SELECT floor({_DRAW.format(4)} * (max(x) + 2 - 5))::BIGINT AS i, floor({_DRAW.format(5)} * (max(y) + 2 - 60))::BIGINT AS j FROM c) SELECT x - i AS x, y - j AS y, round(v, 6) AS v FROM c, b WHERE x >= i AND x < i + 5 AND y >= j AND y < j + 60",
    "displaced_centre": f"{_C} SELECT (round(sum(x * v) / greatest(sum(v), 1e-12) - 3, 6) + 0.0::DOUBLE) AS dx, (round(sum(y * v) / greatest(sum(v), 1e-12) - 40, 6) + 0.0::DOUBLE) AS dy FROM c",
    "compactness": f"{_C}, r AS (SELECT x % 4 AS region, x, y, v / 100 AS w FROM c), m AS (SELECT region, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM r GROUP BY 1) SELECT region, round(avg(w * greatest(sqrt(pow(x - mx, 2) + pow(y - my, 2)) - 2, 0)), 6) AS penalty, round(any_value(mx), 6) AS mx, round(any_value(my), 6) AS my FROM r JOIN m USING (region) GROUP BY 1",
    "histogram_shift": f"{_C}, b AS (SELECT min(v) AS lo, max(v) - min(v) AS s FROM c), k AS (SELECT *, least(floor((v - lo) / s * 3), 2) AS n FROM c, b) SELECT x, y, {_V.format('lo + s * (CASE n WHEN 0 THEN (v - lo) / s * (1.0::DOUBLE / 3 + 0.1) * 3 WHEN 1 THEN 1.0::DOUBLE / 3 + 0.1 + ((v - lo) / s * 3 - 1) * (1.0::DOUBLE / 3 - 0.15) ELSE 2.0::DOUBLE / 3 - 0.05 + ((v - lo) / s * 3 - 2) * (1.0::DOUBLE / 3 + 0.05) END)')} FROM k",
}
