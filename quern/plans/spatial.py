"""Image queries. The image has a row of 100 cells for every 100 events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import grid
from quern.sources.tables import read


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("e"), "value")
    return rows.select(F.lit(0).alias("img"), F.floor(F.col("e") / 100).alias("x"), (F.col("e") % 100).alias("y"), F.col("value").alias("v"))


def _image(op, digits: int = 6):
    return lambda spark, sf_dir: op(_cells(spark, sf_dir)).select("x", "y", F.round("v", digits).alias("v"))


def bounding_box(spark, sf_dir):
    return grid.bounding_box(_cells(spark, sf_dir), 95.0).select(*(F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")))


def centre_of_mass(spark, sf_dir):
    return grid.centre_of_mass(_cells(spark, sf_dir)).select(F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def resample(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    points = cells.select("img", (F.col("x") * 100 + F.col("y")).alias("pid"), (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"))
    return grid.resample(cells, points).select("pid", F.round("v", 6).alias("v"))


def component_sizes(spark, sf_dir):
    parts = grid.labelled(_cells(spark, sf_dir), F.col("v") > 60).filter("label > 0")
    return parts.groupBy("label").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("parts"))


def tfce(spark, sf_dir):
    return grid.tfce(_cells(spark, sf_dir), 4).select("x", "y", F.round("v", 4).alias("v"))


QUERIES = {
    "image_dilate": _image(grid.dilate), "image_erode": _image(grid.erode), "image_median": _image(grid.median), "image_laplacian": _image(grid.laplacian, 5),
    "image_stencil": _image(lambda c: grid.stencil(c, [(0, 1, 0.5), (1, 0, 0.25), (0, 0, -1.0)])), "image_gaussian": _image(lambda c: grid.gaussian(c, 1.0, 2.0)),
    "bounding_box": bounding_box, "centre_of_mass": centre_of_mass, "resample": resample, "component_sizes": component_sizes, "tfce": tfce,
}

_C = "WITH c AS (SELECT event_id // 100 AS x, event_id % 100 AS y, value AS v FROM events)"
_NEAR = "SELECT a.x, a.y, round({}, 6) AS v FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2"
_TAPS = "(VALUES (0, 1, 0.5), (1, 0, 0.25), (0, 0, -1.0)) o(dx, dy, w)"

ORACLE_SQL = {
    "image_dilate": f"{_C} {_NEAR.format('max(b.v)')}", "image_erode": f"{_C} {_NEAR.format('min(b.v)')}", "image_median": f"{_C} {_NEAR.format('quantile_cont(b.v, 0.5)')}",
    "image_laplacian": f"{_C} SELECT a.x, a.y, round(coalesce(sum(b.v), 0) - count(b.v) * any_value(a.v), 5) AS v FROM c a LEFT JOIN c b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2",
    "image_stencil": f"{_C} SELECT a.x, a.y, round(sum(b.v * w::DOUBLE), 6) AS v FROM c a, c b, {_TAPS} WHERE b.x = a.x + dx AND b.y = a.y + dy GROUP BY 1, 2",
    "image_gaussian": f"{_C}, d AS (SELECT a.x, a.y, sum(b.v * exp(-0.5 * pow(a.x - b.x, 2))) / sum(exp(-0.5 * pow(a.x - b.x, 2))) AS v FROM c a JOIN c b ON a.y = b.y AND abs(a.x - b.x) <= 2 GROUP BY 1, 2) SELECT a.x, a.y, round(sum(b.v * exp(-0.5 * pow(a.y - b.y, 2))) / sum(exp(-0.5 * pow(a.y - b.y, 2))), 6) AS v FROM d a JOIN d b ON a.x = b.x AND abs(a.y - b.y) <= 2 GROUP BY 1, 2",
    "bounding_box": f"{_C} SELECT coalesce(min(x) FILTER (WHERE v > 95), 0) AS x0, coalesce(max(x) FILTER (WHERE v > 95) + 1, 0) AS x1, coalesce(min(y) FILTER (WHERE v > 95), 0) AS y0, coalesce(max(y) FILTER (WHERE v > 95) + 1, 0) AS y1 FROM c",
    "centre_of_mass": f"{_C} SELECT round(sum(x * v) / greatest(sum(v), 1e-12), 6) AS cx, round(sum(y * v) / greatest(sum(v), 1e-12), 6) AS cy FROM c",
    "resample": f"{_C} SELECT a.x * 100 + a.y AS pid, round(sum(b.v * (CASE WHEN b.x = a.x THEN 0.75 ELSE 0.25 END) * 0.5::DOUBLE), 6) AS v FROM c a JOIN c b ON b.x - a.x IN (0, 1) AND b.y - a.y IN (0, 1) GROUP BY 1",
    "component_sizes": f"{_C.replace('WITH', 'WITH RECURSIVE')}, m AS (SELECT x * 100 + y AS id, x, y FROM c WHERE v > 60), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1), r AS (SELECT id, id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(root) AS root FROM r GROUP BY 1), s AS (SELECT root, count(*) AS n FROM l GROUP BY 1) SELECT n, count(*) AS parts FROM s GROUP BY 1",
}
