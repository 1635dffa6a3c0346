"""Level set queries. The volume has a slab of 10 x 10 cells for every 100 events, and a layer outside around all cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import isosurface, surface
from quern.sources.tables import read

LEVEL, OUTSIDE = 50.0, 100.0


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = (F.floor(e / 100).alias("x"), F.floor(e % 100 / 10).alias("y"), (e % 10).alias("z"))
    return isosurface.padded(read(spark, sf_dir, "events").select(*at, F.col("value").alias("v")), OUTSIDE)


def marching_cubes(spark, sf_dir):
    vertices, _ = isosurface.marching_cubes(_volume(spark, sf_dir), LEVEL)
    return vertices.select(*(F.round(c, 6).alias(c) for c in "xyz"))


def isosurface_faces(spark, sf_dir):
    """Faces whose vertices lie between two slabs' places, by the first of them."""
    vertices, faces = isosurface.marching_cubes(_volume(spark, sf_dir), LEVEL)
    ends = faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(vertices, "vid")
    slabs = ends.groupBy("fid").agg(F.floor(F.avg("x")).alias("x"))
    return slabs.groupBy("x").agg(F.count("*").alias("faces"))


def isosurface_euler(spark, sf_dir):
    _, faces = isosurface.marching_cubes(_volume(spark, sf_dir), LEVEL)
    return surface.euler_characteristic(faces)


QUERIES = {"marching_cubes": marching_cubes, "isosurface_faces": isosurface_faces, "isosurface_euler": isosurface_euler}

_C = f"WITH c AS (SELECT event_id // 100 AS x, event_id % 100 // 10 AS y, event_id % 10 AS z, value AS v FROM events), o(d) AS (VALUES (-1), (0), (1)), n AS (SELECT DISTINCT x + i.d AS x, y + j.d AS y, z + k.d AS z FROM c, o i, o j, o k), p AS MATERIALIZED (SELECT x, y, z, coalesce(v, {OUTSIDE})::DOUBLE AS v FROM n LEFT JOIN c USING (x, y, z)), l AS MATERIALIZED (SELECT {LEVEL}::DOUBLE + CASE WHEN bool_or(v = {LEVEL}) THEN 0.00001::DOUBLE * greatest(1, max(abs(v - {LEVEL}))) ELSE 0 END AS lev FROM p), w AS MATERIALIZED (SELECT p.*, v < lev AS inside FROM p, l)"
_EDGES = "s(dx, dy, dz) AS (VALUES (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)), r AS MATERIALIZED (SELECT w.*, dx, dy, dz, x + dx AS qx, y + dy AS qy, z + dz AS qz FROM w, s), e AS (SELECT r.x, r.y, r.z, dx, dy, dz, (lev - r.v) / (b.v - r.v) AS t FROM r JOIN w b ON b.x = qx AND b.y = qy AND b.z = qz, l WHERE r.inside <> b.inside)"
_TETS = "u(bx, b_y, bz, cx, cy, cz) AS (VALUES (0, 0, 1, 0, 1, 1), (0, 0, 1, 1, 0, 1), (0, 1, 0, 0, 1, 1), (0, 1, 0, 1, 1, 0), (1, 0, 0, 1, 0, 1), (1, 0, 0, 1, 1, 0)), k AS MATERIALIZED (SELECT x, x + bx AS x1, y + b_y AS y1, z + bz AS z1, x + cx AS x2, y + cy AS y2, z + cz AS z2, x + 1 AS x3, y + 1 AS y3, z + 1 AS z3, inside FROM w, u), t AS (SELECT k.x, k.inside::INT + b.inside::INT + c.inside::INT + d.inside::INT AS inside FROM k JOIN w b ON b.x = x1 AND b.y = y1 AND b.z = z1 JOIN w c ON c.x = x2 AND c.y = y2 AND c.z = z2 JOIN w d ON d.x = x3 AND d.y = y3 AND d.z = z3), f AS (SELECT x, CASE inside WHEN 2 THEN 2 ELSE 1 END AS n FROM t WHERE inside BETWEEN 1 AND 3)"

ORACLE_SQL = {
    "marching_cubes": f"{_C}, {_EDGES} SELECT round(x + t * dx, 6) AS x, round(y + t * dy, 6) AS y, round(z + t * dz, 6) AS z FROM e",
    "isosurface_faces": f"{_C}, {_TETS} SELECT x, sum(n)::BIGINT AS faces FROM f GROUP BY 1",
    "isosurface_euler": f"{_C}, {_EDGES}, {_TETS} SELECT (SELECT count(*) FROM e) - (SELECT sum(n) // 2 FROM f)::BIGINT AS chi",
}
