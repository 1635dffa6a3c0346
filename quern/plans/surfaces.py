"""Mesh queries on a height field: a vertex for each event, two triangles for each cell of four neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import mesh, surface
from quern.sources.tables import read

WIDTH = 100


def vertices(spark: SparkSession, sf_dir: str, height: float = 25.0) -> DataFrame:
    e = F.col("event_id")
    at = (F.floor(e / WIDTH).cast("double").alias("x"), (e % WIDTH).cast("double").alias("y"))
    return read(spark, sf_dir, "events").select(e.alias("vid"), *at, (F.col("value") / height).alias("z"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("e"))
    last = rows.agg(F.max("e")).first()[0]
    e = F.col("e")
    lower = F.struct((2 * e).alias("fid"), e.alias("a"), (e + 1).alias("b"), (e + WIDTH).alias("c"))
    upper = F.struct((2 * e + 1).alias("fid"), (e + 1).alias("a"), (e + WIDTH + 1).alias("b"), (e + WIDTH).alias("c"))
    cells = rows.filter((e % WIDTH < WIDTH - 1) & (e + WIDTH + 1 <= last))
    return cells.select(F.explode(F.array(lower, upper)).alias("f")).select("f.*")


def _both(op, **digits):
    """A query of an operator on vertices and faces, columns rounded to so many digits."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(vertices(spark, sf_dir), faces(spark, sf_dir))
        return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns))

    return query


def _topology(op):
    return lambda spark, sf_dir: op(faces(spark, sf_dir))


def _warped(op, **digits):
    """A query on the surface and the same at half its height."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(vertices(spark, sf_dir), vertices(spark, sf_dir, 50.0), faces(spark, sf_dir))
        return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns))

    return query


def mesh_k_ring(spark, sf_dir):
    return mesh.k_ring(faces(spark, sf_dir), 2)


def _seen(spark, sf_dir):
    """The surface from a point above it, so that solid angles are of one sign and small."""
    return vertices(spark, sf_dir).withColumn("z", F.col("z") - 40.0)


def spherical_areas(spark, sf_dir):
    return surface.spherical_areas(_seen(spark, sf_dir), faces(spark, sf_dir)).select("fid", F.round("area", 8).alias("area"))


def is_bijective(spark, sf_dir):
    return surface.is_bijective(_seen(spark, sf_dir), faces(spark, sf_dir)).select(F.col("bijective").cast("int").alias("bijective"))


def parcel_centroids(spark, sf_dir):
    rows = vertices(spark, sf_dir).withColumn("parcel", F.floor(F.col("x") / 5) * 20 + F.floor(F.col("y") / 5)).withColumn("x", F.col("x") + 1)
    return surface.parcel_centroids(rows, "parcel").select("parcel", *(F.round(c, 8).alias(c) for c in "xyz"))


def _children(spark, sf_dir):
    rows = vertices(spark, sf_dir)
    return rows.select((F.floor(F.col("x") / 2) * 50 + F.floor(F.col("y") / 2)).alias("coarse"), "vid"), rows.select("vid", F.col("z").alias("v"))


def mesh_pool_mean(spark, sf_dir):
    return surface.pooled_mean(*_children(spark, sf_dir)).select("coarse", F.round("v", 8).alias("v"))


def mesh_pool_max(spark, sf_dir):
    return surface.pooled_max(*_children(spark, sf_dir)).select("coarse", F.round("v", 8).alias("v"), "vid")


def mesh_unpool_max(spark, sf_dir):
    pooled = surface.pooled_max(*_children(spark, sf_dir))
    return surface.unpooled_max(pooled, vertices(spark, sf_dir)).select("vid", F.round("v", 8).alias("v"))


QUERIES = {
    "face_normals": _both(mesh.face_normals, nx=7, ny=7, nz=7), "face_areas": _both(mesh.face_areas, area=7),
    "vertex_normals": _both(mesh.vertex_normals, nx=6, ny=6, nz=6), "vertex_areas": _both(mesh.vertex_areas, area=6),
    "vertex_areas_barycentric": _both(lambda v, f: mesh.vertex_areas(v, f, "barycentric"), area=6), "mesh_mass_matrix": _both(surface.mass_matrix, value=6),
    "cotangent_laplacian": _both(mesh.cotangent_laplacian, value=6), "mesh_smooth": _both(mesh.laplacian_smooth, x=6, y=6, z=6),
    "mesh_edges": _topology(mesh.edge_face_adjacency), "mesh_k_ring": mesh_k_ring,
    "gaussian_curvature": _both(surface.gaussian_curvature, k=5), "mean_curvature": _both(surface.mean_curvature, h=5),
    "principal_curvatures": _both(surface.principal_curvatures, k1=4, k2=4), "areal_distortion": _warped(surface.areal_distortion, distortion=6),
    "strain_distortion": _warped(surface.strain_distortion, s1=6, s2=6), "mesh_gradient": _topology(surface.gradient), "mesh_curl": _topology(surface.curl),
    "mesh_star_0": _both(lambda v, f: surface.star(v, f, 0), value=6), "mesh_star_1": _both(lambda v, f: surface.star(v, f, 1), value=6),
    "mesh_star_2": _both(lambda v, f: surface.star(v, f, 2), value=6), "mesh_divergence": _both(surface.divergence, value=6),
    "euler_characteristic": _topology(surface.euler_characteristic), "genus": _topology(surface.genus), "spherical_areas": spherical_areas,
    "is_bijective": is_bijective, "parcel_centroids": parcel_centroids, "mesh_pool_mean": mesh_pool_mean, "mesh_pool_max": mesh_pool_max,
    "mesh_unpool_max": mesh_unpool_max,
}



def _r(expression: str, digits: int, name: str) -> str:
    return f"(round({expression}, {digits}) + 0.0::DOUBLE) AS {name}"


_V = "v AS (SELECT event_id AS vid, (event_id // 100)::DOUBLE AS x, (event_id % 100)::DOUBLE AS y, value / {h} AS z FROM events)"
_FACES = "g AS (SELECT event_id AS e FROM events WHERE event_id % 100 < 99 AND event_id + 101 <= (SELECT max(event_id) FROM events)), f AS (SELECT 2 * e AS fid, e AS a, e + 1 AS b, e + 100 AS c FROM g UNION ALL SELECT 2 * e + 1, e + 1, e + 101, e + 100 FROM g)"
#: Corners of faces: o with the two others in the order of the face, and what the angle at o gives.
_T = (
    "r{n} AS (SELECT fid, 0 AS s, a AS o, b AS p, c AS q FROM f UNION ALL SELECT fid, 1, b, c, a FROM f UNION ALL SELECT fid, 2, c, a, b FROM f), "
    "s{n} AS (SELECT r{n}.*, pp.x - oo.x AS ux, pp.y - oo.y AS uy, pp.z - oo.z AS uz, qq.x - oo.x AS wx, qq.y - oo.y AS wy, qq.z - oo.z AS wz FROM r{n} JOIN v{n} oo ON oo.vid = o JOIN v{n} pp ON pp.vid = p JOIN v{n} qq ON qq.vid = q), "
    "n{n} AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz, ux * wx + uy * wy + uz * wz AS d, (ux - wx) * (ux - wx) + (uy - wy) * (uy - wy) + (uz - wz) * (uz - wz) AS l FROM s{n}), "
    "k{n} AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS m, d / greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-12) AS cot FROM n{n}), "
    "t{n} AS (SELECT *, CASE WHEN min(cot) OVER (PARTITION BY fid) < 0 THEN CASE WHEN cot < 0 THEN m / 4 ELSE m / 8 END ELSE (sum(l * cot) OVER (PARTITION BY fid) - l * cot) / 8 END AS share FROM k{n}), "
    "area{n} AS (SELECT o AS vid, sum(share) AS area, sum(m) / 6 AS third FROM t{n} GROUP BY 1)"
)
_M = f"WITH {_V.format(h='25').replace('v AS', 'v0 AS')}, {_FACES}, {_T.format(n=0)}"
_HALF = f"{_M}, {_V.format(h='50').replace('v AS', 'v1 AS')}, {_T.format(n=1)}"
_TOP = f"WITH {_FACES}, e AS (SELECT DISTINCT least(s, t) AS p, greatest(s, t) AS q FROM (SELECT a AS s, b AS t FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f))"
_LAP = "h AS (SELECT p, q, cot / 2 AS w FROM t0 UNION ALL SELECT q, p, cot / 2 FROM t0), lap AS (SELECT p AS src, q AS dst, -sum(w) AS value FROM h GROUP BY 1, 2 UNION ALL SELECT p, p, sum(w) FROM h GROUP BY 1)"
_NORMAL = "nv AS (SELECT o AS vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM t0 GROUP BY 1)"
_UNIT = "greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-12)"
_MEAN = f"{_LAP}, {_NORMAL}, b AS (SELECT src AS vid, sum(value * x) AS lx, sum(value * y) AS ly, sum(value * z) AS lz FROM lap JOIN v0 ON v0.vid = dst GROUP BY 1), mean AS (SELECT vid, CASE WHEN abs(lx * nx + ly * ny + lz * nz) <= 1e-9 * sqrt(lx * lx + ly * ly + lz * lz) * sqrt(nx * nx + ny * ny + nz * nz) THEN 0 ELSE sign(lx * nx + ly * ny + lz * nz) * sqrt(lx * lx + ly * ly + lz * lz) / 2 / greatest(area, 1e-12) END AS h FROM b JOIN nv USING (vid) JOIN area0 USING (vid))"
_GAUSS = "gauss AS (SELECT o AS vid, (2 * pi() - sum(atan2(m, d))) / greatest(any_value(area), 1e-12) AS k FROM t0 JOIN area0 ON vid = o GROUP BY 1)"
_STAR1 = "star1 AS (SELECT least(p, q) AS p, greatest(p, q) AS q, sum(cot) / 2 AS w FROM t0 GROUP BY 1, 2)"
_SOLID = f"WITH {_V.format(h='25 - 40')}, {_FACES}, c AS (SELECT fid, i.x AS ax, i.y AS ay, i.z AS az, j.x AS bx, j.y AS by_, j.z AS bz, k.x AS cx, k.y AS cy, k.z AS cz FROM f JOIN v i ON i.vid = a JOIN v j ON j.vid = b JOIN v k ON k.vid = c), l AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb, sqrt(cx * cx + cy * cy + cz * cz) AS lc FROM c), s AS (SELECT fid, 2 * atan2(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx), la * lb * lc + (ax * bx + ay * by_ + az * bz) * lc + (bx * cx + by_ * cy + bz * cz) * la + (cx * ax + cy * ay + cz * az) * lb) AS area FROM l)"
_POOL = f"WITH {_V.format(h='25')}, c AS (SELECT (floor(x / 2) * 50 + floor(y / 2))::BIGINT AS coarse, vid, z AS v FROM v), m AS (SELECT coarse, max(v) AS v, min(vid) FILTER (WHERE v = top) AS vid FROM (SELECT *, max(v) OVER (PARTITION BY coarse) AS top FROM c) GROUP BY 1)"
_GRAD = "d AS (SELECT p, q, p AS vid, -1.0::DOUBLE AS value FROM e UNION ALL SELECT p, q, q, 1.0::DOUBLE FROM e)"

ORACLE_SQL = {
    "face_normals": f"{_M} SELECT fid, {_r(f'nx / {_UNIT}', 7, 'nx')}, {_r(f'ny / {_UNIT}', 7, 'ny')}, {_r(f'nz / {_UNIT}', 7, 'nz')} FROM t0 WHERE s = 0",
    "face_areas": f"{_M} SELECT fid, round(m / 2, 7) AS area FROM t0 WHERE s = 0",
    "vertex_normals": f"{_M}, {_NORMAL} SELECT vid, {_r(f'nx / {_UNIT}', 6, 'nx')}, {_r(f'ny / {_UNIT}', 6, 'ny')}, {_r(f'nz / {_UNIT}', 6, 'nz')} FROM nv",
    "vertex_areas": f"{_M} SELECT vid, round(area, 6) AS area FROM area0", "vertex_areas_barycentric": f"{_M} SELECT vid, round(third, 6) AS area FROM area0",
    "mesh_mass_matrix": f"{_M} SELECT vid AS src, vid AS dst, round(area, 6) AS value FROM area0",
    "cotangent_laplacian": f"{_M}, {_LAP} SELECT src, dst, {_r('value', 6, 'value')} FROM lap",
    "mesh_smooth": f"{_M}, w AS (SELECT o, p FROM t0 UNION ALL SELECT o, q FROM t0), m AS (SELECT o AS vid, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM w JOIN v0 ON v0.vid = p GROUP BY 1) SELECT vid, {_r('0.5 * x + 0.5 * coalesce(mx, x)', 6, 'x')}, {_r('0.5 * y + 0.5 * coalesce(my, y)', 6, 'y')}, {_r('0.5 * z + 0.5 * coalesce(mz, z)', 6, 'z')} FROM v0 LEFT JOIN m USING (vid)",
    "mesh_edges": f"WITH {_FACES}, e AS (SELECT fid, least(s, t) AS p, greatest(s, t) AS q FROM (SELECT fid, a AS s, b AS t FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f)) SELECT x.fid, y.fid AS other FROM e x JOIN e y USING (p, q) WHERE x.fid < y.fid",
    "mesh_k_ring": f"{_TOP}, o AS (SELECT p AS src, q AS dst FROM e UNION ALL SELECT q, p FROM e), h AS (SELECT src, dst, 1 AS hops FROM o UNION ALL SELECT x.src, y.dst, 2 FROM o x JOIN o y ON y.src = x.dst WHERE y.dst <> x.src) SELECT src, dst, min(hops)::INT AS hops FROM h GROUP BY 1, 2",
    "gaussian_curvature": f"{_M}, {_GAUSS} SELECT vid, {_r('k', 5, 'k')} FROM gauss", "mean_curvature": f"{_M}, {_MEAN} SELECT vid, {_r('h', 5, 'h')} FROM mean",
    "principal_curvatures": f"{_M}, {_MEAN}, {_GAUSS} SELECT vid, {_r('h + sqrt(greatest(h * h - k, 0))', 4, 'k1')}, {_r('h - sqrt(greatest(h * h - k, 0))', 4, 'k2')} FROM mean JOIN gauss USING (vid)",
    "areal_distortion": f"{_HALF} SELECT vid, {_r('log2(greatest(y.area, 1e-12) / greatest(x.area, 1e-12))', 6, 'distortion')} FROM area0 x JOIN area1 y USING (vid)",
    "strain_distortion": f"{_HALF}, w AS (SELECT x.fid, x.ux * x.ux + x.uy * x.uy + x.uz * x.uz AS g11, x.d AS g12, x.wx * x.wx + x.wy * x.wy + x.wz * x.wz AS g22, y.ux * y.ux + y.uy * y.uy + y.uz * y.uz AS w11, y.d AS w12, y.wx * y.wx + y.wy * y.wy + y.wz * y.wz AS w22 FROM t0 x JOIN t1 y USING (fid, s) WHERE s = 0), tr AS (SELECT fid, (g22 * w11 - 2 * g12 * w12 + g11 * w22) / greatest(g11 * g22 - g12 * g12, 1e-12) AS t, (w11 * w22 - w12 * w12) / greatest(g11 * g22 - g12 * g12, 1e-12) AS d FROM w), z AS (SELECT fid, t, sqrt(greatest(t * t - 4 * d, 1e-12)) AS gap FROM tr) SELECT fid, round(sqrt(greatest((t + gap) / 2, 0)), 6) AS s1, round(sqrt(greatest((t - gap) / 2, 0)), 6) AS s2 FROM z",
    "mesh_gradient": f"{_TOP}, {_GRAD} SELECT * FROM d",
    "mesh_curl": f"WITH {_FACES} SELECT fid, least(s, t) AS p, greatest(s, t) AS q, CASE WHEN s < t THEN 1.0 ELSE -1.0 END::DOUBLE AS value FROM (SELECT fid, a AS s, b AS t FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f)",
    "mesh_star_0": f"{_M} SELECT vid, round(third, 6) AS value FROM area0", "mesh_star_1": f"{_M}, {_STAR1} SELECT p, q, {_r('w', 6, 'value')} FROM star1",
    "mesh_star_2": f"{_M} SELECT fid, round(2 / m, 6) AS value FROM t0 WHERE s = 0",
    "mesh_divergence": f"{_M}, {_STAR1}, e AS (SELECT p, q FROM star1), {_GRAD} SELECT vid, p, q, {_r('value * w / third', 6, 'value')} FROM d JOIN star1 USING (p, q) JOIN area0 USING (vid)",
    "euler_characteristic": f"{_TOP} SELECT (SELECT count(DISTINCT o) FROM (SELECT a AS o FROM f UNION ALL SELECT b FROM f UNION ALL SELECT c FROM f)) - (SELECT count(*) FROM e) + (SELECT count(*) FROM f) AS chi",
    "genus": f"{_TOP}, x AS (SELECT (SELECT count(DISTINCT o) FROM (SELECT a AS o FROM f UNION ALL SELECT b FROM f UNION ALL SELECT c FROM f)) - (SELECT count(*) FROM e) + (SELECT count(*) FROM f) AS chi) SELECT CASE WHEN chi % 2 = 0 THEN (2 - chi) / 2 END AS genus FROM x",
    "spherical_areas": f"{_SOLID} SELECT fid, {_r('area', 8, 'area')} FROM s",
    "is_bijective": f"{_SOLID}, q AS (SELECT sum(area) AS t, sum(abs(area)) AS s, sum(greatest(-area, 0)) AS n, sum(greatest(area, 0)) AS p FROM s) SELECT (abs(abs(t) - 4 * pi()) <= 0.04 * pi() AND s > 0 AND (CASE WHEN t >= 0 THEN n ELSE p END) <= 0)::INT AS bijective FROM q",
    "parcel_centroids": f"WITH {_V.format(h='25')}, u AS (SELECT (floor(x / 5) * 20 + floor(y / 5))::BIGINT AS parcel, x + 1 AS x, y, z, greatest(sqrt((x + 1) * (x + 1) + y * y + z * z), 1e-12) AS s FROM v), m AS (SELECT parcel, avg(x / s) AS x, avg(y / s) AS y, avg(z / s) AS z FROM u GROUP BY 1) SELECT parcel, " + ", ".join(_r(f"{c} / greatest(sqrt(x * x + y * y + z * z), 1e-12)", 8, c) for c in "xyz") + " FROM m",
    "mesh_pool_mean": f"{_POOL} SELECT coarse, round(avg(v), 8) AS v FROM c GROUP BY 1", "mesh_pool_max": f"{_POOL} SELECT coarse, round(v, 8) AS v, vid FROM m",
    "mesh_unpool_max": f"{_POOL} SELECT c.vid, round(coalesce(m.v, 0), 8) AS v FROM c LEFT JOIN m ON m.vid = c.vid",
}
