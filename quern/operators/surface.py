"""Curvature, distortion, discrete exterior calculus and topology of triangle meshes (see `mesh`)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geometry as g
from quern.operators import mesh

CORNERS = (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))


def _point(corner: str) -> list[Column]:
    return [F.col(f"p{corner}")[k] for k in "xyz"]


def mass_matrix(vertices: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """Diagonal cells (src, dst, value): vertex areas."""
    return mesh.vertex_areas(vertices, faces, scheme).select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.col("area").alias("value"))


def gaussian_curvature(vertices: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """Angle defect by vertex area; a vertex on a border is treated as one inside."""
    shares = []
    for o, p, q in CORNERS:
        u, w = g.minus(_point(p), _point(o)), g.minus(_point(q), _point(o))
        shares.append(F.struct(F.col(o).alias("vid"), F.atan2(g.norm(g.cross(u, w)), g.dot(u, w)).alias("angle")))
    angles = mesh.corners(vertices, faces).select(F.explode(F.array(*shares)).alias("s")).groupBy("s.vid").agg(F.sum("s.angle").alias("_angle"))
    areas = mesh.vertex_areas(vertices, faces, scheme)
    return angles.join(areas, "vid").select("vid", ((2 * math.pi - F.col("_angle")) / F.greatest("area", F.lit(1e-12))).alias("k"))


def mean_curvature(vertices: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """Half the length of the cotangent Laplacian of the points by vertex area, positive where the surface is convex."""
    points = vertices.withColumnRenamed("vid", "dst")
    terms = mesh.cotangent_laplacian(vertices, faces).join(points, "dst")
    bent = terms.groupBy(F.col("src").alias("vid")).agg(*(F.sum(F.col("value") * F.col(c)).alias(f"l{c}") for c in "xyz"))
    joined = bent.join(mesh.vertex_areas(vertices, faces, scheme), "vid").join(mesh.vertex_normals(vertices, faces), "vid")
    h = [0.5 * F.col(f"l{c}") / F.greatest("area", F.lit(1e-12)) for c in "xyz"]
    along = g.dot(h, [F.col(f"n{c}") for c in "xyz"])
    flat = F.abs(along) <= 1e-9 * g.norm(h)  # at right angles to the normal up to rounding, as at the corner of one face
    return joined.select("vid", F.when(flat, 0.0).otherwise(F.signum(along) * g.norm(h)).alias("h"))


def principal_curvatures(vertices: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """h plus and minus sqrt(max(h^2 - k, 0))."""
    both = mean_curvature(vertices, faces, scheme).join(gaussian_curvature(vertices, faces, scheme), "vid")
    spread = F.sqrt(F.greatest(F.col("h") * F.col("h") - F.col("k"), F.lit(0.0)))
    return both.select("vid", (F.col("h") + spread).alias("k1"), (F.col("h") - spread).alias("k2"))


def areal_distortion(source: DataFrame, warped: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """log2 of the ratio of vertex areas, warped by source."""
    after = mesh.vertex_areas(warped, faces, scheme).withColumnRenamed("area", "_after")
    ratio = F.greatest("_after", F.lit(1e-12)) / F.greatest("area", F.lit(1e-12))
    return mesh.vertex_areas(source, faces, scheme).join(after, "vid").select("vid", F.log2(ratio).alias("distortion"))


def strain_distortion(source: DataFrame, warped: DataFrame, faces: DataFrame) -> DataFrame:
    """The two stretches of each face's linear map, the larger first."""

    def metric(vertices: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        u, v = g.minus(_point("b"), _point("a")), g.minus(_point("c"), _point("a"))
        cells = (g.dot(u, u), g.dot(u, v), g.dot(v, v))
        return mesh.corners(vertices, faces).select("fid", *(c.alias(n) for c, n in zip(cells, names)))

    both = metric(source, ("g11", "g12", "g22")).join(metric(warped, ("w11", "w12", "w22")), "fid")
    c = {n: F.col(n) for n in ("g11", "g12", "g22", "w11", "w12", "w22")}
    area = F.greatest(c["g11"] * c["g22"] - c["g12"] * c["g12"], F.lit(1e-12))
    trace = (c["g22"] * c["w11"] - 2 * c["g12"] * c["w12"] + c["g11"] * c["w22"]) / area
    gap = F.sqrt(F.greatest(trace * trace - 4 * (c["w11"] * c["w22"] - c["w12"] * c["w12"]) / area, F.lit(1e-12)))
    stretch = lambda x: F.sqrt(F.greatest(x / 2, F.lit(0.0)))
    return both.select("fid", stretch(trace + gap).alias("s1"), stretch(trace - gap).alias("s2"))


def gradient(faces: DataFrame) -> DataFrame:
    """Incidence of edges (p < q) and vertices: p, q, vid, value, -1 at p and +1 at q."""
    ends = F.array(F.struct(F.col("p").alias("vid"), F.lit(-1.0).alias("value")), F.struct(F.col("q").alias("vid"), F.lit(1.0).alias("value")))
    return mesh.edges(faces).select("p", "q").distinct().select("p", "q", F.explode(ends).alias("s")).select("p", "q", "s.*")


def curl(faces: DataFrame) -> DataFrame:
    """Incidence of faces and edges: fid, p, q, value, +1 where the face runs through the edge from p to q."""
    sides = F.array(*(F.struct(F.least(s, t).alias("p"), F.greatest(s, t).alias("q"), F.when(F.col(s) < F.col(t), 1.0).otherwise(-1.0).alias("value")) for s, t, _ in CORNERS))
    return faces.select("fid", F.explode(sides).alias("s")).select("fid", "s.*")


def edge_star(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Cotangent weight of each edge: p, q, value."""
    cells = mesh.cotangent_laplacian(vertices, faces).filter("src < dst")
    return cells.select(F.col("src").alias("p"), F.col("dst").alias("q"), (-F.col("value")).alias("value"))


def star(vertices: DataFrame, faces: DataFrame, k: int) -> DataFrame:
    """The diagonal Hodge star: barycentric vertex areas, cotangent edge weights, or one by face areas."""
    if k == 0:
        return mesh.vertex_areas(vertices, faces, "barycentric").select("vid", F.col("area").alias("value"))
    if k == 1:
        return edge_star(vertices, faces)
    return mesh.face_areas(vertices, faces).select("fid", (1 / F.col("area")).alias("value"))


def divergence(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices and edges: vid, p, q, value; edge weights, signed as in `gradient`, by barycentric vertex areas."""
    weighed = gradient(faces).join(edge_star(vertices, faces).withColumnRenamed("value", "_w"), ["p", "q"])
    area = mesh.vertex_areas(vertices, faces, "barycentric")
    return weighed.join(area, "vid").select("vid", "p", "q", (F.col("value") * F.col("_w") / F.col("area")).alias("value"))


def euler_characteristic(faces: DataFrame) -> DataFrame:
    """One row: vertices minus edges plus faces, of the vertices that faces use."""
    corners = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct().agg(F.count("*").alias("v"))
    counts = corners.join(mesh.edges(faces).select("p", "q").distinct().agg(F.count("*").alias("e"))).join(faces.agg(F.count("*").alias("f")))  # one row each
    return counts.select((F.col("v") - F.col("e") + F.col("f")).alias("chi"))


def genus(faces: DataFrame) -> DataFrame:
    """One row: handles of a closed surface; null where 2 - chi is odd, as on a surface with one boundary."""
    return euler_characteristic(faces).select(F.when(F.col("chi") % 2 == 0, (2 - F.col("chi")) / 2).alias("genus"))


def spherical_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return mesh.corners(vertices, faces).select("fid", g.spherical_area(*(_point(c) for c in "abc")).alias("area"))


def is_bijective(vertices: DataFrame, faces: DataFrame, flip_area: float = 0.0, off_total: float = 0.01) -> DataFrame:
    """One row: whether the faces cover the sphere once, none turned over (up to the two shares)."""
    sums = spherical_areas(vertices, faces).agg(
        F.sum("area").alias("t"), F.sum(F.abs("area")).alias("s"), F.sum(F.when(F.col("area") < 0, -F.col("area")).otherwise(0.0)).alias("n"), F.sum(F.when(F.col("area") > 0, F.col("area")).otherwise(0.0)).alias("p")
    )
    turned = F.when(F.col("t") >= 0, F.col("n")).otherwise(F.col("p"))
    covers = F.abs(F.abs(F.col("t")) - 4 * math.pi) <= off_total * 4 * math.pi
    return sums.select((covers & (F.col("s") > 0) & (turned <= flip_area * F.col("s"))).alias("bijective"))


def parcel_centroids(points: DataFrame, parcel: str) -> DataFrame:
    """The mean of the unit vectors (x, y, z) of each parcel, scaled to length one."""
    size = F.greatest(g.norm([F.col(c) for c in "xyz"]), F.lit(1e-12))
    means = points.groupBy(parcel).agg(*(F.avg(F.col(c) / size).alias(c) for c in "xyz"))
    length = F.greatest(g.norm([F.col(c) for c in "xyz"]), F.lit(1e-12))
    return means.select(parcel, *((F.col(c) / length).alias(c) for c in "xyz"))


def pooled_mean(children: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the values (vid, v) of the fine vertices of each coarse one. children: coarse, vid."""
    return children.join(values, "vid").groupBy("coarse").agg(F.avg("v").alias("v"))


def pooled_max(children: DataFrame, values: DataFrame) -> DataFrame:
    """Largest value of the fine vertices of each coarse one, and where it stands (the least vertex of equals)."""
    best = F.max(F.struct("v", (-F.col("vid")).alias("_n")))
    return children.join(values, "vid").groupBy("coarse").agg(best.alias("_s")).select("coarse", F.col("_s.v").alias("v"), (-F.col("_s._n")).alias("vid"))


def unpooled_max(pooled: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pooled values back at their vertices, zeros elsewhere."""
    return vertices.select("vid").join(pooled.groupBy("vid").agg(F.sum("v").alias("v")), "vid", "left").select("vid", F.coalesce("v", F.lit(0.0)).alias("v"))
