"""Triangle meshes as tables: vertices (vid, x, y, z) and faces (fid, a, b, c). Geometry is joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import staged


def icosphere(spark: SparkSession, rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of an icosahedron whose faces are split in four `rounds` times, on the unit sphere."""
    g = (1 + 5**0.5) / 2
    points = [(s * a, t * b, 0.0) for a, b in ((1.0, g),) for s in (-1, 1) for t in (-1, 1)]
    v = np.array([p for x, y, z in points for p in ((x, y, z), (z, x, y), (y, z, x))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = np.sort(((v[:, None] - v[None]) ** 2).sum(-1), axis=1)[0, 1] * 1.01
    linked = ((v[:, None] - v[None]) ** 2).sum(-1) < near
    f = np.array([(i, j, k) for i in range(12) for j in range(i + 1, 12) for k in range(j + 1, 12) if linked[i, j] and linked[j, k] and linked[i, k]])
    turned = np.einsum("ij,ij->i", np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), v[f].mean(1)) < 0
    f[turned] = f[turned][:, [0, 2, 1]]
    for _ in range(rounds):
        edges = np.unique(np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1), axis=0)
        place = {(int(a), int(b)): len(v) + n for n, (a, b) in enumerate(edges)}
        middle = v[edges].mean(1)
        v = np.concatenate([v, middle / np.linalg.norm(middle, axis=1)[:, None]])
        at = lambda a, b: place[(int(min(a, b)), int(max(a, b)))]
        f = np.array([t for a, b, c in f for ab, bc, ca in ((at(a, b), at(b, c), at(c, a)),) for t in ((a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca))])
    vertices = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(v)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(n, *map(int, t)) for n, t in enumerate(f)], "fid long, a long, b long, c long")
    return vertices, faces


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with the points of their corners as structs pa, pb, pc."""
    out = faces
    for corner in "abc":
        points = vertices.select(F.col("vid").alias(corner), F.struct("x", "y", "z").alias(f"p{corner}"))
        out = out.join(points, corner)
    return out


def _minus(p: Column, q: Column) -> list[Column]:
    return [p[k] - q[k] for k in "xyz"]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _normal() -> list[Column]:
    return _cross(_minus(F.col("pb"), F.col("pa")), _minus(F.col("pc"), F.col("pa")))


def face_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    n = _normal()
    size = F.greatest(F.sqrt(_dot(n, n)), F.lit(1e-12))
    return corners(vertices, faces).select("fid", *((c / size).alias(k) for c, k in zip(n, ("nx", "ny", "nz"))))


def face_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    n = _normal()
    return corners(vertices, faces).select("fid", (0.5 * F.sqrt(_dot(n, n))).alias("area"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit sums of the area-weighted normals of a vertex's faces."""
    parts = corners(vertices, faces).select(F.explode(F.array("a", "b", "c")).alias("vid"), *(c.alias(k) for c, k in zip(_normal(), ("nx", "ny", "nz"))))
    sums = parts.groupBy("vid").agg(*(F.sum(k).alias(k) for k in ("nx", "ny", "nz")))
    size = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-12))
    return sums.select("vid", *((F.col(k) / size).alias(k) for k in ("nx", "ny", "nz")))


def _cotangents() -> list[tuple[str, str, str, Column]]:
    """(corner, the two others, cotangent of its angle) of a face's corners."""
    out = []
    for o, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        u, v = _minus(F.col(f"p{p}"), F.col(f"p{o}")), _minus(F.col(f"p{q}"), F.col(f"p{o}"))
        n = _cross(u, v)
        out.append((o, p, q, _dot(u, v) / F.greatest(F.sqrt(_dot(n, n)), F.lit(1e-12))))
    return out


def vertex_areas(vertices: DataFrame, faces: DataFrame, scheme: str = "voronoi") -> DataFrame:
    """A third of each face, or the mixed Voronoi share: by cotangents, and in obtuse faces a half and two quarters."""
    n = _normal()
    area = 0.5 * F.sqrt(_dot(n, n))
    if scheme == "barycentric":
        shares = [F.struct(F.col(o).alias("vid"), (area / 3).alias("area")) for o in "abc"]
    else:
        cot = {o: c for o, _, _, c in _cotangents()}
        length2 = lambda p, q: _dot(_minus(F.col(f"p{p}"), F.col(f"p{q}")), _minus(F.col(f"p{p}"), F.col(f"p{q}")))
        blunt = (cot["a"] < 0) | (cot["b"] < 0) | (cot["c"] < 0)
        shares = []
        for o, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
            round_ = (length2(o, p) * cot[q] + length2(o, q) * cot[p]) / 8
            shares.append(F.struct(F.col(o).alias("vid"), F.when(~blunt, round_).when(cot[o] < 0, area / 2).otherwise(area / 4).alias("area")))
    parts = corners(vertices, faces).select(F.explode(F.array(*shares)).alias("s"))
    return parts.groupBy("s.vid").agg(F.sum("s.area").alias("area"))


def cotangent_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Cells (src, dst, value): minus half the cotangents opposite an edge, and row sums that make each row 0."""
    halves = [F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), (c / 2).alias("w")) for _, p, q, c in _cotangents()]
    parts = corners(vertices, faces).select(F.explode(F.array(*halves)).alias("s")).select("s.*")
    sides = staged(parts.groupBy("p", "q").agg(F.sum("w").alias("w")))  # read twice, so that corners meet faces once
    ends = F.array(F.struct(F.col("p").alias("src"), F.col("q").alias("dst"), (-F.col("w")).alias("value")), F.struct(F.col("q").alias("src"), F.col("p").alias("dst"), (-F.col("w")).alias("value")))
    ends = F.when(F.col("p") == F.col("q"), F.transform(F.slice(ends, 1, 1), lambda e: e.withField("value", 2 * e["value"]))).otherwise(ends)
    off = sides.select(F.explode(ends).alias("s")).select("s.*")
    sums = sides.select(F.explode(F.array("p", "q")).alias("src"), "w").groupBy("src").agg(F.sum("w").alias("value"))
    return off.union(sums.select("src", F.col("src").alias("dst"), "value"))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (p < q) with their face."""
    sides = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.p", "e.q")


def edge_face_adjacency(faces: DataFrame) -> DataFrame:
    sides = edges(faces)
    other = sides.withColumnRenamed("fid", "other")
    return sides.join(other, ["p", "q"]).filter("fid < other").select("fid", "other")


#: Edges of a partition of `k_ring`, which holds about 12 pairs for each at two hops.
RING_ROWS = 100_000


def k_ring(faces: DataFrame, k: int = 1, include_self: bool = False) -> DataFrame:
    """Pairs of vertices within k edges, with the least number of edges. Pairs are held in one direction until the end, in
    partitions whose number grows with the edges."""
    half = staged(edges(faces).select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct())  # src <= dst
    parts = max(int(half.sparkSession.conf.get("spark.sql.shuffle.partitions")), half.count() // RING_ROWS)
    turned = lambda t: t.union(t.filter("src <> dst").select("dst", "src", *t.columns[2:]))
    one = turned(half)
    reached = half.withColumn("hops", F.lit(1))
    for hop in range(2, k + 1):
        last = turned(reached.filter(F.col("hops") == hop - 1)).withColumnRenamed("dst", "_m").repartition(parts, "_m")
        step = last.join(one.withColumnRenamed("src", "_m").repartition(parts, "_m"), "_m").filter("src < dst").select("src", "dst", F.lit(hop).alias("hops"))
        reached = staged(reached.union(step).repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.min("hops").alias("hops")))
    reached = turned(reached)
    if include_self:
        reached = reached.union(one.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops")).distinct())
    return reached


def laplacian_smooth(vertices: DataFrame, faces: DataFrame, lam: float = 0.5, rounds: int = 1) -> DataFrame:
    """(1 - lam) v + lam times the mean of neighbours, each counted once for every face corner that it shares."""
    pairs = F.array(*(F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p in "abc" for q in "abc" if p != q))
    near = staged(faces.select(F.explode(pairs).alias("s")).select("s.*"))
    for _ in range(rounds):
        means = near.join(vertices.withColumnRenamed("vid", "dst"), "dst").groupBy(F.col("src").alias("vid")).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        joined = vertices.join(means, "vid", "left")
        vertices = staged(joined.select("vid", *(((1 - lam) * F.col(c) + lam * F.coalesce(f"m{c}", c)).alias(c) for c in "xyz")))
    return vertices
