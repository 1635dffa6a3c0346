"""Level sets of volumes as triangle meshes. A volume is a table of cells (x, y, z, v) at whole places.

Each cube of eight neighbouring cells is cut in six tetrahedra along its main diagonal, alike in all cubes, so that faces of
neighbours agree. A vertex is named by the grid edge that it lies on: neighbours name it alike and need not meet for it.
"""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import staged

#: A corner's number has a bit for its step along each axis.
_BITS = {"x": 4, "y": 2, "z": 1}
_SPLIT = [(0, first, first | second, 7) for first, second, _ in permutations((4, 2, 1))]
_EDGES = sorted({(p, q) for tet in _SPLIT for n, p in enumerate(tet) for q in tet[n + 1 :]})


def _cases() -> list[tuple[int, ...]]:
    """(tet, code, n, three vertices) for each triangle n of a tetrahedron whose corners in `code` are inside. A vertex is
    8 times the lower corner of its edge, plus the edge's step. Triangles turn their front to the outside."""
    place = lambda k: np.array([(k >> 2) & 1, (k >> 1) & 1, k & 1], float)
    out = []
    for tet, code in product(range(6), range(1, 15)):
        parts = [[c for n, c in enumerate(_SPLIT[tet]) if code >> n & 1 == side] for side in (1, 0)]
        inside, outside = parts
        ring = [(i, o) for k, i in enumerate(inside) for o in (outside if k == 0 else outside[::-1])]
        middle = [(place(i) + place(o)) / 2 for i, o in ring]
        out_of = np.mean([place(o) for o in outside], axis=0) - np.mean([place(i) for i in inside], axis=0)
        if np.cross(middle[1] - middle[0], middle[2] - middle[0]) @ out_of < 0:
            ring = ring[::-1]
        names = [8 * (i & o) + (i ^ o) for i, o in ring]
        out += [(tet, code, n, names[0], names[n + 1], names[n + 2]) for n in range(len(names) - 2)]
    return out


def _case_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_cases(), "tet int, code int, n int, a int, b int, c int")  # 120 rows


def cubes(cells: DataFrame) -> DataFrame:
    """Cubes (x, y, z of the least corner, v0 to v7) all of whose corners have a value; of repeated cells the largest counts."""
    steps = F.array(*(F.struct(*(F.lit(k // b % 2).alias(f"d{c}") for c, b in _BITS.items()), F.lit(k).alias("k")) for k in range(8)))
    known = cells.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    shares = known.select(*(F.col(c).cast("long").alias(c) for c in _BITS), F.col("v").cast("double").alias("v"), F.explode(steps).alias("s"))
    corners = [F.max(F.when(F.col("s.k") == k, F.col("v"))).alias(f"v{k}") for k in range(8)]
    return shares.groupBy(*((F.col(c) - F.col(f"s.d{c}")).alias(c) for c in _BITS)).agg(*corners).dropna(subset=[f"v{k}" for k in range(8)])


def marching_cubes(cells: DataFrame, level: float = 0.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, a, b, c) of the surface between cells below the level and the others.

    Faces turn to larger values. A surface that stays off the volume's border is closed: each edge has two faces. Where a
    cell has just the level, the level is raised by 1e-5 of the largest distance from it (of 1 at least), so that no vertex
    falls on a cell. Coordinates are places times spacing. Cells without a value have no surface around them. Empty tables
    and volumes without the level give empty meshes.
    """
    number = [F.min(c) for c in _BITS] + [F.max(c) for c in _BITS]
    x0, y0, z0, x1, y1, z1, far, ties = cells.agg(*number, F.max(F.abs(F.col("v") - level)), F.count_if(F.col("v") == level)).first()
    if ties:
        level += 1e-5 * max(1.0, far)
    height, depth = (0, 0) if x0 is None else (y1 - y0 + 1, z1 - z0 + 1)
    if x0 is not None and (x1 - x0 + 1) * height * depth >= 2**59:
        raise ValueError("the volume's box has more places than 64 bits can name with the edges of each")
    values = [F.col(f"v{k}") for k in range(8)]
    crossed = staged(cubes(cells).filter((F.least(*values) < level) & (F.greatest(*values) >= level)))

    def place(k: Column) -> Column:  # number of the corner k of a cube
        at = [F.col(c) - F.lit(low or 0) + F.floor(k / b) % 2 for (c, b), low in zip(_BITS.items(), (x0, y0, z0))]
        return ((at[0] * height + at[1]) * depth + at[2]).cast("long")

    name = lambda edge: (place(F.floor(edge / 8)) * 8 + edge % 8).cast("long")
    codes = [sum(F.when(values[c] < level, 1 << n).otherwise(0) for n, c in enumerate(tet)) for tet in _SPLIT]
    tets = crossed.select(*_BITS, F.posexplode(F.array(*codes)).alias("tet", "code"))
    cut = tets.join(F.broadcast(_case_table(cells.sparkSession)), ["tet", "code"])
    faces = cut.select((place(F.lit(0)) * 16 + F.col("tet") * 2 + F.col("n")).cast("long").alias("fid"), *(name(F.col(c)).alias(c) for c in "abc"))

    points = []
    for p, q in _EDGES:
        share = (level - values[p]) / (values[q] - values[p])
        at = [(F.col(c) + p // b % 2 + ((q ^ p) // b % 2) * share) * float(s) for (c, b), s in zip(_BITS.items(), spacing)]
        edge = F.struct(name(F.lit(8 * p + (p ^ q))).alias("vid"), *(a.alias(c) for a, c in zip(at, _BITS)))
        points.append(F.when((values[p] < level) != (values[q] < level), edge))
    found = crossed.select(F.explode(F.array_compact(F.array(*points))).alias("e")).select("e.*")
    vertices = found.groupBy("vid").agg(*(F.min(c).alias(c) for c in _BITS))  # cubes that share an edge say the same
    return vertices, faces


def padded(cells: DataFrame, value: float) -> DataFrame:
    """The cells and, with that value, all places next to one (26 neighbours) that have none."""
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{c}") for c, d in zip(_BITS, step))) for step in product((-1, 0, 1), repeat=3)))
    near = cells.select(*_BITS, F.explode(steps).alias("s")).select(*((F.col(c) + F.col(f"s.d{c}")).alias(c) for c in _BITS)).distinct()
    fresh = near.join(cells, list(_BITS), "left_anti").withColumn("v", F.lit(float(value)))
    return cells.select(*_BITS, "v").unionByName(fresh)


def enclosed_volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: what a closed surface encloses, positive where faces turn outward."""
    from quern.operators.mesh import corners

    a, b, c = (F.col(f"p{k}") for k in "abc")
    det = a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])
    return corners(vertices, faces).agg(F.coalesce(F.sum(det / 6), F.lit(0.0)).alias("volume"))
