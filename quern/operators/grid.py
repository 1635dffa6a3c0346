"""Images as cell tables (img, x, y, v): stencils are shifts of coordinates, so neighbours meet by equi-joins and sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import connected_components
from quern.session import staged


def shifted(cells: DataFrame, offsets: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Each cell's value sent to the cells for which it is a neighbour: img, x, y, v, w; only onto cells that exist."""
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in offsets))
    sent = cells.select("img", "x", "y", "v", F.explode(table).alias("o"))
    moved = sent.select("img", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "v", F.col("o.w").alias("w"))
    return moved.join(cells.select("img", "x", "y"), ["img", "x", "y"], "left_semi")


def box(radius: int) -> list[tuple[int, int, float]]:
    return [(dx, dy, 1.0) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]


def _reduced(cells: DataFrame, offsets: Sequence[tuple[int, int, float]], how: Column) -> DataFrame:
    return shifted(cells, offsets).groupBy("img", "x", "y").agg(how.alias("v"))


def dilate(cells: DataFrame, radius: int = 1) -> DataFrame:
    return _reduced(cells, box(radius), F.max("v"))


def erode(cells: DataFrame, radius: int = 1) -> DataFrame:
    return _reduced(cells, box(radius), F.min("v"))


def median(cells: DataFrame, radius: int = 1) -> DataFrame:
    return _reduced(cells, box(radius), F.percentile("v", 0.5))


def stencil(cells: DataFrame, offsets: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Weighted sum over offsets; cells outside count as 0."""
    return _reduced(cells, offsets, F.sum(F.col("v") * F.col("w")))


def laplacian(cells: DataFrame) -> DataFrame:
    """Five-point Laplacian; a cell outside takes the value of the cell itself."""
    around = stencil(cells.withColumn("v", F.col("v")), [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)])
    count = _reduced(cells, [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], F.count("*"))
    joined = cells.withColumnRenamed("v", "_c").join(around, ["img", "x", "y"], "left").join(count.withColumnRenamed("v", "_n"), ["img", "x", "y"], "left")
    return joined.select("img", "x", "y", (F.coalesce("v", F.lit(0.0)) - F.coalesce("_n", F.lit(0)) * F.col("_c")).alias("v"))


def gaussian(cells: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable smoothing, weights renormalised at the edges: one sum a direction."""
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    for axis in (0, 1):
        offsets = [(k, 0, w) if axis == 0 else (0, k, w) for k, w in zip(range(-reach, reach + 1), weights)]
        cells = _reduced(cells, offsets, F.sum(F.col("v") * F.col("w")) / F.sum("w"))
    return cells


def rooted(cells: DataFrame, mask: Column) -> DataFrame:
    """The cells in the mask (img, x, y, label): label is the first cell, in row order, of its connected part (4 neighbours)."""
    width = cells.agg(F.max("y")).first()[0] + 2
    number = lambda x, y: x.cast("long") * width + y
    inside = cells.filter(mask).select("img", "x", "y", F.concat_ws(":", "img", F.lpad(number(F.col("x"), F.col("y")).cast("string"), 19, "0")).alias("id"))
    right = inside.select("img", (F.col("x") - 1).alias("x"), "y", F.col("id").alias("dst")).join(inside, ["img", "x", "y"])
    below = inside.select("img", "x", (F.col("y") - 1).alias("y"), F.col("id").alias("dst")).join(inside, ["img", "x", "y"])
    pairs = right.union(below.select(right.columns)).select(F.col("id").alias("src"), "dst")
    return inside.join(connected_components(pairs, inside.select("id")), "id").select("img", "x", "y", "label")


def labelled(cells: DataFrame, mask: Column) -> DataFrame:
    """Connected parts (4 neighbours) of the cells in the mask: dense labels from 1 within each image, background 0."""
    parts = staged(rooted(cells, mask))
    number = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    roots = parts.select("img", F.col("label").alias("root")).distinct()
    roots = staged(roots.repartitionByRange(number, "img", "root").withColumn("_range", F.spark_partition_id()))  # ranks by range of the first cell
    sizes = roots.groupBy("img", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("img").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("img", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("img", "_range").orderBy("root")
    ranked = roots.join(bases, ["img", "_range"]).select("img", "root", (F.col("_base") + F.row_number().over(inside)).cast("int").alias("label"))
    dense = parts.withColumnRenamed("label", "root").join(ranked, ["img", "root"]).drop("root")
    return cells.join(dense, ["img", "x", "y"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def bounding_box(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """First and one past the last index above the threshold by image and axis; (0, 0) where nothing is."""
    on = F.col("v") > threshold
    low = lambda c: F.coalesce(F.min(F.when(on, F.col(c))), F.lit(0))
    high = lambda c: F.coalesce(F.max(F.when(on, F.col(c))) + 1, F.lit(0))
    return cells.groupBy("img").agg(low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))


def centre_of_mass(cells: DataFrame) -> DataFrame:
    total = F.greatest(F.sum("v"), F.lit(1e-12))
    return cells.groupBy("img").agg((F.sum(F.col("x") * F.col("v")) / total).alias("cx"), (F.sum(F.col("y") * F.col("v")) / total).alias("cy"))


def resample(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Bilinear values at points (img, pid, px, py): four equi-joins' worth of corners, one sum; outside counts as 0."""
    fx, fy = F.floor("px"), F.floor("py")
    corner = lambda dx, dy: F.struct((fx + dx).alias("x"), (fy + dy).alias("y"), ((F.col("px") - fx if dx else 1 - (F.col("px") - fx)) * (F.col("py") - fy if dy else 1 - (F.col("py") - fy))).alias("w"))
    asked = points.select("img", "pid", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1)))).alias("c")).select("img", "pid", "c.*")
    found = asked.join(cells, ["img", "x", "y"], "left")
    return found.groupBy("img", "pid").agg(F.sum(F.coalesce("v", F.lit(0.0)) * F.col("w")).alias("v"))


def overlap_add(parts: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Weighted tiles (img, x, y, v, w) back to one image: sum of w v over max(sum of w, eps)."""
    return parts.groupBy("img", "x", "y").agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(eps))).alias("v"))


def tfce(cells: DataFrame, steps: int = 20, extent: float = 0.5, height: float = 2.0) -> DataFrame:
    """Threshold-free enhancement of positive values: sum over heights of extent^E h^H dh, thresholds strict."""
    top = cells.agg(F.max("v")).first()[0] or 0.0
    out = cells.select("img", "x", "y", F.lit(0.0).alias("v"))
    step = top / steps
    for n in range(1, steps + 1):
        h = n * step
        parts = rooted(cells, F.col("v") > h)
        sizes = parts.groupBy("img", "label").agg(F.count("*").alias("_n"))
        gain = F.pow(F.col("_n").cast("double"), F.lit(extent)) * h**height * step
        out = out.union(staged(parts.join(sizes, ["img", "label"]).select("img", "x", "y", gain.alias("v"))))
    return out.groupBy("img", "x", "y").agg(F.sum("v").alias("v"))
