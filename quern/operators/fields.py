"""Sampling, displacement fields, bilateral smoothing, surfaces of masks and tiling on images (img, x, y, v); see `grid`."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.operators import grid
from quern.operators.augment import squared_distance_transform
from quern.operators.quantiles import group_quantiles
from quern.session import staged


def _lanczos(d: np.ndarray) -> np.ndarray:
    x = math.pi * np.where(np.abs(d) < 1e-9, 1.0, d)
    inner = 3 * np.sin(x) * np.sin(x / 3) / (x * x)
    return np.where(np.abs(d) >= 3, 0.0, np.where(np.abs(d) < 1e-9, 1.0, inner))


def _catmull_rom(d: np.ndarray) -> np.ndarray:
    a = np.abs(d)
    near = 1.5 * a * a * a - 2.5 * a * a + 1
    far = -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2
    return np.where(a < 1, near, np.where(a < 2, far, 0.0))


#: Side of a tile, and the most points of one group.
TILE, POINTS = 64, 65_536


#: Taps on either side of a point, weight by distance, and whether weights are scaled to one.
KERNELS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray], bool]] = {
    "linear": (1, lambda d: np.maximum(1 - np.abs(d), 0.0), False), "catmull_rom": (2, _catmull_rom, False), "lanczos": (3, _lanczos, True),
}


def sample(cells: DataFrame, points: DataFrame, method: str = "linear", cval: float = 0.0) -> DataFrame:
    """img, pid, v: values at points (img, pid, px, py); taps off the image count as cval.

    A point without a place has null, one that is not finite not a number. Points and cells meet by tile: a cell goes to its tile and, near a border, to its neighbours, a point to its own. Tiles
    of more than POINTS points are shared by several groups."""
    if method == "nearest":
        asked = points.select("img", "pid", F.floor(F.col("px") + 0.5).alias("x"), F.floor(F.col("py") + 0.5).alias("y"))
        return asked.join(cells, ["img", "x", "y"], "left").select("img", "pid", F.coalesce("v", F.lit(cval)).alias("v"))
    reach, weight, scaled = KERNELS[method]
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    asked = points.select("img", "pid", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    placed = F.coalesce((F.abs("px") < float("inf")) & (F.abs("py") < float("inf")), F.lit(False))
    lost = asked.filter(~placed).select("img", "pid", (F.col("px") * F.col("py") * float("nan")).alias("v"))
    asked = asked.filter(placed).select("*", tile("px").alias("_tx"), tile("py").alias("_ty"))
    crowded = staged(asked.groupBy("img", "_tx", "_ty").agg(F.count("*").alias("_n")).filter(F.col("_n") > POINTS).select("img", "_tx", "_ty", F.ceil(F.col("_n") / POINTS).alias("_parts")), release=False)
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE).cast("long"), F.floor((F.col(c) + reach) / TILE).cast("long")))
    held = cells.select("img", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v")).filter("v IS NOT NULL AND img IS NOT NULL")
    held = held.select("*", around("x").alias("_tx")).select("*", around("y").alias("_ty"))
    if crowded.isEmpty():
        asked, held = (t.withColumn("_part", F.lit(0).cast("long")) for t in (asked, held))
    else:  # at most one for POINTS points
        parts = F.coalesce("_parts", F.lit(1))
        asked, held = (t.join(F.broadcast(crowded), ["img", "_tx", "_ty"], "left") for t in (asked, held))
        asked = asked.withColumn("_part", F.pmod(F.xxhash64("pid", "px", "py"), parts)).drop("_parts")
        held = held.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    schema = T.StructType([asked.schema["img"], asked.schema["pid"], T.StructField("v", T.DoubleType())])
    corner = {c: i for i, c in enumerate(("_tx", "_ty"))}

    def weighted(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return to_arrow_schema(schema).empty_table()
        (low_x, low_y), wide = (mine.column(c)[0].as_py() * TILE - reach for c in corner), TILE + 2 * reach
        values = np.full((wide, wide), cval)
        if others.num_rows:
            x, y = (others.column(c).to_numpy() - low for c, low in (("x", low_x), ("y", low_y)))
            inside = (x >= 0) & (x < wide) & (y >= 0) & (y < wide)
            values[x[inside], y[inside]] = others.column("v").to_numpy()[inside]
        px, py = (mine.column(c).to_numpy() for c in ("px", "py"))
        fx, fy = np.floor(px), np.floor(py)
        at_x, at_y = (fx - low_x).astype("int64"), (fy - low_y).astype("int64")
        along = [weight(py - fy - j) for j in range(1 - reach, reach + 1)]
        total, weights = np.zeros(len(px)), np.zeros(len(px))
        for i in range(1 - reach, reach + 1):
            across = weight(px - fx - i)
            for j, w in zip(range(1 - reach, reach + 1), along):
                total += across * w * values[at_x + i, at_y + j]
                weights += across * w
        return pa.table([mine.column("img"), mine.column("pid"), pa.array(total / weights if scaled else total)], schema=to_arrow_schema(schema))

    keys = ["img", "_tx", "_ty", "_part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(weighted, schema).union(lost)


def sample_labels(cells: DataFrame, points: DataFrame) -> DataFrame:
    """img, pid, label: the label whose linear weights sum highest; of equals, the least. Points off the image have none."""
    fx, fy = F.floor("px"), F.floor("py")
    w = lambda d: F.greatest(1 - F.abs(d), F.lit(0.0))
    taps = F.array(*(F.struct((fx + i).alias("x"), (fy + j).alias("y"), (w(F.col("px") - fx - i) * w(F.col("py") - fy - j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = points.select("img", "pid", F.explode(taps).alias("t")).select("img", "pid", "t.*").filter("w > 0")
    sums = asked.join(cells, ["img", "x", "y"]).groupBy("img", "pid", F.col("v").alias("label")).agg(F.round(F.sum("w"), 9).alias("w"))
    best = F.max_by("label", F.struct("w", (-F.col("label")).alias("n")))
    return sums.groupBy("img", "pid").agg(best.alias("label"))


def _bounds(cells: DataFrame) -> tuple[Column, Column]:
    """The last row and column of the images, as two numbers."""
    ends = cells.agg(F.max("x"), F.max("y")).first()
    return F.lit(ends[0]), F.lit(ends[1])


def _held(cells: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Linear samples of columns at points (img, x, y, px, py), held at the image's edge."""
    mx, my = _bounds(cells)
    px, py = F.least(F.greatest("px", F.lit(0.0)), mx), F.least(F.greatest("py", F.lit(0.0)), my)
    fx, fy = F.floor(px), F.floor(py)
    part = lambda p, f, i: p - f if i else 1 - (p - f)
    taps = F.array(*(F.struct(F.least(fx + i, mx).alias("sx"), F.least(fy + j, my).alias("sy"), (part(px, fx, i) * part(py, fy, j)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = points.select("img", "x", "y", F.explode(taps).alias("t")).select("img", "x", "y", "t.*")
    source = cells.select(F.col("img").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), *(F.col(c).alias(f"_{c}_") for c in columns))
    met = asked.join(source, (F.col("img") == F.col("_i")) & (F.col("sx") == F.col("_x")) & (F.col("sy") == F.col("_y")))
    return met.groupBy("img", "x", "y").agg(*(F.sum(F.col("w") * F.col(f"_{c}_")).alias(c) for c in columns))


def warped(cells: DataFrame, displacement: DataFrame) -> DataFrame:
    """The image at x + u(x), held at the edge. displacement: img, x, y, ux, uy."""
    points = displacement.select("img", "x", "y", (F.col("x") + F.col("ux")).alias("px"), (F.col("y") + F.col("uy")).alias("py"))
    return _held(cells, points, ["v"])


def composed(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer(x + inner) + inner."""
    points = inner.select("img", "x", "y", (F.col("x") + F.col("ux")).alias("px"), (F.col("y") + F.col("uy")).alias("py"))
    moved = _held(outer, points, ["ux", "uy"]).withColumnsRenamed({"ux": "_ox", "uy": "_oy"})
    return inner.join(moved, ["img", "x", "y"]).select("img", "x", "y", (F.col("ux") + F.col("_ox")).alias("ux"), (F.col("uy") + F.col("_oy")).alias("uy"))


def jacobian(displacement: DataFrame) -> DataFrame:
    """I + grad u by central differences, held at the edge, and its determinant: each cell is sent to its four neighbours."""
    mx, my = _bounds(displacement)
    at = lambda x, y, n: F.struct(x.alias("tx"), y.alias("ty"), F.lit(n).alias("n"))
    x, y = F.col("x"), F.col("y")
    none = F.lit(None)
    targets = F.array(
        F.when(x > 0, at(x - 1, y, "r")), F.when(x < mx, at(x + 1, y, "l")), F.when(y > 0, at(x, y - 1, "d")), F.when(y < my, at(x, y + 1, "e")),
        F.when(x == mx, at(x, y, "r")).otherwise(none), F.when(x == 0, at(x, y, "l")).otherwise(none), F.when(y == my, at(x, y, "d")).otherwise(none), F.when(y == 0, at(x, y, "e")).otherwise(none),
    )
    sent = displacement.select("img", "ux", "uy", F.explode(F.array_compact(targets)).alias("t")).select("img", F.col("t.tx").alias("x"), F.col("t.ty").alias("y"), "t.n", "ux", "uy")
    one = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    g = sent.groupBy("img", "x", "y").agg(*(((one(a, c) - one(b, c)) / 2).alias(f"g{c}{axis}") for a, b, axis in (("r", "l", "x"), ("d", "e", "y")) for c in ("ux", "uy")))
    g = g.select("img", "x", "y", (1 + F.col("guxx")).alias("jxx"), F.col("guxy").alias("jxy"), F.col("guyx").alias("jyx"), (1 + F.col("guyy")).alias("jyy"))
    return g.withColumn("det", F.col("jxx") * F.col("jyy") - F.col("jxy") * F.col("jyx"))


def downsample(cells: DataFrame, sigma: float) -> DataFrame:
    """Smoothed, then every second row and column."""
    smooth = grid.gaussian(cells, sigma)
    kept = smooth.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    return kept.select("img", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"), "v")


def bilateral(cells: DataFrame, radius: int, sigma_space: float, sigma_value: float) -> DataFrame:
    """Mean of the neighbours in a square, weighed by distance in space and value; cells off the image don't count."""
    own = cells.withColumnRenamed("v", "_own")
    near = grid.shifted(cells, [(dx, dy, (dx * dx + dy * dy) / sigma_space**2) for dx, dy, _ in grid.box(radius)])
    apart = F.pow((F.col("_own") - F.col("v")) / sigma_value, F.lit(2.0))
    weighed = near.join(own, ["img", "x", "y"]).withColumn("_w", F.exp(-0.5 * (F.col("w") + apart)))
    return weighed.groupBy("img", "x", "y").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"))


def susan(cells: DataFrame, sigma_space: float, sigma_value: float, use_median: bool = True) -> DataFrame:
    """Bilateral smoothing of the next cells, then a median of them."""
    smooth = bilateral(cells, 1, sigma_space, sigma_value)
    return grid.median(smooth) if use_median else smooth


def largest_component(cells: DataFrame, mask: Column) -> DataFrame:
    """The cells of each image's largest connected part; of equals, the one that begins first."""
    parts = grid.rooted(cells, mask)
    sizes = parts.groupBy("img", "label").agg(F.count("*").alias("_n"))
    best = sizes.groupBy("img").agg(F.max(F.struct("_n")).alias("_m")).select("img", F.col("_m._n").alias("_n"))
    first = sizes.join(best, ["img", "_n"]).groupBy("img").agg(F.min("label").alias("label"))
    return parts.join(first, ["img", "label"], "left_semi").select("img", "x", "y")


def boundary(mask: DataFrame) -> DataFrame:
    """The cells of a mask (v = 1) with a neighbour, of four, off it; off the image counts as off."""
    around = grid.shifted(mask, [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]).groupBy("img", "x", "y").agg(F.sum("v").alias("_n"))
    return mask.filter("v = 1").join(around, ["img", "x", "y"], "left").filter(F.coalesce("_n", F.lit(0.0)) < 4).select("img", "x", "y")


def surface_distances(pred: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distance of each boundary cell of one mask to the other's boundary, both ways: img, d."""

    def to(other: DataFrame, own: DataFrame) -> DataFrame:
        zero = pred.select("img", "x", "y").join(other.withColumn("_on", F.lit(0.0)), ["img", "x", "y"], "left")
        field = squared_distance_transform(zero.select("img", "x", "y", F.coalesce("_on", F.lit(1.0)).alias("v")))
        return own.join(field, ["img", "x", "y"]).select("img", F.sqrt("d2").alias("d"))

    a, b = boundary(pred), boundary(target)
    return to(b, a), to(a, b)


def hausdorff95(pred: DataFrame, target: DataFrame) -> DataFrame:
    """One row an image: the larger 0.95 quantile of the two ways; none where a mask is empty."""
    ways = [group_quantiles(d, ["img"], "d", [0.95]).select("img", F.get("q", F.lit(0)).alias(n)) for d, n in zip(surface_distances(pred, target), ("_a", "_b"))]
    return ways[0].join(ways[1], "img").select("img", F.greatest("_a", "_b").alias("hd95"))


def surface_dice(pred: DataFrame, target: DataFrame, tolerance: float) -> DataFrame:
    """One row an image: the share of both boundaries that lies within the tolerance of the other."""
    both = surface_distances(pred, target)
    return both[0].union(both[1]).groupBy("img").agg(F.avg((F.col("d") <= tolerance).cast("double")).alias("dice"))


def local_correlation(moving: DataFrame, fixed: DataFrame, radius: int, eps: float = 1e-5) -> DataFrame:
    """Squared covariance by both variances over a square about each cell; the image is mirrored at its edges."""
    mx, my = _bounds(moving)
    both = moving.withColumnRenamed("v", "m").join(fixed.withColumnRenamed("v", "f"), ["img", "x", "y"])
    steps = range(-radius, radius + 1)

    def sources(c: Column, last: Column) -> Column:
        """The cells whose window holds this one, once for each time that it shows there: as it is, or mirrored at an end."""
        places = [x for d in steps for x in (c - d, -1 - c - d, 2 * last + 1 - c - d)]
        return F.array_compact(F.array(*(F.when((x >= 0) & (x <= last), x) for x in places)))

    sent = both.select("img", "m", "f", F.col("y").alias("_y"), F.explode(sources(F.col("x"), mx)).alias("x"))
    sent = sent.select("img", "m", "f", "x", F.explode(sources(F.col("_y"), my)).alias("y"))
    n = float((2 * radius + 1) ** 2)
    s = sent.groupBy("img", "x", "y").agg(F.sum("m").alias("a"), F.sum("f").alias("b"), F.sum(F.col("m") * F.col("f")).alias("ab"), F.sum(F.col("m") * F.col("m")).alias("aa"), F.sum(F.col("f") * F.col("f")).alias("bb"))
    cross, va, vb = F.col("ab") - F.col("a") * F.col("b") / n, F.col("aa") - F.col("a") * F.col("a") / n, F.col("bb") - F.col("b") * F.col("b") / n
    return s.select("img", "x", "y", (cross * cross / (va * vb + eps)).alias("v"))


def crop_to_multiple(cells: DataFrame, multiple: int) -> DataFrame:
    """The middle part whose sides are multiples; indices begin at 0."""
    mx, my = _bounds(cells)
    keep = cells
    for c, last in (("x", mx), ("y", my)):
        size = last + 1
        lost = F.floor(F.pmod(size, F.lit(multiple)) / 2)
        length = F.floor(size / multiple) * multiple
        keep = keep.filter((F.col(c) >= lost) & (F.col(c) < lost + length)).withColumn(c, F.col(c) - lost)
    return keep


def pad_to_multiple(cells: DataFrame, multiple: int, cval: float = 0.0) -> DataFrame:
    """Prolonged on both sides to multiples, the odd cell at the end; new cells have cval."""
    ends = cells.agg(F.max("x"), F.max("y")).first()
    sizes = [e + 1 for e in ends]
    full = [-(-n // multiple) * multiple for n in sizes]
    before = [(f - n) // 2 for f, n in zip(full, sizes)]
    rows = cells.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(full[0] - 1).cast("long"))).alias("x"))
    every = rows.select("img", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(full[1] - 1).cast("long"))).alias("y"))
    moved = cells.select("img", (F.col("x") + before[0]).alias("x"), (F.col("y") + before[1]).alias("y"), "v")
    return every.join(moved, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("v", F.lit(cval)).alias("v"))


def displacement_from_reference(cells: DataFrame, x: float, y: float) -> DataFrame:
    """Centre of mass of each image minus a reference."""
    return grid.centre_of_mass(cells).select("img", (F.col("cx") - x).alias("dx"), (F.col("cy") - y).alias("dy"))


def centre_of_points(points: DataFrame, region: str = "region") -> DataFrame:
    """Weighted mean place of each region. points: region, cx, cy, w."""
    return points.groupBy(region).agg((F.sum(F.col("w") * F.col("cx")) / F.sum("w")).alias("mx"), (F.sum(F.col("w") * F.col("cy")) / F.sum("w")).alias("my"))


def compactness(points: DataFrame, floor: float = 0.0, region: str = "region") -> DataFrame:
    """Mean over a region's points of weight times the distance to its centre beyond a floor."""
    joined = points.join(centre_of_points(points, region), region)
    apart = F.sqrt(F.pow(F.col("cx") - F.col("mx"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("my"), F.lit(2.0)))
    return joined.groupBy(region).agg(F.avg(F.col("w") * F.greatest(apart - floor, F.lit(0.0))).alias("penalty"), F.first("mx").alias("mx"), F.first("my").alias("my"))
