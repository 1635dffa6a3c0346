"""Tables made from parameters: grids, operators, Toeplitz matrices and series coefficients."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_grid(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """All (i, j) of a grid, made in parallel."""
    return spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))


def grid_identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("value"))


def grid_operator(spark: SparkSession, rows: int, columns: int, offsets: Sequence[tuple[int, int, float]], boundary: str = "replicate") -> DataFrame:
    """Edges of a stencil on a grid; beyond an edge it replicates the last cell, wraps around, or is dropped (zero)."""
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in offsets))
    at = index_grid(spark, rows, columns).select("i", "j", F.explode(table).alias("o"))
    i, j = F.col("i") + F.col("o.a"), F.col("j") + F.col("o.b")
    if boundary == "wrap":
        i, j = F.pmod(i, F.lit(rows)), F.pmod(j, F.lit(columns))
    elif boundary == "replicate":
        i, j = F.least(F.greatest(i, F.lit(0)), F.lit(rows - 1)), F.least(F.greatest(j, F.lit(0)), F.lit(columns - 1))
    else:
        at = at.filter((i >= 0) & (i < rows) & (j >= 0) & (j < columns))
    cells = at.select((F.col("i") * columns + F.col("j")).alias("src"), (i * columns + j).alias("dst"), F.col("o.w").alias("value"))
    return cells.groupBy("src", "dst").agg(F.sum("value").alias("value"))


def grid_laplacian(spark: SparkSession, rows: int, columns: int, boundary: str = "replicate", spacing: float = 1.0) -> DataFrame:
    w = 1 / spacing**2
    return grid_operator(spark, rows, columns, [(0, 0, -4 * w), (1, 0, w), (-1, 0, w), (0, 1, w), (0, -1, w)], boundary)


def toeplitz(spark: SparkSession, column: Sequence[float], row: Sequence[float] | None = None) -> DataFrame:
    """Cells (i, j, value) whose value depends on i - j."""
    row = column if row is None else row
    down, right = F.array(*map(F.lit, map(float, column))), F.array(*map(F.lit, map(float, row)))
    d = (F.col("i") - F.col("j")).cast("int")
    return index_grid(spark, len(column), len(row)).select("i", "j", F.when(d >= 0, F.get(down, d)).otherwise(F.get(right, -d)).alias("value"))


def chebyshev_coefficients(fn: Callable[[float], float], order: int, low: float = -1.0, high: float = 1.0) -> list[float]:
    """Coefficients of a function on [low, high] by quadrature at Chebyshev nodes."""
    n = max(order + 1, 64)
    nodes = [math.cos(math.pi * (k + 0.5) / n) for k in range(n)]
    values = [fn((high - low) / 2 * x + (high + low) / 2) for x in nodes]
    out = [2 / n * sum(v * math.cos(m * math.pi * (k + 0.5) / n) for k, v in enumerate(values)) for m in range(order + 1)]
    return [out[0] / 2, *out[1:]]


def sym_to_vec(cells: DataFrame, offset: int = 1) -> DataFrame:
    """Upper triangle of (i, j, value) as (k, value) in row order; k is counted from the indices, without a sort."""
    n = cells.agg(F.max("i")).first()[0] + 1
    i, j = F.col("i"), F.col("j")
    before = i * (n - offset + 1) - F.floor(i * (i + 1) / 2)
    return cells.filter(j >= i + offset).select((before + j - i - offset).cast("long").alias("k"), "value")
