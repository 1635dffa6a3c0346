"""Matrix products and edge aggregation over a choice of algebra, on coordinate tables.

An algebra combines two values, then reduces by an aggregate that merges partial results, so Spark combines before the
exchange. Absent cells are the algebra's annihilator: they never take part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Algebra:
    name: str
    combine: Callable[[Column, Column], Column]
    reduce: Callable[[Column], Column]
    zero: float | bool


def log_sum_exp(x: Column) -> Column:
    """ln of the sum of exp(x), by a buffer of maxima and scaled sums; of only -inf, -inf."""
    top = F.max(x)
    total = F.sum(F.exp(x))  # exact enough where exp neither over- nor underflows; `stable_log_sum` handles the rest
    return F.when(top == float("-inf"), top).otherwise(F.log(total))


def stable_log_sum(terms: DataFrame, keys: list[str], value: str) -> DataFrame:
    """ln of the sum of exp(value) by keys, in two passes: maxima, then sums scaled by them."""
    tops = terms.groupBy(*keys).agg(F.max(value).alias("_top"))
    scaled = F.when(F.col("_top") == float("-inf"), 0.0).otherwise(F.exp(F.col(value) - F.col("_top")))
    sums = terms.join(tops, keys).groupBy(*keys).agg(F.first("_top").alias("_top"), F.sum(scaled).alias("_sum"))
    out = F.when(F.col("_top") == float("-inf"), F.col("_top")).otherwise(F.col("_top") + F.log("_sum"))
    return sums.select(*keys, out.alias("value"))


REAL = Algebra("real", lambda a, b: a * b, F.sum, 0.0)
LOG = Algebra("log", lambda a, b: a + b, log_sum_exp, float("-inf"))
MAX_PLUS = Algebra("max_plus", lambda a, b: a + b, F.max, float("-inf"))
MIN_PLUS = Algebra("min_plus", lambda a, b: a + b, F.min, float("inf"))
BOOLEAN = Algebra("boolean", lambda a, b: (a != 0) & (b != 0), F.bool_or, False)
EUCLIDEAN = Algebra("euclidean", lambda a, b: (a - b) * (a - b), lambda x: F.sqrt(F.greatest(F.sum(x), F.lit(0.0))), 0.0)
ALGEBRAS = {a.name: a for a in (REAL, LOG, MAX_PLUS, MIN_PLUS, BOOLEAN, EUCLIDEAN)}


def matmul(a: DataFrame, b: DataFrame, algebra: Algebra = REAL, batch: tuple[str, ...] = ()) -> DataFrame:
    """C(i, j) from A(i, k, v) and B(k, j, v): one equi-join on k and an aggregate."""
    right = b.select(*(F.col(c).alias(f"_b_{c}") for c in batch), F.col("k").alias("_k"), "j", F.col("v").alias("_w"))
    on = F.col("k") == F.col("_k")
    for c in batch:
        on = on & (F.col(c) == F.col(f"_b_{c}"))
    terms = a.join(right, on).select(*batch, "i", "j", algebra.combine(F.col("v"), F.col("_w")).alias("_t"))
    if algebra is LOG:
        return stable_log_sum(terms, [*batch, "i", "j"], "_t")
    return terms.groupBy(*batch, "i", "j").agg(algebra.reduce(F.col("_t")).alias("value"))


def edge_matmul(edges: DataFrame, b: DataFrame, algebra: Algebra = REAL) -> DataFrame:
    """Row i reduces over its edges (src, dst, value): the product of a sparse matrix and B(k, j, v)."""
    return matmul(edges.select(F.col("src").alias("i"), F.col("dst").alias("k"), F.col("value").alias("v")), b, algebra)


def edge_rmatvec(edges: DataFrame, x: DataFrame) -> DataFrame:
    """Y = transpose(A) X over the reals; x: id, v."""
    terms = edges.join(x, F.col("src") == F.col("id")).select("dst", (F.col("value") * F.col("v")).alias("_t"))
    return terms.groupBy("dst").agg(F.sum("_t").alias("value"))


def edge_aggregate(edges: DataFrame, x: DataFrame, edge_fn: Callable[[Column, Column, Column], Column], algebra: Algebra = REAL) -> DataFrame:
    """reduce over edges of edge_fn(x_src, x_dst, weight) by src; x: id, v."""
    ends = edges.join(x.select(F.col("id").alias("src"), F.col("v").alias("_xs")), "src").join(x.select(F.col("id").alias("dst"), F.col("v").alias("_xd")), "dst")
    return ends.groupBy("src").agg(algebra.reduce(edge_fn(F.col("_xs"), F.col("_xd"), F.col("value"))).alias("value"))


def row_softmax(edges: DataFrame) -> DataFrame:
    """Softmax of edge values within each src; maxima and sums are aggregates joined back."""
    tops = edges.groupBy("src").agg(F.max("value").alias("_top"))
    raised = edges.join(tops, "src").withColumn("_e", F.exp(F.col("value") - F.col("_top")))
    sums = raised.groupBy("src").agg(F.sum("_e").alias("_sum"))
    return raised.join(sums, "src").select("src", "dst", (F.col("_e") / F.col("_sum")).alias("value"))


def edges_from_dense(cells: DataFrame, threshold: float = 0.0, k_max: int | None = None, symmetrize: bool = False) -> DataFrame:
    """Cells (src, dst, value) with abs(value) above the threshold, the k_max largest of a row, halves of both directions."""
    kept = cells.filter(F.abs("value") > threshold)
    if k_max is not None:
        order = Window.partitionBy("src").orderBy(F.abs("value").desc(), "dst")
        kept = kept.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k_max).drop("_n")
    if symmetrize:
        swapped = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")
        kept = kept.select("src", "dst", "value").unionByName(swapped).groupBy("src", "dst").agg((F.sum("value") / 2).alias("value"))
    return kept.select("src", "dst", "value")


def masked_edges(edges: DataFrame, valid: DataFrame) -> DataFrame:
    """Edges into valid columns (id); a dropped edge is the annihilator in every algebra."""
    return edges.join(valid.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "value")


def add_self_loops(edges: DataFrame, fill: str = "mean", self_value: float = 1.0) -> DataFrame:
    how = {"mean": F.avg("value"), "add": F.sum("value"), "zero": F.lit(0.0), "value": F.lit(self_value)}[fill]
    loops = edges.groupBy("src").agg(F.first(how).alias("value") if fill in ("zero", "value") else how.alias("value"))
    return edges.select("src", "dst", "value").unionByName(loops.select("src", F.col("src").alias("dst"), "value"))


def to_dense(edges: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """All cells of the matrix; duplicates sum and the rest is 0. The index grid is generated, cell by cell."""
    grid = edges.sparkSession.range(n_rows * n_cols).select((F.col("id") / n_cols).cast("long").alias("src"), (F.col("id") % n_cols).alias("dst"))
    sums = edges.groupBy("src", "dst").agg(F.sum("value").alias("value"))
    return grid.join(sums, ["src", "dst"], "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))


def conv1d(cells: DataFrame, taps: list[float], algebra: Algebra = REAL, stride: int = 1, dilation: int = 1) -> DataFrame:
    """Convolution of (series, t, v) with centred taps in an algebra; cells off the ends are absent."""
    half = len(taps) // 2
    kernel = F.explode(F.array(*(F.struct(F.lit((n - half) * dilation).alias("shift"), F.lit(float(w)).alias("w")) for n, w in enumerate(taps))))
    shifted = cells.select("series", "t", "v", kernel.alias("k")).select("series", (F.col("t") - F.col("k.shift")).alias("t"), algebra.combine(F.col("v"), F.col("k.w")).alias("_t"))
    inside = shifted.join(cells.select("series", "t"), ["series", "t"], "left_semi").filter(F.col("t") % stride == 0)
    if algebra is LOG:
        return stable_log_sum(inside, ["series", "t"], "_t")
    return inside.groupBy("series", "t").agg(algebra.reduce(F.col("_t")).alias("value"))
