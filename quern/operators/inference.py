"""Multiple testing, conjunction, cluster maps and variograms.

Ranks over whole tables come from counts by range of p first, so no step sorts all p-values in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.augment import uniform
from quern.session import staged



def _ranked(rows: DataFrame, p: str) -> tuple[DataFrame, int]:
    """rows with _rank by ascending p (ties by the first column), and their number.

    Ranges hold about as many rows each, however p-values crowd, ties included: Spark samples their bounds.
    """
    order = [p, rows.columns[0]]
    number = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(rows.repartitionByRange(number, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order)
    ranked = ranged.join(F.broadcast(bases), "_range").withColumn("_rank", F.col("_base") + F.row_number().over(inside))
    return ranked, ranged.count()


def bonferroni(rows: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    n = rows.filter(F.col(p).isNotNull()).count()
    return rows.withColumn("q", F.least(F.lit(1.0), F.col(p) * n)).withColumn("reject", F.col("q") <= alpha)


def _step_up(rows: DataFrame, p: str, alpha: float, factor) -> DataFrame:
    """q(i) = min over k >= i of factor(m) p(k) / k, at most 1: minima within ranges, and over the ranges after."""
    ranked, m = _ranked(rows.filter(F.col(p).isNotNull()), p)
    raw = ranked.withColumn("_raw", factor(m) * F.col(p) / F.col("_rank"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    lowest = raw.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(later).alias("_after"))
    inside = Window.partitionBy("_range").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min("_raw").over(inside), F.coalesce("_after", F.lit(1.0)))
    out = raw.join(F.broadcast(lowest), "_range").withColumn("q", q).withColumn("reject", F.col("q") <= alpha)
    return out.drop("_range", "_base", "_rank", "_raw", "_after")


def fdr_bh(rows: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    return _step_up(rows, p, alpha, float)


def fdr_by(rows: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    return _step_up(rows, p, alpha, lambda m: m * harmonic(m))


def harmonic(m: int) -> float:
    """The sum of 1 / k up to m: term by term, or, from 10,000 on, by its expansion."""
    if m < 10_000:
        return sum(1.0 / k for k in range(1, m + 1))
    return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)


def storey_pi0(rows: DataFrame, p: str, lam: float = 0.5) -> DataFrame:
    """One row: the share of true nulls, from 1 / m to 1."""
    m = F.count(p)
    share = F.sum((F.col(p) > lam).cast("double")) / (m * (1 - lam))
    return rows.agg(F.least(F.greatest(share, 1 / m), F.lit(1.0)).alias("pi0"))


def fdr_storey(rows: DataFrame, p: str, alpha: float = 0.05, lam: float = 0.5) -> DataFrame:
    pi0 = storey_pi0(rows, p, lam).first()[0]
    return _step_up(rows, p, alpha, lambda m: m * pi0)


def fdr(rows: DataFrame, p: str, method: str = "bh", alpha: float = 0.05, lam: float = 0.5) -> DataFrame:
    """Adds q and reject by a named method."""
    if method == "storey":
        return fdr_storey(rows, p, alpha, lam)
    return {"bh": fdr_bh, "by": fdr_by, "bonferroni": bonferroni}[method](rows, p, alpha)


def conjunction(stats: list[Column]) -> Column:
    return F.least(*stats)


def conjunction_pvalue(p_values: list[Column]) -> Column:
    return F.greatest(*p_values)


def cluster_size_map(cells: DataFrame, label: str) -> DataFrame:
    """Size of a cell's own component; background (0) has 0."""
    sizes = cells.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    return cells.join(sizes, F.col(label) == F.col("_l")).withColumn("size", F.when(F.col(label) == 0, 0).otherwise(F.col("_n"))).drop("_l", "_n")


def cluster_mass_map(cells: DataFrame, label: str, stat: str, threshold: float) -> DataFrame:
    """Sum over a cell's component of what the statistic exceeds the threshold by; background has 0."""
    sums = cells.groupBy(F.col(label).alias("_l")).agg(F.sum(F.greatest(F.col(stat) - threshold, F.lit(0.0))).alias("_m"))
    return cells.join(sums, F.col(label) == F.col("_l")).withColumn("mass", F.when(F.col(label) == 0, 0.0).otherwise(F.col("_m"))).drop("_l", "_m")


def variogram(points: DataFrame, coordinate: str, value: str, reach: float, bins: int = 25) -> DataFrame:
    """Half mean squared difference by distance bin up to reach, on a line: only points in neighbouring stretches meet."""
    cell = F.floor(F.col(coordinate) / reach)
    left = points.select(F.col(coordinate).alias("_x"), F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_i"), F.explode(F.array(cell, cell - 1)).alias("_c"))
    right = points.select(F.col(coordinate).alias("_y"), F.col(value).alias("_w"), cell.alias("_c"))
    pairs = left.join(right, "_c").filter((F.col("_y") < F.col("_x")) & (F.col("_x") - F.col("_y") <= reach))
    at = F.least(F.floor((F.col("_x") - F.col("_y")) / reach * bins), F.lit(bins - 1))
    return pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), (F.avg(F.pow(F.col("_v") - F.col("_w"), F.lit(2.0))) / 2).alias("gamma"))


def permutation_pvalue(observed: Column, nulls: DataFrame, stat: str, two_sided: bool = True) -> DataFrame:
    """(1 + count of nulls at least as extreme) / (n + 1)."""
    x = F.abs(F.col(stat)) if two_sided else F.col(stat)
    o = F.abs(observed) if two_sided else observed
    return nulls.agg(((1 + F.sum((x >= o).cast("long"))) / (F.count("*") + 1)).alias("p"))


def sign_flips(spark, n: int, n_perm: int, seed: int = 0) -> DataFrame:
    """(perm, obs, sign): plus or minus one by hash of the seed; permutation 0 is the identity."""
    cells = spark.range(n * n_perm).select(F.floor(F.col("id") / n).alias("perm"), (F.col("id") % n).alias("obs"))
    return cells.withColumn("sign", _sign(seed, "perm", "obs"))


def _sign(seed: int, perm: str, obs: str) -> Column:
    return F.when((F.col(perm) > 0) & (uniform(seed, perm, obs) < 0.5), -1).otherwise(1)


def sign_flip_test(rows: DataFrame, keys: list[str], obs: str, value: str, n_perm: int, seed: int = 0) -> DataFrame:
    """keys, t, p: one-sample t against 0 and its two-sided share of permutations of signs, the identity included.

    A row goes once to each permutation and its moments combine before the exchange."""
    spread = rows.select(*keys, obs, value, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_perm"))
    x = F.col(value) * _sign(seed, "_perm", obs)
    stats = spread.groupBy(*keys, "_perm").agg((F.avg(x) / F.sqrt(F.var_samp(x) / F.count("*"))).alias("_t"))
    own = stats.filter("_perm = 0").select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_t").alias("t"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    extreme = F.abs("_t") >= F.abs("t") - 1e-12
    return stats.join(own, on).groupBy(*keys).agg(F.first("t").alias("t"), F.avg(extreme.cast("double")).alias("p"))


def _places(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with _place, from 1, by order among the rows of equal keys. Ranges hold about as many rows each; one that begins
    inside a group goes on from the rows of that group before it, so a large group is spread out."""
    number = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(rows.repartitionByRange(number, *keys, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    parts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_size")).withColumn("_base", F.sum("_size").over(before))
    begun = parts.filter("_base > 0").select("_range", *keys, "_base")  # the first group of a range at most
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(F.broadcast(begun), ["_range", *keys], "left")
    return placed.withColumn("_place", F.col("_place") + F.coalesce("_base", F.lit(0))).drop("_range", "_base")


def permutations(rows: DataFrame, n_perm: int, seed: int = 0) -> DataFrame:
    """(perm, id, source): a random order of the ids of each block, by hash of the seed; permutation 0 is the identity.

    Places come from sorted ranges, so large blocks are spread out too. rows: id, block."""
    drawn = F.when(F.col("perm") == 0, 0.0).otherwise(uniform(seed, "perm", "id"))
    spread = rows.select("id", "block", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm")).withColumn("_drawn", drawn)
    source = _places(spread, ["perm", "block"], ["_drawn", "id"]).select("perm", "block", "_place", F.col("id").alias("source"))
    own = _places(rows.select("id", "block"), ["block"], ["id"])
    return source.join(own.hint("merge"), ["block", "_place"]).select("perm", "id", "source")


def spatial_null_test(rows: DataFrame, surrogates: DataFrame) -> DataFrame:
    """One row: correlation r of x and y (id, x, y) and (1 + surrogates at least as extreme) / (n + 1).
    surrogates: surrogate, id, y. Rows are merged, as their number is no bound for a broadcast."""
    own = rows.agg(F.corr("x", "y").alias("r"))
    nulls = surrogates.join(rows.select("id", "x").hint("merge"), "id").groupBy("surrogate").agg(F.corr("x", "y").alias("_r"))
    both = nulls.join(F.broadcast(own))  # one row
    return both.groupBy("r").agg(((1 + F.sum((F.abs("_r") >= F.abs("r")).cast("long"))) / (F.count("*") + 1)).alias("p"))
