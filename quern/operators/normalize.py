"""Group statistics joined back to rows: centring, scaling and clipping.

Statistics are aggregated by key with map-side combine and joined back, so a hot key never gathers its rows in one task;
quantiles come from counts by range (see `quantiles`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.quantiles import group_quantiles, with_group_quantiles

EPS = 1e-12


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """df with one column for each statistic of its key group; without keys, of all rows."""
    table = df.groupBy(*keys).agg(*(v.alias(k) for k, v in stats.items()))
    if not keys:
        first = table.first()
        return df.select("*", *(F.lit(first[k]).alias(k) for k in stats))
    renamed = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return joined.join(renamed, condition).drop(*(f"_k_{k}" for k in keys))


def demean(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    mean = F.sum(F.col(value) * w) / F.sum(F.when(F.col(value).isNotNull(), w))
    return with_group_stats(df, keys, _m=mean).withColumn("demeaned", F.col(value) - F.col("_m")).drop("_m")


def zscore(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS, nonzero: bool = False) -> DataFrame:
    """(x - mean) / (population deviation + eps); with nonzero, over the non-zero values, and zeros stay zero."""
    x = F.when(F.col(value) != 0, F.col(value)) if nonzero else F.col(value)
    out = (F.col(value) - F.col("_m")) / (F.col("_s") + eps)
    out = F.when(F.col(value) == 0, 0.0).otherwise(out) if nonzero else out
    return with_group_stats(df, keys, _m=F.avg(x), _s=F.stddev_pop(x)).withColumn("z", out).drop("_m", "_s")


def psc(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS) -> DataFrame:
    out = 100 * (F.col(value) - F.col("_m")) / (F.col("_m") + eps)
    return with_group_stats(df, keys, _m=F.avg(value)).withColumn("psc", out).drop("_m")


def instance_norm(df: DataFrame, keys: Sequence[str], value: str, eps: float = 1e-5) -> DataFrame:
    out = (F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + eps)
    return with_group_stats(df, keys, _m=F.avg(value), _v=F.var_pop(value)).withColumn("normed", out).drop("_m", "_v")


def robust_zscore(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS) -> DataFrame:
    """(x - median) / (1.4826 median absolute deviation + eps)."""
    centred = with_group_quantiles(df, keys, value, _m=0.5).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = with_group_quantiles(centred, keys, "_d", _s=0.5)
    return spread.withColumn("robust_z", (F.col(value) - F.col("_m")) / (1.4826 * F.col("_s") + eps)).drop("_m", "_d", "_s")


def mad(df: DataFrame, keys: Sequence[str], value: str, normalize: bool = True) -> DataFrame:
    centred = with_group_quantiles(df, keys, value, _m=0.5).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    scale = 1.4826 if normalize else 1.0
    return group_quantiles(centred, keys, "_d", [0.5]).select(*keys, (scale * F.get("q", F.lit(0))).alias("mad"))


def winsorize(df: DataFrame, keys: Sequence[str], value: str, lower: float = 0.005, upper: float = 0.995) -> DataFrame:
    both = with_group_quantiles(df, keys, value, _lo=lower, _hi=upper)
    return both.withColumn("clipped", F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))).drop("_lo", "_hi")


def intensity_normalize(df: DataFrame, keys: Sequence[str], value: str, low: float = 1.0, high: float = 99.0, eps: float = EPS) -> DataFrame:
    both = with_group_quantiles(df, keys, value, _lo=low / 100, _hi=high / 100)
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return both.withColumn("scaled", (clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + eps)).drop("_lo", "_hi")


def percentile_rescale(df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.0, hi: float = 99.0, clip: bool = True, eps: float = EPS) -> DataFrame:
    """(x - p_lo) / (p_hi + eps), clipped to [0, 1]; the divisor is the upper percentile itself."""
    both = with_group_quantiles(df, keys, value, _lo=lo / 100, _hi=hi / 100)
    out = (F.col(value) - F.col("_lo")) / (F.col("_hi") + eps)
    out = F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clip else out
    return both.withColumn("rescaled", out).drop("_lo", "_hi")


def match_histogram(moving: DataFrame, reference: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Values of moving mapped linearly between quantiles of the two columns."""
    points = [i / (bins - 1) for i in range(bins)]
    source = group_quantiles(moving, [], value, points).first()["q"]
    target = group_quantiles(reference, [], value, points).first()["q"]
    knots = [(a, b) for n, (a, b) in enumerate(zip(source, target)) if n == 0 or a > source[n - 1]]
    table = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in knots))
    above = F.size(F.filter(table, lambda k: k["a"] <= F.col(value)))
    low, high = F.get(table, F.greatest(above - 1, F.lit(0))), F.get(table, F.least(above, F.lit(len(knots) - 1)))
    share = F.when(high["a"] > low["a"], (F.col(value) - low["a"]) / (high["a"] - low["a"])).otherwise(0.0)
    return moving.withColumn("matched", low["b"] + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (high["b"] - low["b"]))
