"""Attention of a query set, contrastive losses within batches, and directions. Batches are the groups that pairs are formed in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import geometry
from quern.functions.arrays import dot, lp_normalize
from quern.functions.sums import default_scale, vmf_concentration
from quern.operators.kernels import weighted_sums


def attention(queries: DataFrame, rows: DataFrame, width: int, scale: float | None = None) -> DataFrame:
    """Softmax-weighted sums of values for a stated query set against all rows: q_id, i, x.

    queries: q_id, q_vec; rows: id, vec (keys) and val (values). Each group of rows gives its own maximum and sums."""
    scale = default_scale(width) if scale is None else scale
    found = weighted_sums(queries, rows, width, scale)
    tops = found.groupBy("q_id").agg(F.max("top").alias("_top"))
    raised = found.join(tops, "q_id").select("q_id", F.exp(F.col("top") - F.col("_top")).alias("w"), F.posexplode("sums").alias("i", "v"))
    sums = raised.groupBy("q_id", "i").agg(F.sum(F.col("w") * F.col("v")).alias("s"))  # the last place sums the weights
    total = sums.filter(F.col("i") == width).select("q_id", F.col("s").alias("_total"))
    return sums.filter(F.col("i") < width).join(total, "q_id").select("q_id", "i", (F.col("s") / F.col("_total")).alias("x"))


def info_nce(rows: DataFrame, temperature: float = 0.5) -> DataFrame:
    """Symmetric loss of each pair (a, b) against the others of its batch: id, loss. rows: batch, id, a, b."""
    left = rows.select("batch", F.col("id").alias("i"), lp_normalize(F.col("a")).alias("a"))
    right = rows.select("batch", F.col("id").alias("j"), lp_normalize(F.col("b")).alias("b"))
    pairs = left.join(right, "batch").select("i", "j", (dot(F.col("a"), F.col("b")) / temperature).alias("l"))  # a batch has a bounded size
    both = pairs.groupBy("i").agg(F.log(F.sum(F.exp("l"))).alias("_r"), F.max(F.when(F.col("i") == F.col("j"), F.col("l"))).alias("_own"))
    other = pairs.groupBy("j").agg(F.log(F.sum(F.exp("l"))).alias("_c"))
    return both.join(other, F.col("i") == F.col("j")).select(F.col("i").alias("id"), (-0.5 * (2 * F.col("_own") - F.col("_r") - F.col("_c"))).alias("loss"))


def koleo(rows: DataFrame, eps: float = 1e-8) -> DataFrame:
    """-log of the distance to the nearest other unit vector of the batch: id, value; alone in a batch, the farthest place."""
    unit = rows.select("batch", "id", lp_normalize(F.col("v")).alias("v"))
    other = unit.select("batch", F.col("id").alias("_j"), F.col("v").alias("_w"))
    near = unit.join(other, "batch").groupBy("id").agg(F.max(F.when(F.col("id") != F.col("_j"), dot(F.col("v"), F.col("_w")))).alias("_s"))
    distance = F.sqrt(F.greatest(2 - 2 * F.coalesce("_s", F.lit(-1.0)), F.lit(0.0)))
    return near.select("id", (-F.log(distance + eps)).alias("value"))


def masked_mean(rows: DataFrame, key: str, value: str, mask: str) -> DataFrame:
    """Mean by key over the mask; 0 where it is empty."""
    return rows.groupBy(key).agg((F.sum(F.col(value) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1e-12))).alias("mean"))


def vmf_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean direction x, y, z, resultant length and concentration of unit vectors by key."""
    means = rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in "xyz")).withColumn("resultant", geometry.norm([F.col(c) for c in "xyz"]))
    return means.select(*keys, *((F.col(c) / F.col("resultant")).alias(c) for c in "xyz"), "resultant", vmf_concentration(F.col("resultant")).alias("kappa"))
