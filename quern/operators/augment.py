"""Intensity changes, noise and simulated data; random numbers come from seeds and hashes, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) by MD5 of the seed and the keys, alike in every engine that has MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def draw(spark: SparkSession, seed: int) -> float:
    """One number in (0, 1)."""
    return spark.range(1).select(uniform(seed, "id")).first()[0]


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number by hash of the keys."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def gamma_contrast(cells: DataFrame, value: str, gamma: float, keys: list[str]) -> DataFrame:
    """clip((x - lo) / (hi - lo), 0, 1) ^ gamma * (hi - lo) + lo by image."""
    ends = cells.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    share = F.least(F.greatest((F.col(value) - F.col("_lo")) / span, F.lit(0.0)), F.lit(1.0))
    return cells.join(ends, keys).withColumn("contrast", F.pow(share, F.lit(gamma)) * span + F.col("_lo")).drop("_lo", "_hi")


def gaussian_noise(cells: DataFrame, value: str, sigma: float, seed: int, keys: list[str]) -> DataFrame:
    return cells.withColumn("noisy", F.col(value) + sigma * normal(seed, *keys))


def rician_noise(cells: DataFrame, value: str, sigma: float, seed: int, keys: list[str]) -> DataFrame:
    real = F.col(value) + sigma * normal(seed, *keys)
    return cells.withColumn("noisy", F.sqrt(real * real + F.pow(sigma * normal(seed + 7, *keys), F.lit(2.0))))


def random_flip(cells: DataFrame, seed: int, p: float = 0.5) -> DataFrame:
    """Each axis mirrored with probability p."""
    ends = cells.agg(F.max("x"), F.max("y")).first()
    for k, (c, last) in enumerate(zip("xy", ends)):
        if draw(cells.sparkSession, seed + k) < p:
            cells = cells.withColumn(c, last - F.col(c))
    return cells


def random_crop(cells: DataFrame, seed: int, height: int, width: int) -> DataFrame:
    """A window of this size at a random place; indices begin at 0."""
    ends = cells.agg(F.max("x"), F.max("y")).first()
    for k, (c, last, size) in enumerate(zip("xy", ends, (height, width))):
        start = math.floor(draw(cells.sparkSession, seed + k) * max(last + 2 - size, 1))
        cells = cells.filter((F.col(c) >= start) & (F.col(c) < start + size)).withColumn(c, F.col(c) - start)
    return cells


def histogram_shift(cells: DataFrame, value: str, shifts: list[float]) -> DataFrame:
    """Values mapped linearly between equally spaced points of their range, each moved by a share of it; points keep their order."""
    low, high = cells.agg(F.min(value), F.max(value)).first()
    span, n = max(high - low, 1e-12), len(shifts) - 1
    points = []
    for k, shift in enumerate(shifts):
        points.append(max([*points, k / n + shift]))
    at = (F.col(value) - low) / span * n
    k = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    table = F.array(*map(F.lit, points))
    moved = F.get(table, k) + (at - k) * (F.get(table, k + 1) - F.get(table, k))
    return cells.withColumn(value, low + span * moved)


def label_image(labels: DataFrame, parameters: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Mean plus deviation times a normal number by label, at least 0. parameters: label, mean, std."""
    return labels.join(parameters, "label").withColumn("v", F.greatest(F.col("mean") + F.col("std") * normal(seed, *keys), F.lit(0.0))).drop("mean", "std")


def mixed_signals(mixture: DataFrame, sources: DataFrame) -> DataFrame:
    """observed(i, t) = sum over k of mixture(i, k) sources(k, t)."""
    return mixture.join(sources, "k").groupBy("i", "t").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def sparse_mixture(spark: SparkSession, observed: int, latent: int, expected: float = 3.0, seed: int = 0) -> DataFrame:
    """Rows of about `expected` non-zero weights that sum to one in size: i, k, w."""
    cells = spark.range(observed * latent).select(F.floor(F.col("id") / latent).alias("i"), (F.col("id") % latent).alias("k"))
    kept = cells.filter(uniform(seed, "i", "k") < expected / latent).withColumn("_w", normal(seed + 3, "i", "k"))
    sizes = kept.groupBy("i").agg(F.sum(F.abs("_w")).alias("_s"))
    return kept.join(sizes, "i").select("i", "k", (F.col("_w") / F.col("_s")).alias("w"))


def max_pool(cells: DataFrame, size: int) -> DataFrame:
    """Largest value of each size x size block and where it stands."""
    best = F.max_by(F.struct("x", "y"), F.struct("v", -F.col("x"), -F.col("y")))
    pooled = cells.groupBy("img", F.floor(F.col("x") / size).alias("px"), F.floor(F.col("y") / size).alias("py")).agg(F.max("v").alias("v"), best.alias("at"))
    return pooled.select("img", "px", "py", "v", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def max_unpool(cells: DataFrame, pooled: DataFrame) -> DataFrame:
    """Pooled values back at their places, zeros elsewhere."""
    placed = pooled.select("img", "x", "y", "v")
    return cells.select("img", "x", "y").join(placed, ["img", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def markov_paths(spark: SparkSession, chains: int, steps: int, transition: list[list[float]], seed: int = 0) -> DataFrame:
    """(chain, t, state): states by cumulative probabilities, each chain an array folded in its own row."""
    table = F.array(*(F.array(*(F.lit(float(sum(row[: k + 1]))) for k in range(len(row)))) for row in transition))
    draws = F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda t: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), t), F.lit(1 << 40)) + 0.5) / float(1 << 40))
    path = F.aggregate(draws, F.array(F.lit(0)), lambda s, u: F.concat(s, F.array(F.least(F.size(F.filter(F.get(table, F.element_at(s, -1)), lambda c: c < u)), F.lit(len(transition) - 1)))))
    return spark.range(chains).select(F.col("id").alias("chain"), F.posexplode(path).alias("t", "state"))


def squared_distance_transform(cells: DataFrame) -> DataFrame:
    """Exact squared distance of cells (img, x, y, v) to the nearest cell with v = 0: nearest in the row by windows, then
    the best of (x - k)^2 + row(k) over a column, whose terms stop at the row's own distance. Null in an image without zeros."""
    row = Window.partitionBy("img", "x").orderBy("y")
    zero = F.when(F.col("v") == 0, F.col("y"))
    back, ahead = F.last(zero, True).over(row), F.first(zero, True).over(row.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("y") - back, ahead - F.col("y"))
    height = cells.agg(F.max("x") - F.min("x") + 1).first()[0]
    g = cells.select("img", "x", "y", "v", near.alias("g"))
    own = g.select("img", "x", "y", F.least(F.coalesce("g", F.lit(height)), F.lit(height)).alias("_reach"))
    sent = own.select("img", "y", F.col("x").alias("_x"), F.explode(F.sequence(F.col("x") - F.col("_reach"), F.col("x") + F.col("_reach"))).alias("k"))
    terms = sent.join(g.select("img", "y", F.col("x").alias("k"), F.col("g").alias("_g")), ["img", "y", "k"])
    return terms.groupBy("img", F.col("_x").alias("x"), "y").agg(F.min(F.pow((F.col("_x") - F.col("k")).cast("double"), F.lit(2.0)) + F.pow("_g", F.lit(2.0))).alias("d2"))
