"""Classification, overlap and similarity metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import staged


def bce_with_logits(logit: Column, target: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    p = 1 / (1 + F.exp(-logit))
    right = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * F.pow(1 - right, F.lit(gamma)) * bce_with_logits(logit, target)


def gaussian_nll(x: Column, mean: Column, log_var: Column) -> Column:
    return 0.5 * (F.log(F.lit(6.283185307179586)) + log_var + (x - mean) * (x - mean) / F.exp(log_var))


def domain_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over a mask; the sum of weights is at least 1e-12."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-12))


def dice(pred: Column, target: Column, smooth: float = 1e-7) -> Column:
    return (2 * F.sum(pred * target) + smooth) / (F.sum(pred) + F.sum(target) + smooth)


def jaccard(pred: Column, target: Column, smooth: float = 1e-7) -> Column:
    both = F.sum(pred * target)
    return (both + smooth) / (F.sum(pred) + F.sum(target) - both + smooth)


def ncc(x: Column, y: Column, weight: Column | None = None, eps: float = 1e-8) -> Column:
    """Weighted correlation with eps on the denominator and on the sum of weights."""
    w = F.lit(1.0) if weight is None else weight
    total = F.sum(w) + eps
    mx, my = F.sum(w * x) / total, F.sum(w * y) / total
    cov = F.sum(w * x * y) / total - mx * my
    vx, vy = F.sum(w * x * x) / total - mx * mx, F.sum(w * y * y) / total - my * my
    return cov / (F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))) + eps)


def confusion_matrix(rows: DataFrame, target: str, pred: str, classes: int) -> DataFrame:
    """Counts of all classes x classes cells."""
    counts = rows.groupBy(F.col(target).cast("long").alias("t"), F.col(pred).cast("long").alias("p")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).alias("t"), (F.col("id") % classes).alias("p"))
    return grid.join(counts, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def roc_auc(rows: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney area with average ranks for ties; NaN where a class is absent.

    Counts are taken by distinct score first; scores are then dealt by range of (key, score), whose bounds Spark samples,
    so that running sums need the totals of a key's earlier ranges only.
    """
    ties = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_n"))
    number = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ties = staged(ties.repartitionByRange(number, *keys, "_s").withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = ties.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
    bases = sums.select(*(F.col(k).alias(f"_k{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_rn").over(earlier), F.lit(0)).alias("_base"))
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.join(bases, on)
    below = F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    wins = ties.withColumn("_w", F.col("_p") * (below + F.col("_n") / 2))
    sums = wins.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    area = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_w") / (F.col("_p") * F.col("_n"))).otherwise(float("nan"))
    return sums.select(*keys, area.alias("auc"))


def joint_histogram(rows: DataFrame, a: str, b: str, bins: int = 32) -> DataFrame:
    """(i, j, p): soft histogram in which a value gives its weight to the two nearest bins of each axis linearly."""
    r = rows.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()

    def place(x: str, low: float, high: float) -> Column:
        at = (F.col(x) - low) / ((high - low) or 1.0) * (bins - 1)
        left = F.least(F.floor(at), F.lit(bins - 2))
        return F.array(F.struct(left.alias("i"), (1 - (at - left)).alias("w")), F.struct((left + 1).alias("i"), (at - left).alias("w")))

    placed = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(place(a, r[0], r[1]).alias("x"), place(b, r[2], r[3]).alias("y"))
    cells = placed.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))
    sums = cells.groupBy(F.col("x.i").alias("i"), F.col("y.i").alias("j")).agg(F.sum(F.col("x.w") * F.col("y.w")).alias("w")).filter("w > 0")
    total = placed.count()
    return sums.select("i", "j", (F.col("w") / total).alias("p"))


def mutual_information(histogram: DataFrame, normalized: bool = False, eps: float = 1e-10) -> DataFrame:
    """One row: mutual information (natural logarithm) of a joint histogram, or (H(a) + H(b)) / H(a, b)."""
    pi, pj = histogram.groupBy("i").agg(F.sum("p").alias("pi")), histogram.groupBy("j").agg(F.sum("p").alias("pj"))
    if normalized:
        h = lambda t, c: t.agg(-F.sum(F.col(c) * F.log(F.col(c) + eps))).first()[0]
        value = (h(pi, "pi") + h(pj, "pj")) / max(h(histogram, "p"), eps)
        return histogram.sparkSession.createDataFrame([(float(value),)], "mi double")
    joined = histogram.join(pi, "i").join(pj, "j")
    return joined.agg(F.sum(F.col("p") * F.log((F.col("p") + eps) / (F.col("pi") * F.col("pj") + eps))).alias("mi"))


def correlation_ratio(rows: DataFrame, moving: str, fixed: str, bins: int = 32) -> DataFrame:
    """One row: between-bin share of the variance of moving, bins of fixed soft as in the histogram."""
    r = rows.agg(F.min(fixed), F.max(fixed)).first()
    at = (F.col(fixed) - r[0]) / ((r[1] - r[0]) or 1.0) * (bins - 1)
    left = F.least(F.floor(at), F.lit(bins - 2))
    both = F.array(F.struct(left.alias("i"), (1 - (at - left)).alias("w")), F.struct((left + 1).alias("i"), (at - left).alias("w")))
    soft = rows.select(F.col(moving).alias("x"), F.explode(both).alias("s"))
    byb = soft.groupBy("s.i").agg(F.sum("s.w").alias("w"), F.sum(F.col("s.w") * F.col("x")).alias("wx"), F.sum(F.col("s.w") * F.col("x") * F.col("x")).alias("wxx"))
    sums = byb.agg(F.sum("w").alias("n"), F.sum("wx").alias("t"), F.sum("wxx").alias("q"), F.sum(F.when(F.col("w") > 1e-10, F.col("wx") * F.col("wx") / F.col("w"))).alias("b"))
    mean2 = F.col("t") * F.col("t") / F.col("n")
    return sums.select(((F.col("b") - mean2) / (F.col("q") - mean2)).alias("eta2"))
