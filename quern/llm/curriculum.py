"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over training time 0 to 1 whose integral is its target. Documents of a source queue
in a fixed pseudo-random order (MD5 of the id); the cumulative tokens before a document, epoch by epoch, are demand
that the integrated schedule reaches at some time: inverting it gives the document's training position. Documents sort
by range of position.

Prefix sums run in two steps, so that a source with any share of the rows is spread out: sums by (source, bucket),
where a bucket is a range of the hash, and running sums inside a bucket.

Defined results: null text has size 0, null source is a source of its own and sorts last, a null id hashes as the
empty string. Documents of size 0, and those that the mix leaves out, have taken 0, no occurrences and no position.
Repeated rows each count. The last document that a target reaches is taken in part, so a source's taken words equal
its target to the nearest word. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import staged

WEIGHTS = (5, 2, 1)
#: How a source's weight changes over time, by its place in the cycle of weights: weight * (1 + tilt * (2t - 1)).
TILTS = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
#: Rows of one source and bucket that are summed in one task, at most, on average: the number of buckets follows.
SUMMED_TOGETHER = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: columns source, source_size, target, tilt.

    Shares by weight of all words; a target stops at max_epochs times its source's size and the excess is shared anew
    by weight. In the order of size by weight, a source stops if its cap is at most its share of what the sources
    before it left, so one pass finds the fixed point.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))
    ranked = by_source.select("*", pick([float(w) for w in weights]).alias("_w"), pick([float(t) for t in tilts]).alias("tilt"))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / F.sum("_w").over(rest)).withColumn("_at", F.row_number().over(order))
    ranked = ranked.withColumn("_stops", F.col("_cap") <= F.col("_w") * F.col("_level"))
    free = F.min(F.when(~F.col("_stops"), F.struct("_at", "_level"))).over(everything)["_level"]
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_w") * free)
    return ranked.select("source", "source_size", target.alias("target"), "tilt")


def inverted(share: Column, tilt: Column) -> Column:
    """The time at which demand t + tilt * (t * t - t) reaches share; both run from 0 to 1."""
    b = 1 - tilt
    root = 2 * share / (b + F.sqrt(F.greatest(b * b + 4 * tilt * share, F.lit(0.0))))
    return F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))


def bucket_digits(rows: int) -> int:
    """Hex digits of the hash that name a bucket, if all rows are of one source: 16 ** digits buckets."""
    digits = 1
    while 16**digits * SUMMED_TOGETHER < rows:
        digits += 1
    return digits


def curriculum_mix(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: doc_id, source, size. Adds source_size, target, taken, position and occurrences to each row.

    occurrences: one struct (epoch, take, position) for each time that the document comes up in training.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = staged(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size"), key.alias("_key")))
    sizes = sizes.withColumn("_bucket", F.substring("_key", 1, bucket_digits(sizes.count())))
    targets = source_targets(sizes, weights, tilts, max_epochs).withColumnRenamed("source", "_source")
    buckets = sizes.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    known = buckets.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_base", "source_size", "target", "tilt"
    )
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("_goal", F.round("target").cast("long"))
    epochs = F.sequence(F.lit(0), F.lit(max_epochs))

    def occurrence(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("_before")
        take = F.greatest(F.least(F.col("size"), F.col("_goal") - start), F.lit(0))
        return F.struct(epoch.alias("epoch"), take.alias("take"), inverted(start / F.greatest("_goal", F.lit(1)), F.col("tilt")).alias("position"))

    rows = rows.withColumn("occurrences", F.filter(F.transform(epochs, occurrence), lambda o: o["take"] > 0))
    taken = F.aggregate("occurrences", F.lit(0).cast("long"), lambda n, o: n + o["take"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("occurrences", F.lit(0))["position"].alias("position"), "occurrences")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The documents sorted by range of their first position; those without one last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
