"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import discard, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b): label is the smallest v of its component.

    Each round a vertex takes the smallest label among its neighbours', then its label's label, so that the labels of a
    path of any length meet in logarithmically many rounds in practice. Every round ends in a written table.
    """
    both = staged(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct())
    labels = staged(both.groupBy("v").agg(F.least(F.min("w"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "w"}), "w").groupBy("v").agg(F.min("label").alias("_near"))
        lower = labels.join(near, "v", "left").select("v", "label", F.least("label", F.coalesce("_near", "label")).alias("_low"))
        of = labels.select(F.col("v").alias("_v"), F.col("label").alias("_of"))
        jumped = lower.join(of, F.col("_low") == F.col("_v"), "left").select(
            "v", F.least("_low", F.coalesce("_of", "_low")).alias("label"), (F.least("_low", F.coalesce("_of", "_low")) != F.col("label")).alias("_moved")
        )
        moved = staged(jumped)
        discard(labels)
        labels = moved.select("v", "label")
        if moved.filter("_moved").isEmpty():
            discard(both)
            return labels
