"""Sparse precision, singular triplets and Ward clusters of the vectors. No SQL: tests/test_factors.py checks optimality and
NumPy's values, tests/test_linkage.py the trees of plain merging."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import factors, linkage, models
from quern.sources.tables import read


def _covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cov, _ = models.covariance(read(spark, sf_dir, "embeddings"), "embedding")  # d x d numbers
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(cov)], "i int, j int, value double")


def glasso(spark, sf_dir):
    out = factors.glasso(_covariance(spark, sf_dir), 0.001)
    return out.select("i", "j", F.round("value", 4).alias("value"))


def randomized_svd(spark, sf_dir):
    table, s, _ = factors.randomized_svd(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3)
    return table.select("vec_id", *(F.round(F.col("u")[i] * float(v), 5).alias(f"z{i}") for i, v in enumerate(s)))


def ward_linkage(spark, sf_dir):
    """Eight clusters of the vectors."""
    return linkage.ward_linkage(read(spark, sf_dir, "embeddings"), 8, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "label")


def ward_heights(spark, sf_dir):
    return linkage.ward_tree(read(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("a", "b", F.round("height", 5).alias("height"), "n")


QUERIES = {"ward_linkage": ward_linkage, "ward_heights": ward_heights, "glasso": glasso, "randomized_svd": randomized_svd}
ORACLE_SQL: dict = {}
