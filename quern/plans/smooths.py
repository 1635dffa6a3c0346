"""Additive models of line items. No SQL: smoothing parameters come from matrix traces; tests/test_smooths.py compares dense ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import smooths
from quern.sources.tables import read


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return columns.withColumn("price", F.col("l_extendedprice") / 1000)


def _prices(rows: DataFrame) -> smooths.Gam:
    """Price on smooths of quantity and discount and on the tax, a model for each flag."""
    terms = [smooths.bspline_smooth(F.col("l_quantity"), 1.0, 50.0), smooths.bspline_smooth(F.col("l_discount"), 0.0, 0.1, 8)]
    return smooths.gam_fit(rows, ["l_returnflag"], terms, F.col("price"), [F.col("l_tax")])


def _summary(fit: smooths.Gam) -> DataFrame:
    numbers = [F.round(c, 3).alias(c) for c in ("edf_total", "dispersion", "deviance", "null_deviance")]
    return fit.table.select("l_returnflag", F.transform("edf", lambda v: F.round(v, 3)).alias("edf"), *numbers, "n")


def gam_fit(spark, sf_dir):
    return _summary(_prices(_rows(spark, sf_dir)))


def gam_poisson(spark, sf_dir):
    """Quantities, as counts, on a smooth of the discount and a cyclic one of the price."""
    terms = [smooths.bspline_smooth(F.col("l_discount"), 0.0, 0.1, 8), smooths.cyclic_smooth(F.col("price") % 10, 0.0, 10.0, 8)]
    return _summary(smooths.gam_fit(_rows(spark, sf_dir), ["l_returnflag"], terms, F.floor("l_quantity"), family="poisson"))


def gam_predict(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _prices(rows).predict(rows).select("l_orderkey", "l_linenumber", F.round("predicted", 4).alias("predicted"))


def smooth_partial_effect(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = _prices(rows).partial_effect(rows, 0)
    return out.select("l_orderkey", "l_linenumber", F.round("effect", 4).alias("effect"), F.round("se", 4).alias("se"))


QUERIES = {"gam_fit": gam_fit, "gam_poisson": gam_poisson, "gam_predict": gam_predict, "smooth_partial_effect": smooth_partial_effect}
ORACLE_SQL: dict = {}
