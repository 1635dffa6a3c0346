"""Scans over ranges and blocks against plain loops: long series, slow filters, small batches, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import filters, scans


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    yield
    spark.conf.set(key, before)


def looped(sos, x):
    """The cascade of difference equations in extended precision."""
    y = np.asarray(x, np.longdouble)
    for b0, b1, b2, _, a1, a2 in np.asarray(sos, np.longdouble):
        out, p, q = np.empty_like(y), np.longdouble(0), np.longdouble(0)
        for k, v in enumerate(y):
            o = b0 * v + p
            p, q = b1 * v - a1 * o + q, b2 * v - a2 * o
            out[k] = o
        y = out
    return y.astype(float)


@pytest.mark.parametrize("cut", [0.2, 1e-5])
@pytest.mark.parametrize("batch", ["1000", "10000"])
def test_long_series_equals_loop(spark, cut, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    sos = filters.butterworth_sos(2, "lowpass", hi=cut)
    rows = spark.range(300_000).select(F.lit(1).alias("s"), F.col("id").alias("t"), (1 + F.sin(F.col("id") / 777)).alias("v"))
    got = filters.sosfilt(rows, "s", "t", "v", sos).toPandas().sort_values("t")["filtered"].to_numpy()
    spark.conf.set(key, before)
    want = looped(sos, 1 + np.sin(np.arange(300_000) / 777))
    assert np.allclose(got, want, atol=1e-9 * max(1, np.abs(want).max()))


def test_series_of_all_lengths(spark, small_batches, monkeypatch):
    sos = filters.butterworth_sos(3, "bandpass", lo=0.05, hi=0.1)
    rng = np.random.default_rng(0)
    series = {name: rng.normal(size=n) for name, n in (("a", 1), ("b", 2), ("c", 9000), ("d", 1), ("e", 4096), (None, 50), ("f", 12_289), ("g", 3))}
    table = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "s string, t long, v double").repartition(5)
    got = filters.sosfilt(table, "s", "t", "v", sos).toPandas()
    for name, x in series.items():
        mine = got[got["series"].isna()] if name is None else got[got["series"] == name]
        assert np.allclose(mine.sort_values("t")["filtered"], looped(sos, x), atol=1e-10)


def test_selective_scan_of_a_long_series_equals_loop(spark, small_batches):
    n = 200_000
    a = np.array([[-0.5, -1e-4], [-1.0, -0.02]])
    k = np.arange(n)
    rows = spark.range(n).select(F.lit("z").alias("s"), F.col("id").alias("t"), F.sin(F.col("id") / 9).alias("x"), (1 + F.cos(F.col("id") / 5)).alias("d"))
    inputs = [F.col("x"), -F.col("x")], [F.col("d"), F.col("d") / 2], [F.lit(1.0), F.col("x")], [F.lit(0.5), F.col("d")]
    got = scans.selective_scan(rows, "s", "t", inputs[0], inputs[1], a, inputs[2], inputs[3], np.array([0.1, 0.2])).toPandas().sort_values("t")
    h, want = np.zeros((2, 2)), np.empty((n, 2))
    for i in k:
        x, d = np.sin(i / 9), 1 + math.cos(i / 5)
        u, delta, b, c = np.array([x, -x]), np.array([d, d / 2]), np.array([1.0, x]), np.array([0.5, d])
        h = np.exp(delta[:, None] * a) * h + delta[:, None] * b * u[:, None]
        want[i] = (h * c).sum(axis=1) + np.array([0.1, 0.2]) * u
    assert np.allclose(np.stack(got["y"]), want, atol=1e-8)


def test_nulls_and_no_rows(spark):
    sos = filters.butterworth_sos(1, "lowpass", hi=0.1)
    table = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 2.0)], "s string, t long, v double")
    got = [r.filtered for r in filters.sosfilt(table, "s", "t", "v", sos).orderBy("t").collect()]
    assert np.allclose(got, looped(sos, [1.0, 0.0, 2.0]))
    assert filters.sosfilt(table.limit(0), "s", "t", "v", sos).count() == 0
