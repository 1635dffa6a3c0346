"""Quantiles by repeated scans equal NumPy's, with ranges cut again, ties, nulls and heavy tails; robust fits don't exchange rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import models, quantiles


@pytest.mark.parametrize("most, ranges", [(1_000_000, 1024), (5, 3)])
def test_scanned_quantiles(spark, monkeypatch, most, ranges):
    monkeypatch.setattr(quantiles, "MOST_ORDERED", most)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    rng = np.random.default_rng(8)
    groups = {"a": rng.normal(size=101), "b": np.repeat([1.0, 2.0, 7.0], [30, 3, 20]), None: np.exp(3 * rng.normal(size=40)), "c": np.array([4.0]), "d": np.array([1.0, 1.0, 1e12, -3.0])}
    table = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "k string, v double").repartition(3)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in quantiles.scanned_quantiles(table, ["k"], "v", at).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, at).tolist(), abs=1e-12)
    assert quantiles.scanned_quantiles(table, [], "v", [0.5]).first()["q"][0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    assert quantiles.scanned_quantiles(table.limit(0), [], "v", [0.5]).count() == 0


@pytest.mark.parametrize("kind", ["huber"])
def test_robust_fits_of_few_groups_are_scans(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=300), rng.standard_t(2, size=300)
    table = spark.createDataFrame([("ab"[i % 2], float(a), float(b + a)) for i, (a, b) in enumerate(zip(x, y))], "k string, x double, y double")
    fit = lambda: {r["k"]: (*r["beta"], r["scale"]) for r in models.robust_fit(table, ["k"], [F.lit(1.0), F.col("x")], F.col("y"), kind, 2).collect()}
    monkeypatch.setattr(models, "MOST_SCANNED", 1)
    exchanged = fit()
    monkeypatch.setattr(models, "MOST_SCANNED", 64)
    monkeypatch.setattr(models, "mad", None)
    scanned = fit()
    assert all(scanned[k] == pytest.approx(exchanged[k], abs=1e-9) for k in "ab")
