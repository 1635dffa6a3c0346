"""The robust fits run their rounds to the end, as plain loops do; a scan about guesses finds the very order statistics or none."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import models, quantiles
from quern.plans import covariances

DATA = "/root/testdata/sf0.001"
WEIGHTS = {
    "huber_regress": lambda u: np.minimum(1.0, 1.345 / np.maximum(np.abs(u), 1e-300)),
    "tukey_regress": lambda u: np.where(np.abs(u) <= 4.685, (1 - (u / 4.685) ** 2) ** 2, 0.0),
}


def plain(x, y, weight, rounds):
    w = np.ones(len(y))
    for k in range(rounds + 1):
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        e = y - x @ beta
        scale = 1.4826 * np.median(np.abs(e - np.median(e)))
        w = weight(e / scale)
    return [*beta, scale]


@pytest.mark.parametrize("name", ["huber_regress", "tukey_regress"])
def test_queries_take_twenty_rounds(spark, name):
    lines = pd.read_parquet(f"{DATA}/lineitem.parquet")
    got = {r["l_returnflag"]: [r["b0"], r["b1"], r["scale"]] for r in covariances.QUERIES[name](spark, DATA).collect()}
    two = 0.0
    for k, t in lines.groupby("l_returnflag"):
        x = np.stack([np.ones(len(t)), t["l_quantity"].to_numpy(float)], axis=1)
        y = t["l_extendedprice"].to_numpy(float) / 1000 + t["l_linenumber"].to_numpy(float) ** 2
        assert got[k] == pytest.approx(plain(x, y, WEIGHTS[name], 20), abs=2e-6)
        two = max(two, np.abs(np.subtract(got[k], plain(x, y, WEIGHTS[name], 2))).max())
    assert two > 1e-3  # two rounds are not enough


def test_scans_about_guesses(spark, monkeypatch):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=1001), None: rng.exponential(size=500), "t": np.repeat([1.0, 2.0, 3.0, 9.0], [20, 30, 20, 5])}
    table = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double").repartition(3)
    want = {k: (float(np.median(v)), float(np.median(np.abs(v - np.median(v))))) for k, v in groups.items()}
    near = {(k,): (m + 0.01, d - 0.01, 0.1) for k, (m, d) in want.items()}
    got = quantiles.spread_near(table, ["k"], "v", near)
    assert {k: got[k,][:2] for k in groups} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert 0 < got["a",][2] < 300
    assert quantiles.spread_near(table, ["k"], "v", near | {("a",): (0.9, 0.5, 0.01)}) == {}  # median elsewhere
    assert quantiles.spread_near(table, ["k"], "v", near | {("a",): (want["a"][0], 0.2, 0.05)}) == {}  # deviation elsewhere
    monkeypatch.setattr(quantiles, "MOST_NEAR", 20)
    assert quantiles.spread_near(table, ["k"], "v", near) is None


@pytest.mark.parametrize("most", [400_000, 30])
def test_fits_by_guesses_equal_plain_loops(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_NEAR", most)
    monkeypatch.setattr(models, "MOST_NEAR", most)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 1)), rng.standard_t(2, size=400)
    table = spark.createDataFrame([(float(a), float(2 * a + b)) for (a,), b in zip(x, y)], "x double, y double")
    calls, once = [], models.spread_near
    monkeypatch.setattr(models, "spread_near", lambda *a: calls.append(once(*a)) or calls[-1])
    got = models.robust_fit(table, [], [F.lit(1.0), F.col("x")], F.col("y"), "huber", 8).first()
    assert [*got["beta"], got["scale"]] == pytest.approx(plain(np.hstack([np.ones((400, 1)), x]), 2 * x[:, 0] + y, WEIGHTS["huber_regress"], 8), abs=1e-9)
    assert len(calls) == 8 and (any(calls) if most > 400 else True)
