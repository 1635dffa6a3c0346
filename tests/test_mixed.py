"""Mixed models against the dense restricted likelihood, balanced closed forms, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import mixed

SCHEMA = "e string, g long, x double, y double"


def simulated(seed=0, groups=14, slope=True):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("a", "b"):
        for g in range(groups):
            b = rng.normal(size=2) * (1.5, 0.8 if slope else 0.0)
            for x in rng.normal(size=3 + g % 5):
                rows.append((e, g, float(x), float(1 + b[0] + (2 + b[1]) * x + 0.5 * rng.normal())))
    return rows


def dense(rows, cov, s, slope=True):
    """(restricted log-likelihood, beta, cov of beta, effects) with the whole covariance matrix."""
    g = np.array([r[1] for r in rows])
    x = np.array([[1, r[2]] for r in rows])
    y = np.array([r[3] for r in rows])
    z = x if slope else x[:, :1]
    same = g[:, None] == g
    v = (z @ cov @ z.T) * same + s * np.eye(len(y))
    w = np.linalg.inv(v)
    a = x.T @ w @ x
    beta = np.linalg.solve(a, x.T @ w @ y)
    r = y - x @ beta
    loglik = -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + r @ w @ r + (len(y) - 2) * np.log(2 * np.pi))
    effects = {k: cov @ z[g == k].T @ (w @ r)[g == k] for k in set(g.tolist())}
    return loglik, beta, np.linalg.inv(a), effects


@pytest.mark.parametrize("kind", ["slope", "diagonal", "intercept"])
def test_fit_is_a_maximum_of_the_dense_likelihood(spark, kind):
    rows = simulated(slope=kind != "intercept")
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    slope = kind != "intercept"
    z = [F.lit(1.0), F.col("x")] if slope else None
    fit = mixed.lme_fit(table, ["e"], "g", [F.lit(1.0), F.col("x")], F.col("y"), z, diagonal=kind == "diagonal")
    effects = {(r.e, r.g): np.array(r.blup) for r in fit.ranef().collect()}
    r = 2 if slope else 1
    for row in fit.table.collect():
        own = [t for t in rows if t[0] == row.e]
        cov = np.array(row.g).reshape(r, r)
        loglik, beta, spread, blup = dense(own, cov, row.s, slope)
        assert row.converged and row.loglik == pytest.approx(loglik, abs=1e-7)
        assert np.allclose(row.beta, beta, atol=1e-8) and np.allclose(np.array(row.cov).reshape(2, 2), spread, atol=1e-8)
        assert all(np.allclose(effects[row.e, k], v, atol=1e-7) for k, v in blup.items())
        for i in range(r):
            for j in range(i + 1):
                if kind == "diagonal" and i != j:
                    assert cov[i, j] == 0
                    continue
                for h in (1e-3, -1e-3):
                    near = cov.copy()
                    near[i, j] += h
                    near[j, i] = near[i, j]
                    assert dense(own, near, row.s, slope)[0] <= loglik + 1e-9
        assert all(dense(own, cov, row.s * f, slope)[0] <= loglik + 1e-9 for f in (0.99, 1.01))


def test_balanced_intercept_is_the_analysis_of_variance(spark):
    rng = np.random.default_rng(1)
    m, n = 30, 6
    rows = [("a", g, 0.0, float(b + rng.normal())) for g, b in enumerate(2 * rng.normal(size=m)) for _ in range(n)]
    fit = mixed.reml_fit(spark.createDataFrame(rows, SCHEMA), [], "g", [F.lit(1.0)], F.col("y"))
    y = np.array([r[3] for r in rows]).reshape(m, n)
    within = y.var(axis=1, ddof=1).mean()
    between = n * y.mean(axis=1).var(ddof=1)
    row = fit.table.first()
    assert row.s == pytest.approx(within, rel=1e-6) and row.g[0] == pytest.approx((between - within) / n, rel=1e-6)
    t = fit.t_contrast([1.0]).first()
    assert t.effect == pytest.approx(y.mean()) and t.se == pytest.approx(np.sqrt(between / (m * n)), rel=1e-6)
    assert t.df == pytest.approx(m - 1, rel=1e-5)  # Satterthwaite's are exact here
    f = fit.f_contrast([[1.0]]).first()
    assert f.f == pytest.approx(t.t**2) and f.p == pytest.approx(t.p, rel=1e-6) and (f.df1, f.df2) == (1.0, pytest.approx(t.df))


def test_variance_at_zero_and_odd_rows(spark):
    rows = [("a", g, 0.0, float(v)) for g in range(5) for v in (1.0, -1.0, 0.5, -0.5)]  # groups alike: nothing between them
    odd = [("a", None, 0.0, 1.0), ("a", 1, None, 1.0), ("a", 2, 0.0, None), (None, 1, 0.0, 1.0), (None, 1, 0.0, 3.0), (None, 2, 0.0, 7.0)]
    table = spark.createDataFrame(rows + odd, SCHEMA)
    found = {r.e: r for r in mixed.reml_fit(table, ["e"], "g", [F.lit(1.0)], F.col("y")).table.collect()}
    assert set(found) == {"a", None} and found["a"].n == 21 and found[None].n == 3  # x plays no part in this model
    assert 0 < found["a"].g[0] < 1e-3 and np.isfinite(found[None].s)


def test_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixed.reml_fit(empty, ["e"], "g", [F.lit(1.0)], F.col("y")).table.count() == 0
    assert mixed.reml_fit(empty, [], "g", [F.lit(1.0)], F.col("y")).table.count() == 0


def test_predictions_add_group_effects(spark):
    rows = simulated(3)
    table = spark.createDataFrame(rows, SCHEMA)
    x = [F.lit(1.0), F.col("x")]
    fit = mixed.lme_fit(table, ["e"], "g", x, F.col("y"), x)
    unseen = spark.createDataFrame([("a", 999, 0.5, 0.0)], SCHEMA)
    beta = {r.e: r.beta for r in fit.table.collect()}
    alone = fit.predict(unseen, x, x).first().predicted
    assert alone == pytest.approx(beta["a"][0] + 0.5 * beta["a"][1]) == fit.predict(unseen, x).first().predicted
    fixed = {tuple(r[:4]): r.predicted for r in fit.predict(table, x).collect()}
    both = {tuple(r[:4]): r.predicted for r in fit.predict(table, x, x).collect()}
    error = lambda p: sum((k[3] - v) ** 2 for k, v in p.items())
    assert len(both) == len(rows) and error(both) < 0.3 * error(fixed)


def test_exchanged_rounds_equal_held_ones(spark, monkeypatch):
    table = spark.createDataFrame([*simulated(7, 6), (None, 1, 0.0, 1.0), (None, 1, 1.0, 3.0), (None, 2, 2.0, 7.0), (None, 3, 2.0, 6.0)], SCHEMA)
    x = [F.lit(1.0), F.col("x")]
    held = {r.e: r for r in mixed.reml_fit(table, ["e"], "g", x, F.col("y"), rounds=8).table.collect()}
    monkeypatch.setattr(mixed, "MOST_HELD", 0)
    far = {r.e: r for r in mixed.reml_fit(table, ["e"], "g", x, F.col("y"), rounds=8).table.collect()}
    assert set(held) == set(far) == {"a", "b", None}
    assert all(np.allclose(held[e].beta, far[e].beta, atol=1e-9) and held[e].loglik == pytest.approx(far[e].loglik) and held[e].rounds == far[e].rounds for e in held)
