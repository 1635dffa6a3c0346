"""Optimality of sparse precisions, orthogonality and singular values of tall decompositions."""

import numpy as np
import pytest

from quern.operators import factors


def entries(spark, s):
    return spark.createDataFrame([(i, j, float(s[i, j])) for i in range(len(s)) for j in range(len(s))], "i int, j int, value double").repartition(3)


def conditions(s, theta, lam):
    """Largest violation of the optimality conditions."""
    w = np.linalg.inv(theta)
    gap, off = w - s, ~np.eye(len(s), dtype=bool)
    at = off & (theta != 0)
    return max(np.abs(np.diag(gap)).max(), np.abs(gap[at] - lam * np.sign(theta[at])).max(initial=0), np.abs(gap[off & (theta == 0)]).max(initial=0) - lam)


@pytest.mark.parametrize("lam", [0.02, 0.1, 0.3, 5.0])
def test_precision_meets_the_conditions(spark, lam):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 12))
    x[:, 1] += x[:, 0]
    x[:, 5:8] += 1.5 * x[:, 5:6]
    s = np.cov(x.T)
    theta = np.zeros_like(s)
    for r in factors.glasso(entries(spark, s), lam).collect():
        theta[r.i, r.j] = r.value
    assert np.allclose(theta, theta.T) and conditions(s, theta, lam) <= 1e-6
    assert (np.count_nonzero(theta) == 12) == (lam == 5.0)


def test_precision_without_penalty_is_the_inverse_and_bad_variances_fail(spark):
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    got = {(r.i, r.j): r.value for r in factors.glasso(entries(spark, s), 0.0).collect()}
    assert np.allclose([[got[i, j] for j in range(2)] for i in range(2)], np.linalg.inv(s), atol=1e-8)
    with pytest.raises(Exception, match="not positive"):
        factors.glasso(entries(spark, np.array([[0.0, 0.0], [0.0, 1.0]])), 0.1).collect()
    assert factors.glasso(entries(spark, np.zeros((0, 0))), 0.1).count() == 0


def matrix(spark, x, parts):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>").repartition(parts)


@pytest.mark.parametrize("parts", [1, 40])
def test_tall_r_and_basis(spark, parts, monkeypatch):
    monkeypatch.setattr(factors, "FAN", 3)
    x = np.random.default_rng(1).normal(size=(900, 7)) @ np.diag(10.0 ** np.arange(0, -7, -1))
    rows = matrix(spark, x, parts)
    r = factors.tall_r(rows, "v", 7)
    assert np.allclose(np.triu(r), r) and np.allclose(r.T @ r, x.T @ x, atol=1e-10)
    q = np.array([row.v for row in factors.orthonormal(rows, "v", 7).collect()])
    assert np.abs(q.T @ q - np.eye(7)).max() < 1e-10


def test_singular_triplets(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 30)) + 1e-3 * rng.normal(size=(500, 30))
    table, s, vt = factors.randomized_svd(matrix(spark, x, 5), "id", "v", 6)
    u = np.array([r.u for r in table.orderBy("id").collect()])
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:6], rtol=1e-9)
    assert np.abs(u.T @ u - np.eye(6)).max() < 1e-10 and np.abs(vt @ vt.T - np.eye(6)).max() < 1e-10
    left, exact, right = np.linalg.svd(x, full_matrices=False)
    assert np.abs(u * s @ vt - left[:, :6] * exact[:6] @ right[:6]).max() < 1e-6


def test_odd_matrices(spark):
    none, s, _ = factors.randomized_svd(matrix(spark, np.zeros((0, 3)), 1), "id", "v", 2)
    assert none.count() == 0 and len(s) == 0
    low = np.outer(np.arange(1.0, 9), [1.0, 2.0, 2.0])  # rank one
    table, s, vt = factors.randomized_svd(matrix(spark, low, 3), "id", "v", 2)
    assert s[0] == pytest.approx(np.linalg.norm(low)) and s[1] == pytest.approx(0, abs=1e-9)
    assert np.allclose(vt[0], [1 / 3, 2 / 3, 2 / 3])
