"""Eigenvalues and eigenspaces against NumPy's, on graphs with gaps, with ties, with parts, and too small ones."""

import numpy as np
import pytest

from quern.operators import spectra


def table(spark, a):
    i, j = np.nonzero(a)
    rows = list(zip(i.tolist(), j.tolist(), a[i, j].tolist()))
    return spark.createDataFrame(rows, "src int, dst int, value double").repartition(3)


def gathered(found, n):
    rows = {r.id: r.vector for r in found.collect()}
    return np.array([rows[i] for i in range(n)])


def clusters(n=60, seed=0):
    rng = np.random.default_rng(seed)
    of = np.arange(n) % 3
    a = (rng.uniform(size=(n, n)) < np.where(of[:, None] == of, 0.5, 0.03)) * rng.uniform(0.5, 1.5, (n, n))
    return np.triu(a, 1)  # not symmetric: each edge is told once


def companion(a, alpha=0.0):
    w = (a + a.T) / 2
    d = w.sum(axis=1)
    w = w / (d[:, None] * d) ** alpha
    d = w.sum(axis=1)
    return w / np.sqrt(d[:, None] * d), d


def test_laplacian_eigenmap(spark):
    a = clusters()
    found, values = spectra.laplacian_eigenmap(table(spark, a), 3)
    exact, vectors = np.linalg.eigh(np.eye(60) - companion(a)[0])
    assert np.allclose(values, exact[1:4], atol=1e-7)
    v = gathered(found, 60)
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    own = vectors[:, 1:4]
    assert np.abs(np.abs((v * own).sum(axis=0)) - 1).max() < 1e-6
    assert all(v[np.abs(v[:, j]).argmax(), j] > 0 for j in range(3))


def test_diffusion_embedding(spark):
    a = clusters(seed=1)
    found, values = spectra.diffusion_embedding(table(spark, a), 2, alpha=0.5, t=2.0)
    m, d = companion(a, 0.5)
    exact, vectors = np.linalg.eigh(m)
    assert np.allclose(values, exact[::-1][1:3], atol=1e-7)
    want = vectors[:, ::-1][:, 1:3] / np.sqrt(d)[:, None] * exact[::-1][1:3] ** 2
    got = gathered(found, 60)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


@pytest.mark.parametrize("n,k", [(200, 4)])
def test_larger_graph_than_the_space(spark, n, k):
    """A path's Laplacian spectrum is known; the block does not fill the space."""
    a = np.zeros((n, n))
    a[np.arange(n - 1), np.arange(1, n)] = np.exp(-np.arange(n - 1) / 30)
    m = (a + a.T)
    found, values = spectra.eigenvectors(table(spark, m), spark.range(n).selectExpr("cast(id AS int) AS id"), k, steps=25)
    exact = np.linalg.eigvalsh(m)[::-1][:k]
    assert np.allclose(values, exact, atol=1e-7)
    v = gathered(found, n)
    assert np.abs(m @ v - v * values).max() < 1e-5


def test_parts_and_small_graphs(spark):
    two = np.zeros((6, 6))
    two[0, 1] = two[1, 2] = two[0, 2] = two[3, 4] = two[4, 5] = two[3, 5] = 1.0  # two triangles: the value 1 stands twice
    found, values = spectra.laplacian_eigenmap(table(spark, two), 2, skip_trivial=False)
    assert np.allclose(values, 0, atol=1e-9)
    v = gathered(found, 6)
    p = v @ v.T
    assert np.allclose(p, np.kron(np.eye(2), np.full((3, 3), 1 / 3)), atol=1e-8)
    _, few = spectra.laplacian_eigenmap(table(spark, two), 20, skip_trivial=False)
    assert np.allclose(few, np.linalg.eigvalsh(np.eye(6) - companion(two)[0]), atol=1e-9)
    none, values = spectra.laplacian_eigenmap(table(spark, np.zeros((2, 2))), 1)
    assert none.count() == 0 and len(values) == 0
