"""Exact rounds against a plain loop, bounds that hold, and odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import drift_means as D

SCHEMA = "vec_id long, embedding array<float>, _v int, cluster string"


def plain(rows, k, rounds, dims):
    """Lloyd's rounds in Python's own integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in kept[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        for j, m in members.items():
            centroids[j] = [sum(x) // len(m) for x in zip(*m)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    own = lambda j: sum(d for _, d, c in found if c == j)
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, j, d, own(j), total, digest(j)) for i, d, j in found), key=str)


def ours(spark, rows, k, rounds, dims):
    table = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    found, centroids, scans = D.cluster(table, k, rounds, dims=dims)
    return sorted((tuple(r) for r in D.digest(found, centroids).collect()), key=str), scans


def test_rounds_equal_plain_loop_and_bounds_save_scans(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middles[i % 6] + 0.05 * rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # copies of one vector
    got, scans = ours(spark, rows, 7, 5, 8)
    assert got == plain(rows, 7, 5, 8)
    assert scans[-1] < 900 / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 0.0]), (8, [0.0, -inf]), (None, [-1.5, 0.25]), (9, [-1e-9, 3.0])]
    for k in (1, 2, 40):
        assert ours(spark, rows, k, 5, 2)[0] == plain(rows, k, 5, 2)


def test_empty_table(spark):
    assert ours(spark, [], 3, 5, 2)[0] == []
    assert ours(spark, [(1, None)], 3, 5, 2)[0] == []


def test_components_too_large_for_exact_sums_are_an_error(spark):
    with pytest.raises(Exception, match="reaches 2"):
        ours(spark, [(1, [1e30, 0.0])], 1, 1, 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6), st.floats(0.01, 30))
def test_no_point_of_a_sphere_comes_nearer_than_the_loosening(seed, dims, radius):
    rng = np.random.default_rng(seed)
    before = rng.normal(size=(4, dims)) * 5
    after = before + rng.normal(size=(4, dims)) * rng.choice([0.0, 0.1, 3.0], size=(4, 1))
    loose = D.loosening(before, after, np.full(4, radius))
    drift = np.sqrt(((after - before) ** 2).sum(axis=1))
    for i in range(4):
        x = rng.normal(size=(400, dims))
        x = before[i] + radius * x / np.sqrt((x**2).sum(axis=1))[:, None] * rng.uniform(0, 1, (400, 1)) ** 0.3
        for j in set(range(4)) - {i}:
            nearer = np.sqrt(((x - before[j]) ** 2).sum(axis=1)) - np.sqrt(((x - after[j]) ** 2).sum(axis=1))
            assert nearer.max() <= loose[i] + 1e-9
        assert loose[i] <= max(drift[j] for j in range(4) if j != i) + 1e-9


def test_loosening_is_less_than_drift_for_small_spheres():
    before, after = np.array([[0.0, 0.0], [10.0, 0.0]]), np.array([[0.0, 0.0], [10.0, 4.0]])
    assert D.loosening(before, after, np.array([0.5, 0.5]))[0] < 0.3 * 4
