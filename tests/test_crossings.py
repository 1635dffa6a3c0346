"""Faces that meet, against all pairs solved as linear systems; faces of very unequal width; surfaces without crossings."""

from itertools import combinations

import numpy as np

from quern.operators import crossings


def tables(spark, v, f):
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(f)], "fid long, a long, b long, c long")
    return vertices.repartition(3), faces.repartition(3)


def plain(v, f):
    def hit(p, q, t):
        m = np.stack([q - p, v[t[0]] - v[t[1]], v[t[0]] - v[t[2]]], axis=1)
        if abs(np.linalg.det(m)) < 1e-9:
            return False
        s, i, j = np.linalg.solve(m, v[t[0]] - p)
        return -1e-9 <= s <= 1 + 1e-9 and i >= -1e-9 and j >= -1e-9 and i + j <= 1 + 1e-9

    def meet(s, t):
        return any(hit(v[a], v[b], u) for w, u in ((s, t), (t, s)) for a, b in ((w[0], w[1]), (w[1], w[2]), (w[2], w[0])))

    return sorted((m, n) for m, n in combinations(range(len(f)), 2) if not set(f[m]) & set(f[n]) and meet(f[m], f[n]))


def found(spark, v, f):
    rows = crossings.self_intersections(*tables(spark, v, f)).collect()
    assert len(rows) == len(set(rows))  # each pair in one bucket
    return sorted((r.fid, r.other) for r in rows)


def test_triangles_of_all_widths(spark):
    rng = np.random.default_rng(2)
    wide = np.repeat(rng.choice([0.3, 0.5, 2.0, 9.0], 120, p=[0.4, 0.4, 0.15, 0.05]), 3)[:, None]
    v = np.repeat(rng.uniform(-4, 4, (120, 3)), 3, axis=0) + wide * rng.normal(size=(360, 3))
    f = np.arange(360).reshape(-1, 3)
    exact = plain(v, f)
    assert len(exact) > 50 and found(spark, v, f) == exact


def test_sheets(spark):
    side = np.array([(x, y) for x in range(6) for y in range(6)], float)
    flat = np.column_stack([side, 0 * side[:, 0]])
    steep = np.column_stack([side + 0.31, side[:, 0] - 2.4])
    cells = np.array([(6 * x + y, 6 * x + y + 1, 6 * x + y + 6) for x in range(5) for y in range(5)] + [(6 * x + y + 1, 6 * x + y + 7, 6 * x + y + 6) for x in range(5) for y in range(5)])
    assert found(spark, flat, cells) == []
    v, f = np.concatenate([flat, steep]), np.concatenate([cells, cells + 36])
    exact = plain(v, f)
    assert exact and found(spark, v, f) == exact


def test_odd_tables(spark):
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0.2, 0.2, -1], [0.2, 0.2, 1], [0.3, 0.2, 1], [np.nan, 0, 0]], float)
    f = np.array([[0, 1, 2], [3, 4, 5], [3, 4, 6], [0, 1, 2]])
    assert found(spark, v, f) == [(0, 1), (1, 3)]  # without the face of an unknown place; equal faces share their vertices
    vertices, faces = tables(spark, v, f)
    assert crossings.self_intersections(vertices, faces.limit(0)).count() == 0


def test_pairs_are_compared_in_slices_of_full_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(0, 3, (240, 3)), 40 + rng.uniform(0, 3, (60, 3))])  # one bucket of 80 faces, and one of 20
    f = np.arange(300).reshape(-1, 3)
    exact = plain(v, f)
    for most, pairs in ((13, 50), (1000, 7)):
        monkeypatch.setattr(crossings, "MOST", most)
        monkeypatch.setattr(crossings, "PAIRS", pairs)
        assert len(exact) > 50 and found(spark, v, f) == exact
