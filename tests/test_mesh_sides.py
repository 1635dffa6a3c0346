"""The cotangent Laplacian joins corners once; faces with a vertex twice; rings from pairs held in one direction."""

import numpy as np

from quern.operators import mesh


def test_laplacian_of_sides(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(7, 3))
    f = [(0, 1, 2), (1, 3, 2), (2, 3, 4), (5, 5, 6)]
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long")
    out = mesh.cotangent_laplacian(vertices, faces)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    plain = {}
    for t in f:
        for o, p, q in (t, (t[1], t[2], t[0]), (t[2], t[0], t[1])):
            u, w = v[p] - v[o], v[q] - v[o]
            half = u @ w / max(np.linalg.norm(np.cross(u, w)), 1e-12) / 2
            for one, two in ((p, q), (q, p)):
                plain[one, two, False] = plain.get((one, two, False), 0) - half
                plain[one, one, True] = plain.get((one, one, True), 0) + half
    rows = out.collect()
    assert sorted((r.src, r.dst) for r in rows) == sorted(k[:2] for k in plain)
    got = np.zeros((7, 7))
    for r in rows:
        got[r.src, r.dst] += r.value
    want = np.zeros((7, 7))
    for (i, j, _), value in plain.items():
        want[i, j] += value
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_rings_by_partitions_that_grow(spark, monkeypatch):
    f = [(0, 1, 2), (1, 3, 2), (2, 3, 4), (4, 6, 7), (5, 5, 6)]
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid long, a long, b long, c long")
    monkeypatch.setattr(mesh, "RING_ROWS", 1)
    near = {(p, q) for t in f for p in t for q in t if p != q} | {(5, 5)}
    plain = {e: 1 for e in near}
    for hop in (2, 3):
        for (p, m), (n, q) in ((x, y) for x in list(plain) for y in near):
            if m == n and p != q:
                plain[p, q] = min(plain.get((p, q), 9), plain[p, m] + 1)
        got = [((r.src, r.dst), r.hops) for r in mesh.k_ring(faces, hop).collect()]
        assert len(got) == len(dict(got)) and dict(got) == {e: n for e, n in plain.items() if n <= hop}
