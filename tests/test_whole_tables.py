"""Queries use whole tables, images and vectors: against plain computations on small made-up tables."""

import numpy as np
import pytest

from quern.plans import algebra, modelling, spatial


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_connected_components_uses_every_order(spark, tmp_path):
    lines = [(1, 1, 1), (1, 2, 5), (2, 1, 5), (2, 2, 3), (64, 1, 7), (64, 2, 8), (65, 1, 9), (65, 3, 2)]  # the last are not consecutive
    folder = written(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_suppkey long"), supplier=([(i, 0.0) for i in range(1, 10)], "s_suppkey long, s_acctbal double"))
    root = {i: i for i in range(1, 10)}
    for order, n, a in lines:
        for b in [s for o, m, s in lines if (o, m) == (order, n + 1)]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert {r["id"]: r["label"] for r in algebra.components(spark, folder).collect()} == root


def test_tfce_covers_the_whole_image(spark, tmp_path):
    values = {(e // 100, e % 100): float((e * 7919) % 101) + (40.0 if e // 100 == 11 and e % 100 < 60 else 0.0) for e in range(1400)}
    folder = written(spark, tmp_path, events=([(x * 100 + y, v) for (x, y), v in values.items()], "event_id long, value double"))
    want, step = dict.fromkeys(values, 0.0), max(values.values()) / 4
    for n in range(1, 5):
        left = {c for c, v in values.items() if v > n * step}
        while left:
            part, edge = set(), [left.pop()]
            while edge:
                x, y = edge.pop()
                part.add((x, y))
                for near in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                    if near in left:
                        left.remove(near)
                        edge.append(near)
            for c in part:
                want[c] += len(part) ** 0.5 * (n * step) ** 2 * step
    got = {(r["x"], r["y"]): r["v"] for r in spatial.tfce(spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-3) for c in want)


def test_vector_queries_use_every_dimension(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(90, 12)) * np.linspace(0.5, 3.0, 12)  # the last entries vary most
    folder = written(spark, tmp_path, embeddings=([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    of = lambda name: sorted(modelling.QUERIES[name](spark, folder).collect(), key=lambda r: r[0])
    s = np.cov(x.T, bias=True)
    assert of("shrinkage")[0]["mu"] == pytest.approx(np.trace(s) / 12, abs=1e-5)
    z = np.array([r["z"] for r in of("whiten")])
    assert np.allclose(np.cov(z.T), np.eye(12), atol=1e-8)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(np.var([[r["z0"], r["z1"]] for r in of("pca")], axis=0, ddof=1), values[:2], atol=1e-4)
    centroids = x[:4]
    for _ in range(20):
        cluster = ((x[:, None] - centroids) ** 2).sum(2).argmin(1)
        before, centroids = centroids, np.array([x[cluster == c].mean(0) for c in range(4)])
        if np.abs(centroids - before).max() <= 1e-4:
            break
    assert [r["cluster"] for r in of("kmeans")] == ((x[:, None] - centroids) ** 2).sum(2).argmin(1).tolist()
    p, w, h = np.maximum(x, 0), np.ones((90, 2)), np.abs(np.sin(np.arange(24) + 1.0)).reshape(2, 12)
    for _ in range(5):
        w = w * (p @ h.T) / (w @ (h @ h.T) + 1e-10)
        h = h * (w.T @ p) / (w.T @ w @ h + 1e-10)
    assert np.allclose([[r["w0"], r["w1"]] for r in of("nmf")], w, atol=1e-5)
