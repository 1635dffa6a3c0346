"""Operators against NumPy on small made-up tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import graph, inference, metrics, models, normalize, semiring, series


def test_log_matmul_of_only_minus_infinity_stays_minus_infinity(spark):
    a = spark.createDataFrame([(0, 0, float("-inf")), (0, 1, float("-inf"))], "i int, k int, v double")
    b = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "k int, j int, v double")
    assert semiring.matmul(a, b, semiring.LOG).first()["value"] == float("-inf")


@pytest.mark.parametrize("name", ["real", "log", "max_plus", "min_plus", "euclidean"])
def test_matmul_matches_numpy(spark, name):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 4)), rng.normal(size=(4, 3))
    table = lambda m, x, y: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], f"{x} int, {y} int, v double")
    out = semiring.matmul(table(a, "i", "k"), table(b, "k", "j"), semiring.ALGEBRAS[name]).toPandas()
    s, p = a[:, :, None] + b[None], a[:, :, None] * b[None]
    want = {"real": p.sum(1), "log": np.log(np.exp(s).sum(1)), "max_plus": s.max(1), "min_plus": s.min(1), "euclidean": np.sqrt(((a[:, :, None] - b[None]) ** 2).sum(1))}[name]
    for r in out.itertuples():
        assert r.value == pytest.approx(want[r.i, r.j])


def test_conv1d_real_is_correlation(spark):
    x = np.arange(8.0)
    cells = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(x)], "series int, t int, v double")
    out = semiring.conv1d(cells, [1.0, 2.0, 3.0]).orderBy("t").toPandas()
    assert np.allclose(out["value"], np.correlate(x, [1.0, 2.0, 3.0], "same"))


def test_components_of_a_long_path_and_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    nodes = spark.createDataFrame([(7,), (200,)], "id long")
    found = {r["id"]: r["label"] for r in graph.connected_components(edges, nodes).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100 and found[200] == 200


def test_chebyshev_filter_of_degree_two(spark):
    w = np.array([[0, 1, 0.5], [1, 0, 2], [0.5, 2, 0]])
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(3) if w[i, j]], "src long, dst long, value double")
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(3)], "id long, v double")
    d = w.sum(1)
    lap = np.eye(3) - w / np.sqrt(np.outer(d, d))
    t = 2 / 2.0 * lap - np.eye(3)
    v = np.array([1.0, 2, 3])
    want = 0.5 * v + 0.3 * t @ v + 0.2 * (2 * t @ t @ v - v)
    got = graph.chebyshev_filter(edges, x, [0.5, 0.3, 0.2], 2.0).orderBy("id").toPandas()["value"]
    assert np.allclose(got, want)


def test_zscore_keeps_zeros_and_null_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 0.0), ("a", 2.0), ("a", 4.0)], "k string, v double")
    out = {(r["k"], r["v"]): r["z"] for r in normalize.zscore(rows, ["k"], "v", nonzero=True).collect()}
    assert out[("a", 0.0)] == 0.0 and out[(None, 1.0)] == pytest.approx(-1.0) and out[("a", 4.0)] == pytest.approx(1.0)


def test_match_histogram_of_a_shift(spark):
    a = spark.createDataFrame([(float(v),) for v in range(50)], "x double")
    b = spark.createDataFrame([(float(v) + 10,) for v in range(50)], "x double")
    out = normalize.match_histogram(a, b, "x", 11).toPandas()
    assert np.allclose(out["matched"], out["x"] + 10)


def test_roc_auc_with_ties_and_an_absent_class(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1)], "k string, s double, y int")
    out = {r["k"]: r["auc"] for r in metrics.roc_auc(rows, "s", "y", ("k",)).collect()}
    assert out["a"] == pytest.approx(3.5 / 4) and np.isnan(out["b"])
    assert metrics.roc_auc(rows.filter("k = 'a'"), "s", "y").first()["auc"] == pytest.approx(3.5 / 4)


def test_fdr_bh_matches_a_plain_loop(spark):
    p = np.random.default_rng(3).uniform(size=200) ** 2
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id int, p double")
    got = inference.fdr_bh(rows, "p").orderBy("id").toPandas()["q"].to_numpy()
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1]
    want = np.empty(200)
    want[order] = np.minimum(q, 1)
    assert np.allclose(got, want)


def test_interpolation_of_a_series_without_observations_is_zero(spark):
    rows = spark.createDataFrame([(0, 0, 5.0, False), (0, 1, 7.0, False), (1, 0, 1.0, True), (1, 1, 9.0, False), (1, 2, 3.0, True), (1, 3, 9.0, False)], "s int, t int, v double, seen boolean")
    out = series.linear_interpolate(rows, "s", "t", "v", "seen").orderBy("s", "t").toPandas()["filled"].tolist()
    assert out == [0.0, 0.0, 1.0, 2.0, 3.0, 3.0]


def test_analytic_signal_of_a_cosine():
    t = np.arange(64)
    out = series.analytic(np.cos(2 * np.pi * 4 * t / 64))
    assert np.allclose(out["im"], np.sin(2 * np.pi * 4 * t / 64)) and np.allclose(out["envelope"], 1)


def test_irls_recovers_poisson_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = rng.poisson(np.exp(0.3 + 0.5 * x))
    rows = spark.createDataFrame(pd.DataFrame({"k": 0, "x": x, "y": y.astype(float)}))
    beta = models.irls(rows, ["k"], [F.lit(1.0), F.col("x")], F.col("y"), "poisson").first()["beta"]
    assert beta == pytest.approx([0.3, 0.5], abs=0.05)


def test_pca_and_whitening(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ np.diag([3.0, 1.0, 0.3])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    mean, cov, n = models.covariance(rows, "v")
    assert n == 300 and np.allclose(cov, np.cov(x.T))
    z = np.array([r["z"] for r in models.projected(rows, "v", models.whitening(cov), mean).orderBy("id").collect()])
    assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-8)
    components, values, _ = models.pca(rows, "v", 1)
    assert np.allclose(values[0], np.linalg.eigvalsh(np.cov(x.T))[-1]) and components[0][np.abs(components[0]).argmax()] > 0


def test_sinkhorn_marginals(spark):
    cost = spark.createDataFrame([(i, j, abs(i - j) / 2) for i in range(4) for j in range(3)], "i int, j int, cost double")
    a = spark.createDataFrame([(i, 0.25) for i in range(4)], "i int, a double")
    b = spark.createDataFrame([(j, 1 / 3) for j in range(3)], "j int, b double")
    plan = models.sinkhorn(spark, cost, a, b, 1.0, 8).groupBy("j").agg(F.sum("p").alias("p")).toPandas()["p"]
    assert np.allclose(plan, 1 / 3)


def test_kmeans_keeps_the_centroid_of_an_empty_cluster(spark):
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 9, 10])], "id int, v array<double>")
    out = models.kmeans(rows, "v", np.array([[0.0], [10.0], [500.0]]))
    assert out.ravel().tolist() == [0.5, 9.5, 500.0]
