"""Tails, matrices and simulated data against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import tails
from quern.operators import augment, linalg


def test_tail_probabilities(spark):
    assert tails.incomplete_beta(5.0, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)  # t of 10 degrees
    assert tails.incomplete_gamma(2.5, 11.0705 / 2) == pytest.approx(0.05, abs=1e-5)  # chi-squared of 5 degrees
    assert tails.incomplete_beta(3.0, 2.0, [0.0, 1.0, 0.5]) == pytest.approx([0, 1, 0.3125])
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    rows = spark.createDataFrame([(2.228139, 10.0, 3.325835, 4.0)], "t double, n double, f double, a double")
    out = rows.select(tails.t_pvalue("t", "n").alias("p"), tails.f_pvalue("f", "a", F.lit(10.0) + 0.0).alias("q"), tails.normal_pvalue("t").alias("z")).first()
    assert out["p"] == pytest.approx(0.05, abs=1e-6) and out["z"] == pytest.approx(math.erfc(2.228139 / math.sqrt(2)))
    x = np.random.default_rng(0).f(4, 10, 200_000)
    assert out["q"] == pytest.approx((x > 3.325835).mean(), abs=3e-3)


def test_triangle_and_back(spark):
    m = np.array([[1.0, 2, 3], [2, 4, 5], [3, 5, 6]])
    for offset in (0, 1):
        vec = m[np.triu_indices(3, offset)]
        cells = linalg.vec_to_sym(spark.createDataFrame([(k, float(v)) for k, v in enumerate(vec)], "k long, value double"), 3, offset).collect()
        out = np.zeros((3, 3))
        for r in cells:
            out[r["i"], r["j"]] = r["value"]
        assert np.allclose(out, m if offset == 0 else m - np.diag(np.diag(m)))


def test_matrix_functions_and_tangent_space(spark):
    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    rows = spark.createDataFrame([(a.ravel().tolist(),)], "m array<double>")
    of = lambda c: np.array(rows.select(c.alias("x")).first()["x"]).reshape(2, 2)
    root = of(linalg.spd_function("sqrt")(F.col("m")))
    assert np.allclose(root @ root, a) and np.allclose(of(linalg.spd_function("exp")(linalg.spd_function("log")(F.col("m")))), a)
    r = np.array([[1.5, 0.2], [0.2, 0.7]])
    assert np.allclose(of(linalg.tangent_project(r, True)(linalg.tangent_project(r)(F.col("m")))), a)
    mean = linalg.mean_log_euclidean(rows.union(rows), "m").first()["mean"]
    assert np.allclose(np.array(mean).reshape(2, 2), a)


def test_conjugate_gradient_and_procrustes(spark):
    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]])
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]], "src long, dst long, value double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id long, v double")
    x = linalg.conjugate_gradient(edges, b, 10).orderBy("id").toPandas()["v"]
    assert np.allclose(a @ x, [1, 2, 3])
    rng = np.random.default_rng(2)
    p, (q, _) = rng.normal(size=(40, 3)), np.linalg.qr(rng.normal(size=(3, 3)))
    rows = spark.createDataFrame([(u.tolist(), (u @ q).tolist()) for u in p], "a array<double>, b array<double>")
    assert np.allclose(linalg.procrustes(rows, "a", "b", 3), q)
    assert np.allclose(linalg.subspace_angles(np.eye(3)[:, :1], np.eye(3)[:, 1:2]), math.pi / 2)


def test_spectral_densities_integrate_to_the_variance():
    from quern.session import local_session

    spark = local_session(2)
    w = spark.range(-40000, 40001).select((F.col("id") / 200.0).alias("w"))
    for kernel, tol in (("se", 1e-6), ("matern32", 1e-3), ("matern52", 1e-4)):
        total = w.agg(F.sum(linalg.spectral_density(F.col("w"), kernel, 0.7, 2.0))).first()[0] / 200 / (2 * math.pi)
        assert total == pytest.approx(2.0, abs=10 * tol)


def test_pool_distance_noise_and_chains(spark):
    a = np.array([[1.0, 5, 0, 2], [3, 4, 7, 1], [1, 1, 1, 1], [1, 1, 1, 1]])
    cells = spark.createDataFrame([(0, i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "img int, x int, y int, v double")
    pooled = augment.max_pool(cells, 2)
    assert sorted(r["v"] for r in pooled.collect()) == [1.0, 1.0, 5.0, 7.0]
    assert augment.max_unpool(cells, pooled).agg(F.sum("v")).first()[0] == 14.0
    d = augment.squared_distance_transform(cells).toPandas().pivot(index="x", columns="y", values="d2").to_numpy()
    assert np.allclose(d, [[(i - 0) ** 2 + (j - 2) ** 2 for j in range(4)] for i in range(4)])
    noisy = augment.gaussian_noise(spark.range(20000).withColumn("v", F.lit(0.0)), "v", 2.0, 5, ["id"]).agg(F.avg("noisy"), F.stddev("noisy")).first()
    assert abs(noisy[0]) < 0.06 and noisy[1] == pytest.approx(2.0, abs=0.05)
    paths = augment.markov_paths(spark, 200, 50, [[0.9, 0.1], [0.5, 0.5]])
    assert paths.count() == 10000 and paths.agg(F.avg("state")).first()[0] == pytest.approx(1 / 6, abs=0.04)
    mixture = augment.sparse_mixture(spark, 30, 10)
    assert np.allclose(mixture.groupBy("i").agg(F.sum(F.abs("w")).alias("s")).toPandas()["s"], 1)


def test_rounds_of_conjugate_gradients_do_not_compute_the_edges_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, j, 4.0 if i == j else 1.0) for i in range(6) for j in range(6)], "src long, dst long, value double")
    b = spark.createDataFrame([(i, float(i)) for i in range(6)], "id long, v double")
    x = linalg.conjugate_gradient(edges.mapInArrow(counted, edges.schema), b, 10).orderBy("id").toPandas()["v"]
    a = np.ones((6, 6)) + 3 * np.eye(6)
    assert np.allclose(a @ x, np.arange(6)) and seen.value == 36

