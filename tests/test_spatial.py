"""Meshes, grids, constructors and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import grid, mesh
from quern.sources import constructors
from quern.streaming import windows


def test_icosphere_counts_and_area(spark):
    v, f = mesh.icosphere(spark, 2)
    assert (v.count(), f.count()) == (162, 320)
    area = mesh.face_areas(v, f).agg(F.sum("area")).first()[0]
    assert area == pytest.approx(4 * math.pi, rel=0.05)
    for scheme in ("voronoi", "barycentric"):
        assert mesh.vertex_areas(v, f, scheme).agg(F.sum("area")).first()[0] == pytest.approx(area)


def test_normals_point_outwards(spark):
    v, f = mesh.icosphere(spark, 1)
    out = mesh.vertex_normals(v, f).join(v, "vid").select((F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")).alias("d"))
    assert out.agg(F.min("d")).first()[0] > 0.98


def test_cotangent_rows_sum_to_zero_and_adjacency_is_complete(spark):
    v, f = mesh.icosphere(spark, 1)
    sums = mesh.cotangent_laplacian(v, f).groupBy("src").agg(F.sum("value").alias("s")).toPandas()["s"]
    assert np.allclose(sums, 0)
    assert mesh.edge_face_adjacency(f).count() == 120
    assert mesh.k_ring(f, 1).count() == 240 and mesh.k_ring(f, 2, True).filter("hops = 0").count() == 42


def test_smoothing_shrinks_a_sphere(spark):
    v, f = mesh.icosphere(spark, 1)
    radius = mesh.laplacian_smooth(v, f, 0.5, 2).select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r")).agg(F.max("r")).first()[0]
    assert radius < 0.97


def image(spark, a, img=0):
    return spark.createDataFrame([(img, i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "img int, x int, y int, v double")


def test_labels_and_tfce(spark):
    a = np.array([[1, 1, 0, 2], [0, 0, 0, 2], [3, 0, 1, 0]])
    out = grid.labelled(image(spark, a), F.col("v") > 0).toPandas().pivot(index="x", columns="y", values="label").to_numpy()
    assert out.tolist() == [[1, 1, 0, 2], [0, 0, 0, 2], [3, 0, 4, 0]]
    single = grid.tfce(image(spark, np.array([[0, 1]])), 10).filter("y = 1").first()["v"]
    assert single == pytest.approx(sum((k / 10) ** 2 / 10 for k in range(1, 10)))


def test_overlap_add_of_tiles(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 2.0, 1.0), (0, 0, 0, 4.0, 3.0), (0, 0, 1, 5.0, 0.0)], "img int, x int, y int, v double, w double")
    assert [r["v"] for r in grid.overlap_add(tiles).orderBy("y").collect()] == [3.5, 0.0]


def test_grid_operator_boundaries_and_triangle(spark):
    dense = {(r["src"], r["dst"]): r["value"] for r in constructors.grid_laplacian(spark, 1, 3).collect()}
    assert dense[(0, 0)] == -1.0 and dense[(1, 1)] == -2.0 and dense[(0, 1)] == 1.0
    m = np.arange(16.0).reshape(4, 4)
    cells = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, value double")
    for offset in (0, 1, 2):
        got = constructors.sym_to_vec(cells, offset).orderBy("k").toPandas()
        assert got["value"].tolist() == m[np.triu_indices(4, offset)].tolist() and got["k"].tolist() == list(range(len(got)))


def test_chebyshev_series_of_exp():
    c = constructors.chebyshev_coefficients(math.exp, 12, 0.0, 2.0)
    for x in (0.0, 0.7, 2.0):
        assert np.polynomial.chebyshev.chebval(x - 1, c) == pytest.approx(math.exp(x), abs=1e-9)


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, float(m)) for m in range(0, 60, 3)]
    events = spark.createDataFrame(rows, "ts string, k int, v double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), "ts timestamp, k int, v double")
    windows.to_table(windows.windowed(stream, "ts", ["k"], "v", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n"), F.sum("s")).first()
    batch = windows.windowed(events, "ts", ["k"], "v", "10 minutes")
    assert batch.agg(F.sum("n")).first()[0] == 20 and 0 < got[0] <= 20
    assert windows.sessions(events, "ts", "k", "4 minutes").count() == 20
