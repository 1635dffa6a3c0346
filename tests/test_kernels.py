"""Kernels and neighbours in groups of pairs give what plain loops over all pairs give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import contrastive, kernels

SCHEMA = "id int, vec array<double>"


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(kernels, "ROWS", 7)
    monkeypatch.setattr(kernels, "QUERIES", 3)


@pytest.fixture
def vectors():
    rng = np.random.default_rng(4)
    plain = {i: rng.normal(0, 1, 5) for i in range(60)}
    plain[31] = plain[50] = plain[10]
    return plain


def tables(spark, plain, more=()):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in plain.items()] + list(more), SCHEMA)
    return rows.filter("id % 10 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), rows


def test_kernels_of_all_pairs(spark, vectors, small_groups):
    queries, rows = tables(spark, vectors, [(60, [1.0, 2.0]), (61, [3.0, 4.0]), (62, None), (70, [1.0, None, 0.0, 0.0, 0.0])])
    plain = {"linear": lambda a, b: a @ b, "distance": lambda a, b: ((a - b) ** 2).sum(), "rbf": lambda a, b: np.exp(-((a - b) ** 2).sum() / 5), "polynomial": lambda a, b: (a @ b / 5) ** 3,
             "sigmoid": lambda a, b: np.tanh(a @ b / 5), "cosine": lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b), "geodesic": lambda a, b: np.arctan2(np.linalg.norm(np.cross(a[:3], b[:3])), a[:3] @ b[:3])}
    for kind, value in plain.items():
        use = (queries.filter("q_id <> 60"), rows.filter("id <> 60 AND id <> 61")) if kind == "geodesic" else (queries, rows)
        got = {(r["q_id"], r["id"]): r["value"] for r in kernels.kernel(*use, kind).collect()}
        assert len(got) == 7 * 61 + (0 if kind == "geodesic" else 2)
        assert all(got[q, i] == pytest.approx(value(vectors[q], v), abs=1e-12) for q in range(0, 60, 10) for i, v in vectors.items())
        if kind != "geodesic":
            assert got[0, 70] is None and got[70, 3] is None
    assert kernels.kernel(queries.limit(0), rows, "linear").count() == 0 == kernels.kernel(queries, rows.limit(0), "linear").count()


def test_pairs_are_dealt_to_groups_of_bounded_size(spark, vectors, small_groups):
    queries, rows = tables(spark, vectors)
    plan = kernels.kernel(queries, rows.coalesce(1), "distance")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Union" not in plan and "hashpartitioning(_part" in plan


def test_nearest_with_copies_and_missing_entries(spark, vectors, small_groups):
    queries, rows = tables(spark, vectors, [(70, [None] * 5), (72, [float("nan")] * 5)])
    for k in (1, 4, 100):
        got = {}
        for r in kernels.nearest(queries, rows, k).orderBy("q_id", "rank").collect():
            got.setdefault(r["q_id"], []).append((r["id"], r["value"]))
        assert set(got) == set(range(0, 60, 10))
        for q, found in got.items():
            near = sorted((((vectors[q] - v) ** 2).sum(), i) for i, v in vectors.items())[:k]
            assert [i for i, _ in found][: len(near)] == [i for _, i in near] and len(found) == min(k, 61)
            assert [v for _, v in found][: len(near)] == pytest.approx([d for d, _ in near])


def test_attention_over_many_groups(spark, vectors, small_groups):
    plain = {i: v * 30 for i, v in vectors.items()}  # products too large to be raised without their maximum
    queries, rows = tables(spark, plain, [(71, [None] * 5)])
    out = contrastive.attention(queries, rows.withColumn("val", F.coalesce(F.reverse("vec"), "vec")), 5)
    got = {(r["q_id"], r["i"]): r["x"] for r in out.collect()}
    keys = np.stack(list(plain.values()))
    for q in range(0, 60, 10):
        logits = keys @ plain[q] / 5**0.5
        w = np.exp(logits - logits.max())
        assert [got[q, i] for i in range(5)] == pytest.approx((w @ keys[:, ::-1] / w.sum()).tolist())
    assert len(got) == 30


def test_pairs_of_copies_take_little_space(spark, vectors, small_groups, monkeypatch, tmp_path):
    monkeypatch.setattr(kernels, "ROWS", 500)  # fewer than the copies of one vector
    _, rows = tables(spark, {i: vectors[i % 20 * (i < 3000)][:3] for i in range(4000)})
    queries = rows.filter("id % 100 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    kernels.kernel(queries, rows, "geodesic", 7).write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs").toPandas()
    assert len(found) == 40 * 4000 == len(found[["q_id", "id"]].drop_duplicates())
    at = lambda i: vectors[i % 20 * (i < 3000)][:3]
    for q, i, value in found.sample(200, random_state=1).itertuples(index=False):
        assert value == round(np.arctan2(np.linalg.norm(np.cross(at(q), at(i))), at(q) @ at(i)), 7)
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 4 * len(found)
