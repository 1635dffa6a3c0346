"""Operators that spread one group over many tasks give what a plain computation over the whole group gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import filters, inference, metrics, models
from quern.operators.quantiles import group_quantiles


def frame(spark, columns, schema):
    return spark.createDataFrame(list(zip(*columns)), schema)


def test_quantiles_by_range_are_numpys(spark):
    rng = np.random.default_rng(0)
    key = np.repeat([0, 1, 2, 3], [500, 7, 1, 40])
    value = np.concatenate([np.round(rng.normal(0, 1, 500), 2), [5.0] * 7, [3.0], rng.exponential(1, 40) ** 4])
    rows = frame(spark, (key.tolist(), value.tolist()), "k long, v double").union(spark.createDataFrame([(4, None), (None, 2.0)], "k long, v double"))
    probabilities = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["k"]: r["q"] for r in group_quantiles(rows, ["k"], "v", probabilities).collect()}
    assert set(got) == {0, 1, 2, 3, None} and got[None] == [2.0] * 5
    for k in range(4):
        assert got[k] == pytest.approx(np.quantile(value[key == k], probabilities).tolist())
    whole = group_quantiles(rows, [], "v", [0.3]).first()["q"][0]
    assert whole == pytest.approx(np.quantile(np.append(value, 2.0), 0.3))
    assert group_quantiles(rows.filter("k > 90"), ["k"], "v", [0.5]).count() == 0


def causal(sos, x):
    a, b, c, d = filters.state_space(sos)
    state, out = np.zeros(len(a)), []
    for v in x:
        out.append(c @ state + d * v)
        state = a @ state + b * v
    return np.array(out)


@pytest.mark.parametrize("kind", [("lowpass", None, 0.02), ("highpass", 0.1, None), ("bandpass", 0.05, 0.2), ("bandstop", 0.05, 0.2)])
def test_a_long_series_is_filtered_over_many_ranges(spark, kind):
    sos = filters.butterworth_sos(3, kind[0], lo=kind[1], hi=kind[2])
    rng = np.random.default_rng(1)
    name, t = np.repeat(["a", "b", "c"], [5, 3000, 2]), np.concatenate([np.arange(5), np.arange(3000), np.arange(2)])
    x = rng.normal(0, 1, len(t)).cumsum()
    order = rng.permutation(len(t))
    rows = frame(spark, (name[order].tolist(), t[order].tolist(), x[order].tolist()), "s string, t long, v double")
    got = {(r["series"], r["t"]): r["filtered"] for r in filters.sosfilt(rows, "s", "t", "v", sos).collect()}
    assert len(got) == len(t)
    for s in "abc":
        assert np.allclose([got[s, k] for k in t[name == s]], causal(sos, x[name == s]), atol=1e-8)


def test_butterworth_gains():
    w = lambda sos, f: abs(np.prod([np.polyval(s[:3], np.exp(2j * np.pi * f)) / np.polyval(s[3:], np.exp(2j * np.pi * f)) for s in sos]))
    for order in (1, 2, 5):
        for kind, lo, hi, edges, passed in (("lowpass", None, 0.1, [0.1], 1e-9), ("highpass", 0.1, None, [0.1], 0.5), ("bandpass", 0.1, 0.3, [0.1, 0.3], 0.18), ("bandstop", 0.1, 0.3, [0.1, 0.3], 1e-9)):
            sos = filters.butterworth_sos(order, kind, lo=lo, hi=hi)
            assert [w(sos, f) for f in edges] == pytest.approx([2**-0.5] * len(edges)) and w(sos, passed) == pytest.approx(1, abs=2e-2)


def test_zero_phase_filter_of_both_directions(spark):
    sos, rng = filters.butterworth_sos(2, "lowpass", hi=0.1), np.random.default_rng(2)
    x, pad = rng.normal(0, 1, 400), 9  # 3 * (2 * sections + 1)
    rows = frame(spark, (["s"] * 400, list(range(400)), x.tolist()), "s string, t long, v double")
    got = filters.sosfiltfilt(rows, "s", "t", "v", sos).orderBy("t").toPandas()["filtered"].to_numpy()
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        long = (causal(sos, long - long[0]) + filters.dc_gain(sos) * long[0])[::-1]
    assert np.allclose(got, long[pad:-pad], atol=1e-9)


def test_false_discovery_rates_where_p_values_crowd(spark):
    p = np.concatenate([np.full(300, 1e-8), np.random.default_rng(3).random(200) ** 5])
    rows = frame(spark, (list(range(500)), p.tolist()), "id long, p double").union(spark.createDataFrame([(999, None)], "id long, p double"))
    got = {r["id"]: r["q"] for r in inference.fdr_bh(rows, "p").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * 500 / np.arange(1, 501))[::-1])[::-1]
    assert len(got) == 500 and [got[i] for i in order] == pytest.approx(np.minimum(q, 1).tolist())
    assert inference.harmonic(20_000) == pytest.approx(sum(1 / k for k in range(1, 20_001)), rel=1e-12)


def test_auc_with_one_hot_key(spark):
    rng = np.random.default_rng(4)
    s, y, k = np.round(rng.normal(0, 1, 600), 1), rng.integers(0, 2, 600), np.repeat([0, 1], [590, 10])
    rows = frame(spark, (k.tolist(), s.tolist(), y.tolist()), "k long, s double, y long")
    for r in metrics.roc_auc(rows, "s", "y", ("k",)).collect():
        a, b = s[(k == r["k"]) & (y == 1)], s[(k == r["k"]) & (y == 0)]
        assert r["auc"] == pytest.approx(((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2))


def test_projections_and_their_way_back(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (50, 6)) @ rng.normal(0, 1, (6, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    mean, cov, n = models.covariance(rows, "v")
    assert n == 50 and np.allclose(cov, np.cov(x.T)) and np.allclose(mean, x.mean(0))
    white = models.projected(rows, "v", models.whitening(cov), mean)
    z = np.array([r["z"] for r in white.filter("id < 99").orderBy("id").collect()])
    assert np.allclose(np.cov(z.T), np.eye(6)) and white.filter("id = 99").first()["z"] is None
    back = models.restored(white.filter("id < 99"), "z", models.whitening(cov, -1.0), mean).orderBy("id").collect()
    assert np.allclose([r["restored"] for r in back], x)


def test_pca_signs_and_variances(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (80, 4)) * [5, 3, 1, 0.5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    components, variances, _ = models.pca(rows, "v", 2)
    w, v = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variances, w[::-1][:2]) and np.allclose(np.abs(components @ v[:, ::-1][:, :2]), np.eye(2), atol=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in components)


def test_irls_without_keys_is_one_group(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 300)
    y = rng.poisson(np.exp(0.5 + 0.3 * x))
    rows = frame(spark, (x.tolist(), y.tolist()), "x double, y long")
    beta = models.irls(rows, [], [F.lit(1.0), F.col("x")], F.col("y"), "poisson").first()["beta"]
    want = np.zeros(2)
    for _ in range(50):
        mu = np.exp(want[0] + want[1] * x)
        design = np.stack([np.ones(300), x], axis=1)
        want = want + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y - mu))
    assert beta == pytest.approx(want.tolist(), abs=1e-6)


def test_permutations_of_one_large_block_are_spread_and_not_broadcast(spark):
    ids, blocks = list(range(700)), [0] * 600 + [1] * 99 + [2]
    rows = frame(spark, (ids[::-1], blocks[::-1]), "id long, block int")
    perms = inference.permutations(rows, 3, 5)
    got = {}
    for r in perms.collect():
        got.setdefault(r["perm"], {})[r["id"]] = r["source"]
    drawn = {(r["perm"], r["id"]): r["u"] for r in rows.crossJoin(spark.range(1, 3).selectExpr("int(id) AS perm")).select("perm", "id", inference.uniform(5, "perm", "id").alias("u")).collect()}
    assert got[0] == {i: i for i in ids}
    for perm in (1, 2):
        for block in (0, 1, 2):
            mine = [i for i, b in zip(ids, blocks) if b == block]
            assert [got[perm][i] for i in mine] == sorted(mine, key=lambda i: (drawn[perm, i], i))
    numbers = rows.select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    surrogates = perms.select(F.col("perm").alias("surrogate"), "id", F.col("source").cast("double").alias("y"))
    plan = inference.spatial_null_test(numbers, surrogates)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joins) == 2 and not any("BroadcastHashJoin" in line and "_range" not in line for line in joins)
