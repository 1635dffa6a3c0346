"""Additive models against plain dense computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import smooths

SCHEMA = "e string, x double, w double, y double"


def splines(x, low, high, number, degree=3):
    """Uniform B-splines by the recurrence on knots."""
    step = (high - low) / (number - degree)
    knots = low + step * np.arange(-degree, number + 1)
    x = np.clip(np.asarray(x, float), low, high - 1e-12 * (high - low))[:, None]
    b = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        left = (x - knots[: -d - 1]) / (d * step) * b[:, :-1]
        right = (knots[d + 1 :] - x) / (d * step) * b[:, 1:]
        b = left + right
    return b


def simulated(seed=0, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("a", None):
        x, w = rng.uniform(0, 1, n), rng.uniform(-1, 1, n)
        y = np.sin(6 * x) + (0.5 if e else -1) * w**2 + 0.3 * rng.normal(size=n)
        rows += [(e, *map(float, r)) for r in zip(x, w, y)]
    return rows


def checked(design, y, weight, z, row, spans, estimated):
    """The penalised equations and those of the smoothing parameters hold with dense matrices."""
    p = design.shape[1]
    d = np.diff(np.eye(10), 2, axis=0)
    penalties = []
    for low, high in spans:
        s = np.zeros((p, p))
        s[low:high, low:high] = d.T @ d
        penalties.append(s)
    total = sum(lam * s for lam, s in zip(row.lam, penalties))
    # smooths sum to zero over the rows: a Lagrange multiplier each
    c = np.zeros((len(spans), p))
    for k, (low, high) in enumerate(spans):
        c[k, low:high] = design[:, low:high].sum(axis=0)
    gram = design.T @ (weight[:, None] * design)
    system = np.block([[gram + total, c.T], [c, np.zeros((len(spans), len(spans)))]])
    inverse = np.linalg.inv(system)[:p, :p]
    beta = inverse @ design.T @ (weight * z)
    fitted = design @ beta
    assert np.allclose(design @ np.array(row.beta), fitted, atol=2e-6)
    influence = inverse @ gram
    assert row.edf_total == pytest.approx(np.trace(influence), abs=1e-5)
    phi = (weight * (z - fitted) ** 2).sum() / (len(y) - np.trace(influence)) if estimated else 1.0
    for lam, s, (low, high), edf in zip(row.lam, penalties, spans, row.edf):
        assert edf == pytest.approx(np.diag(influence)[low:high].sum(), abs=1e-4)
        if 1e-5 < lam < 1e7:
            rank = np.linalg.matrix_rank(s)
            assert (rank / lam - np.trace(inverse @ s)) * phi == pytest.approx(beta @ s @ beta, rel=2e-3)
    return phi


def test_gaussian_fit_equals_dense(spark):
    rows = simulated()
    table = spark.createDataFrame([*rows, ("a", None, 0.0, 1.0), ("a", 0.5, 0.0, None)], SCHEMA).repartition(4)
    terms = [smooths.bspline_smooth(F.col("x"), 0.0, 1.0), smooths.bspline_smooth(F.col("w"), -1.0, 1.0)]
    fit = smooths.gam_fit(table, ["e"], terms, F.col("y"))
    found = {r.e: r for r in fit.table.collect()}
    assert set(found) == {"a", None}
    for e, row in found.items():
        own = np.array([r[1:] for r in rows if r[0] == e])
        design = np.hstack([np.ones((len(own), 1)), splines(own[:, 0], 0, 1, 10), splines(own[:, 1], -1, 1, 10)])
        phi = checked(design, own[:, 2], np.ones(len(own)), own[:, 2], row, fit.spans, True)
        assert row.dispersion == pytest.approx(phi, rel=1e-5) and row.n == 300
        assert row.deviance == pytest.approx(((own[:, 2] - design @ np.array(row.beta)) ** 2).sum(), rel=1e-6)
        assert row.null_deviance == pytest.approx(((own[:, 2] - own[:, 2].mean()) ** 2).sum(), rel=1e-9)
    effect = fit.partial_effect(table.filter("e = 'a' AND y IS NOT NULL"), 0).toPandas()
    truth = np.sin(6 * effect["x"])
    assert np.abs(effect["effect"] - (truth - truth.mean())).max() < 0.25 and (effect["se"] > 0).all() and abs(effect["effect"].mean()) < 1e-6
    predicted = fit.predict(table.filter("y IS NOT NULL AND x IS NOT NULL")).toPandas()
    assert np.mean((predicted["predicted"] - predicted["y"]) ** 2) < 0.11


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_other_families_solve_their_working_equations(spark, family):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, 500)
    y = rng.poisson(np.exp(1 + np.sin(6 * x))) if family == "poisson" else (rng.uniform(size=500) < 1 / (1 + np.exp(-2 * np.sin(6 * x)))).astype(int)
    table = spark.createDataFrame([("a", float(a), 0.0, float(b)) for a, b in zip(x, y)], SCHEMA).repartition(3)
    fit = smooths.gam_fit(table, ["e"], [smooths.bspline_smooth(F.col("x"), 0.0, 1.0)], F.col("y"), family=family)
    row = fit.table.first()
    design = np.hstack([np.ones((500, 1)), splines(x, 0, 1, 10)])
    eta = design @ np.array(row.beta)
    mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
    weight = mu if family == "poisson" else mu * (1 - mu)
    checked(design, y, weight, eta + (y - mu) / weight, row, fit.spans, False)
    assert row.deviance < row.null_deviance and row.dispersion == 1.0
    assert np.allclose(fit.predict(table).toPandas().sort_values("x")["predicted"], mu[np.argsort(x)], atol=1e-9)


def test_without_rows_and_linear_terms(spark):
    table = spark.createDataFrame(simulated(3), SCHEMA)
    term = smooths.bspline_smooth(F.col("x"), 0.0, 1.0)
    assert smooths.gam_fit(table.limit(0), ["e"], [term], F.col("y")).table.count() == 0
    assert smooths.gam_fit(table.limit(0), [], [term], F.col("y")).table.count() == 0
    row = smooths.gam_fit(table, [], [term], F.col("y"), [F.col("w")]).table.first()
    assert row.n == 600 and len(row.beta) == 12 and 2 < row.edf[0] < 9


def test_cyclic_smooth_meets_itself(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 400)
    table = spark.createDataFrame([("a", float(a), 0.0, float(np.cos(2 * np.pi * a) + 0.1 * b)) for a, b in zip(x, rng.normal(size=400))], SCHEMA)
    fit = smooths.gam_fit(table, [], [smooths.cyclic_smooth(F.col("x"), 0.0, 1.0)], F.col("y"))
    ends = fit.predict(spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0)], SCHEMA)).collect()
    assert ends[0].predicted == pytest.approx(ends[1].predicted, abs=1e-9) and ends[0].predicted == pytest.approx(1.0, abs=0.1)


def test_rows_stay_where_they_are_and_effects_equal_those_of_many_elements(spark, monkeypatch):
    from quern.operators import models

    table = spark.createDataFrame(simulated(), SCHEMA).repartition(4)
    fit = smooths.gam_fit(table, ["e"], [smooths.bspline_smooth(F.col("x"), 0.0, 1.0), smooths.bspline_smooth(F.col("w"), -1.0, 1.0)], F.col("y"))
    for out in (fit.predict(table), fit.partial_effect(table, 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    few = {(r.e, r.x, r.w): (r.effect, r.se) for r in fit.partial_effect(table, 1).collect()}
    monkeypatch.setattr(models, "MOST_HELD", 0)
    many = {(r.e, r.x, r.w): (r.effect, r.se) for r in fit.partial_effect(table, 1).collect()}
    assert set(few) == set(many) and len(few) == 600
    assert all(few[k] == pytest.approx(many[k], abs=1e-10) for k in few)
    found = {r.e: r for r in fit.table.collect()}
    low, high = fit.spans[1]
    for (e, _, w), (effect, se) in list(few.items())[::50]:
        basis, row = splines(np.array([w]), -1, 1, 10)[0], found[e]
        cov = np.array(row.cov).reshape(len(row.beta), -1)[low:high, low:high]
        assert effect == pytest.approx(basis @ row.beta[low:high], abs=1e-9) and se == pytest.approx((basis @ cov @ basis) ** 0.5, rel=1e-6)


def test_bases_of_numbers_equal_those_of_columns(spark):
    from quern.functions import bases

    x = [*np.linspace(-0.5, 1.5, 41), 0.0, 1.0, float("inf"), float("-inf"), float("nan")]
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    for number, degree in ((10, 3), (8, 2), (5, 1), (4, 3)):
        rows = table.select("i", bases.bspline_basis(F.col("x"), 0.0, 1.0, number, degree).alias("s"), bases.cyclic_basis(F.col("x"), 0.0, 1.0, number, degree).alias("c")).orderBy("i").collect()
        assert np.allclose(bases.bspline_values(np.array(x), 0.0, 1.0, number, degree), [r.s for r in rows], rtol=0, atol=1e-15)
        finite = slice(0, len(x) - 3)
        assert np.array_equal(bases.cyclic_values(np.array(x[finite]), 0.0, 1.0, number, degree), [r.c for r in rows][finite])


def test_bases_are_made_in_tasks_and_array_columns_agree(spark, monkeypatch):
    from quern.functions import bases
    from quern.operators import models

    table = spark.createDataFrame([*simulated(), ("a", None, 0.5, 1.0), ("a", 0.5, None, 1.0), ("b", None, 0.0, 1.0)], SCHEMA).repartition(4)
    term = smooths.bspline_smooth(F.col("x"), 0.0, 1.0)
    plain = smooths.Smooth(F.when(F.col("x").isNotNull(), bases.bspline_basis(F.col("x"), 0.0, 1.0)), 10, term.penalties)
    fits = [smooths.gam_fit(table, ["e"], [s], F.col("y"), [F.col("w")]) for s in (term, plain)]
    assert "lambda" not in fits[0].table._jdf.queryExecution().optimizedPlan().toString()  # no row builds its basis as SQL arrays
    one, two = ({r.e: r for r in fit.table.collect()} for fit in fits)
    assert set(one) == set(two) == {"a", None}
    assert all(np.allclose(one[e][c], two[e][c], rtol=1e-9) for e in one for c in ("beta", "lam", "cov", "edf", "deviance"))
    known = [[(r.e, r.x, r.w, r.predicted) for r in fit.predict(table).orderBy("e", "x", "w").collect()] for fit in fits]
    assert len(known[0]) == 602 and [r[:3] for r in known[0]] == [r[:3] for r in known[1]]  # an element without a fit has no row
    assert all(a[3] == pytest.approx(b[3], abs=1e-10) and (a[3] is None) == (a[1] is None or a[2] is None) for a, b in zip(*known))
    assert fits[0].partial_effect(table, 0).count() == 600
    monkeypatch.setattr(models, "MOST_HELD", 0)
    many = [(r.e, r.x, r.w, r.predicted) for r in fits[0].predict(table).orderBy("e", "x", "w").collect()]
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-10) for a, b in zip(known[0], many, strict=True))
