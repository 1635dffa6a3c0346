"""Linear models, shrinkage and components from moment aggregates.

Gram sums come from one aggregate with map-side combine; small systems are then solved. Models for many elements solve
per row of sums, so no element's rows are ever gathered. Models that need every row at each step (IRLS) run as rounds of
weighted Gram aggregates over all groups at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import geometry
from quern.functions.arrays import squared_distance
from quern.operators.normalize import mad
from quern.operators.quantiles import MOST_NEAR, MOST_SCANNED, scanned_quantiles, spread_near
from quern.operators.semiring import stable_log_sum
from quern.session import discard, staged


def _same(keys: list[str]) -> Column:
    """Equal keys of rows and of a table whose keys are named _k_."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return on


def design_sums(rows: DataFrame, keys: list[str], x: list[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """One row a key: xx (upper triangle), xy, yy, sy, sw and n; rows with a null are left out."""
    w = F.lit(1.0) if weight is None else weight
    ok = y.isNotNull()
    for c in x:
        ok = ok & c.isNotNull()
    named = [F.sum(w * a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    named += [F.sum(w * a * y).alias(f"xy_{i}") for i, a in enumerate(x)]
    return rows.filter(ok).groupBy(*keys).agg(*named, F.sum(w * y * y).alias("yy"), F.sum(w * y).alias("sy"), F.sum(w).alias("sw"), F.count("*").alias("n"))


def solved(sums: DataFrame, keys: list[str], p: int, ridge: float = 0.0) -> DataFrame:
    """keys, beta, inverse (row-major), rss, tss, n, rank of each row of sums; a batch of rows is solved at once."""
    def run(batches):
        for part in batches:
            if not len(part):
                continue
            column = lambda name: part[name].to_numpy(float)
            g = np.stack([np.stack([column(f"xx_{min(i, j)}_{max(i, j)}") for j in range(p)], axis=1) for i in range(p)], axis=1) + ridge * np.eye(p)
            b = np.stack([column(f"xy_{i}") for i in range(p)], axis=1)
            inverse = np.linalg.pinv(g, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, b)
            out = part[keys].copy()
            out["beta"], out["inverse"] = list(beta), list(inverse.reshape(len(part), -1))
            out["rss"] = np.maximum(column("yy") - (beta * b).sum(axis=1), 0.0)
            out["tss"] = column("yy") - column("sy") ** 2 / column("sw")
            out["n"], out["rank"] = part["n"], np.linalg.matrix_rank(g, hermitian=True)
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "beta array<double>", "inverse array<double>", "rss double", "tss double", "n long", "rank int"])
    return sums.mapInPandas(run, schema)


def with_statistics(fit: DataFrame, p: int) -> DataFrame:
    """Adds dispersion, r2, adj_r2, loglik, aic, bic: one more parameter for the estimated dispersion."""
    n = F.col("n").cast("double")
    out = fit.withColumn("dispersion", F.col("rss") / (n - F.col("rank"))).withColumn("r2", 1 - F.col("rss") / F.col("tss"))
    out = out.withColumn("adj_r2", 1 - (1 - F.col("r2")) * (n - 1) / (n - F.col("rank")))
    out = out.withColumn("loglik", -0.5 * n * (F.log(2 * np.pi * F.col("rss") / n) + 1))
    parameters = F.col("rank") + 1
    return out.withColumn("aic", -2 * F.col("loglik") + 2 * parameters).withColumn("bic", -2 * F.col("loglik") + parameters * F.log(n))


def t_contrast(fit: DataFrame, contrast: list[float]) -> DataFrame:
    """Adds effect, se and t of a contrast of the coefficients."""
    p = len(contrast)
    effect = sum((F.col("beta")[i] * c for i, c in enumerate(contrast)), F.lit(0.0))
    quad = sum((F.col("inverse")[i * p + j] * contrast[i] * contrast[j] for i in range(p) for j in range(p)), F.lit(0.0))
    out = fit.withColumn("effect", effect).withColumn("se", F.sqrt(quad * F.col("rss") / (F.col("n") - F.col("rank"))))
    return out.withColumn("t", F.col("effect") / F.col("se"))


def f_contrast(fit: DataFrame, contrasts: list[list[float]]) -> DataFrame:
    """Adds f, df1, df2 of up to three contrasts at once: (C b)' (C inverse C')^-1 (C b) by their number and the dispersion."""
    p, m = len(contrasts[0]), len(contrasts)
    effect = [sum((F.col("beta")[i] * c for i, c in enumerate(row)), F.lit(0.0)) for row in contrasts]
    mid = [[sum((F.col("inverse")[i * p + j] * r[i] * s[j] for i in range(p) for j in range(p)), F.lit(0.0)) for s in contrasts] for r in contrasts]
    held = fit.select("*", *(e.alias(f"_c{i}") for i, e in enumerate(effect)), *(v.alias(f"_v{i}_{j}") for i, row in enumerate(mid) for j, v in enumerate(row)))
    cb = [F.col(f"_c{i}") for i in range(m)]
    turned = geometry.inverse([[F.col(f"_v{i}_{j}") for j in range(m)] for i in range(m)])
    df2 = F.col("n") - F.col("rank")
    value = geometry.dot(cb, [geometry.dot(row, cb) for row in turned]) / (m * F.col("rss") / df2)
    return held.withColumn("f", value).withColumn("df1", F.lit(m).cast("long")).withColumn("df2", df2).drop(*(c for c in held.columns if c not in fit.columns))


def predicted(rows: DataFrame, fit: DataFrame, keys: list[str], x: list[Column], link: Callable[[Column], Column] = lambda e: e) -> DataFrame:
    """rows with the mean that their group's coefficients give."""
    held = fit.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("beta").alias("_b"))
    eta = sum((F.col("_b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
    return rows.join(held, _same(keys)).withColumn("predicted", link(eta)).drop("_b", *(f"_k_{k}" for k in keys))


def compare(full: DataFrame, reduced: DataFrame, keys: list[str]) -> DataFrame:
    """F of nested fits: keys, f, df1, df2."""
    small = reduced.select(*keys, F.col("rss").alias("_rss"), F.col("rank").alias("_rank"))
    both = full.join(small, keys)
    df1, df2 = F.col("rank") - F.col("_rank"), F.col("n") - F.col("rank")
    value = ((F.col("_rss") - F.col("rss")) / df1) / (F.col("rss") / df2)
    return both.select(*keys, value.alias("f"), df1.cast("long").alias("df1"), df2.alias("df2"))


def residualise(rows: DataFrame, keys: list[str], x: list[Column], y: Column, name: str = "residual") -> DataFrame:
    """y minus its fit on x by key; coefficients join back to the rows."""
    fit = solved(design_sums(rows, keys, x, y), keys, len(x)).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("beta").alias("_b"))
    on = _same(keys)
    line = sum((F.col("_b")[i] * c for i, c in enumerate(x)), F.lit(0.0))
    return rows.join(fit, on).withColumn(name, y - line).drop("_b", *(f"_k_{k}" for k in keys))


def sandwich_hc0(rows: DataFrame, keys: list[str], x: list[Column], y: Column) -> DataFrame:
    """keys and the HC0 covariance (row-major) of the coefficients."""
    p = len(x)
    fit = solved(design_sums(rows, keys, x, y), keys, p)
    named = [c.alias(f"_x{i}") for i, c in enumerate(x)]
    scored = residualise(rows, keys, x, y, "_e").select(*keys, "_e", *named)
    meat = design_sums(scored, keys, [F.col(f"_x{i}") for i in range(p)], F.col("_e"), F.col("_e") * F.col("_e"))
    joined = meat.join(fit.select(*keys, "inverse"), keys)
    m = [[F.col(f"xx_{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)]
    inverse = lambda i, j: F.col("inverse")[i * p + j]
    cells = [sum((inverse(i, a) * m[a][b] * inverse(b, j) for a in range(p) for b in range(p)), F.lit(0.0)) for i in range(p) for j in range(p)]
    return joined.select(*keys, F.array(*cells).alias("cov"))


def _sandwich(meat: DataFrame, fit: DataFrame, keys: list[str], p: int, factor: Column) -> DataFrame:
    """keys, cov: inverse, meat, inverse, times a factor. meat: xx of the scores."""
    joined = meat.join(fit.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "inverse", F.col("n").alias("_n"), "rank"), _same(keys))
    m = [[F.col(f"xx_{min(i, j)}_{max(i, j)}") for j in range(p)] for i in range(p)]
    inverse = [[F.col("inverse")[i * p + j] for j in range(p)] for i in range(p)]
    cells = geometry.product(geometry.product(inverse, m), inverse)
    return joined.select(*keys, F.array(*(factor * v for row in cells for v in row)).alias("cov"))


def _scores(rows: DataFrame, keys: list[str], x: list[Column], y: Column, kept: list[str]) -> DataFrame:
    """Residual times regressors of each row."""
    scored = residualise(rows, keys, x, y, "_e")
    return scored.select(*keys, *kept, *((F.col("_e") * c).alias(f"_s{i}") for i, c in enumerate(x)))


def sandwich_hc1(rows: DataFrame, keys: list[str], x: list[Column], y: Column) -> DataFrame:
    """The HC0 covariance times n / (n - rank)."""
    fit = solved(design_sums(rows, keys, x, y), keys, len(x))
    meat = design_sums(_scores(rows, keys, x, y, []), keys, [F.col(f"_s{i}") for i in range(len(x))], F.lit(0.0))
    return _sandwich(meat, fit, keys, len(x), F.col("_n") / (F.col("_n") - F.col("rank")))


def sandwich_cluster(rows: DataFrame, keys: list[str], x: list[Column], y: Column, cluster: str) -> DataFrame:
    """Scores summed by cluster first; times G / (G - 1) * (n - 1) / (n - rank)."""
    fit = solved(design_sums(rows, keys, x, y), keys, len(x))
    sums = _scores(rows, keys, x, y, [cluster]).groupBy(*keys, cluster).agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(x))))
    meat = design_sums(sums, keys, [F.col(f"_s{i}") for i in range(len(x))], F.lit(0.0))
    groups = F.col("n")  # rows of the sums
    return _sandwich(meat, fit, keys, len(x), groups / (groups - 1) * (F.col("_n") - 1) / (F.col("_n") - F.col("rank")))


#: Weights of a standardised residual.
ROBUST = {
    "huber": lambda u, c=1.345: F.when(F.abs(u) <= c, 1.0).otherwise(c / F.abs(u)),
    "tukey": lambda u, c=4.685: F.when(F.abs(u) <= c, F.pow(1 - F.pow(u / c, F.lit(2.0)), F.lit(2.0))).otherwise(0.0),
}


def robust_fit(rows: DataFrame, keys: list[str], x: list[Column], y: Column, kind: str = "huber", rounds: int = 20, ridge: float = 0.0, tol: float = 1e-10) -> DataFrame:
    """keys, beta, n, scale: least squares, then weights of residuals by their normalised MAD, until no coefficient moves.

    Each round is two quantiles and one aggregate over all groups; only coefficients pass between rounds. Rows of few groups
    are read again for each and not exchanged; once medians move little, one scan about the last ones finds both."""
    p = len(x)
    base = staged(rows.select(*keys, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)), y.cast("double").alias("_y")))
    own = [F.col(f"_x{i}") for i in range(p)]
    fit = _Held(solved(design_sums(base, keys, own, F.col("_y")), keys, p, ridge).select(*keys, "beta", "n"), None, p)
    guesses: dict = {}

    def residuals() -> tuple[DataFrame, DataFrame]:
        eta = sum((F.col("_b")[i] * c for i, c in enumerate(own)), F.lit(0.0))
        left = fit.joined(base, keys).withColumn("_e", F.col("_y") - eta).select(*keys, *(f"_x{i}" for i in range(p)), "_y", "_e")
        if fit.few and len(fit.rows) <= MOST_SCANNED:
            spread = _scanned_spread(left.select(*keys, "_e"), keys, {tuple(r[k] for k in keys): r["n"] for r in fit.rows}, guesses)
        else:
            spread = mad(left.select(*keys, "_e"), keys, "_e")
        spread = spread.withColumnsRenamed({k: f"_s_{k}" for k in keys})
        return left, spread.withColumn("mad", F.when(F.col("mad") > 2.3e-16, F.col("mad")).otherwise(1.0))

    for _ in range(rounds):
        left, spread = residuals()
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        step = left.join(F.broadcast(spread) if fit.few else spread, on).withColumn("_w", ROBUST[kind](F.col("_e") / F.col("mad")))
        after = _Held(solved(design_sums(step, keys, own, F.col("_y"), F.col("_w")), keys, p, ridge).select(*keys, "beta", "n"), fit.few)
        moved = after.largest_move(fit, keys)
        fit = after
        if moved <= tol:
            break
    scale = residuals()[1].select(*(F.col(f"_s_{k}").alias(f"_k_{k}") for k in keys), F.col("mad").alias("scale"))
    return fit.table.join(scale, _same(keys)).drop(*(f"_k_{k}" for k in keys))


def _scanned_spread(rows: DataFrame, keys: list[str], numbers: dict[tuple, int], guesses: dict) -> DataFrame:
    """keys, mad: of the column _e of few groups, of so many rows. guesses: of the last round, brought up to date."""
    found = spread_near(rows, keys, "_e", guesses) if guesses else {}
    shrink = 0.25 if found is None else 1.0
    if not found:
        middle = scanned_quantiles(rows, keys, "_e", [0.5])
        off = rows.join(F.broadcast(middle.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.get("q", F.lit(0)).alias("_m"))), _same(keys))
        apart = scanned_quantiles(off.select(*keys, F.abs(F.col("_e") - F.col("_m")).alias("_d")), keys, "_d", [0.5])
        middles, found = ({tuple(r[k] for k in keys): r["q"][0] for r in t.collect()} for t in (middle, apart))
        found = {k: (middles[k], d, None) for k, d in found.items()}
    share = MOST_NEAR / (2 * max(len(found), 1))  # values near the three guesses of a group
    for k, (m, d, near) in found.items():
        # without a count, as many as about a normal distribution's quartiles and median
        reach = share / max(1.5 * numbers[k], 1.0) * d if near is None else guesses[k][2] * min(max(share / max(near, 1), 0.5), 2.0)
        if near is None and k in guesses:
            reach = min(reach, guesses[k][2])
        guesses[k] = m, d, min(reach * shrink, 0.49 * d)
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.sparkSession.createDataFrame([(*k, 1.4826 * d) for k, (_, d, _) in found.items()], T.StructType.fromDDL(kinds + "mad double"))


#: Where a fit's numbers are at most so many, its rounds hand coefficients on through the driver; beyond, by written tables.
MOST_HELD = 1_000_000


class _Held:
    """Coefficients between rounds: local rows where they are few, else a written table."""

    def __init__(self, fit: DataFrame, few: bool | None = None, p: int = 1):
        if few is None:
            fit = staged(fit, release=False)
            few = fit.count() * (p + 2) <= MOST_HELD
        self.few, self.rows = few, fit.collect() if few else None
        self.table = fit.sparkSession.createDataFrame(self.rows, fit.schema) if few else staged(fit)

    def joined(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows with their group's coefficients in _b."""
        named = self.table.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("beta").alias("_b"))
        return rows.join(F.broadcast(named) if self.few or not keys else named, _same(keys))

    def largest_move(self, before: _Held, keys: list[str]) -> float:
        if not self.few:
            return _largest_move(self.table, before.table, keys)
        old = {tuple(r[k] for k in keys): r["beta"] for r in before.rows}
        moves = [abs(a - b) / (1 + abs(b)) for r in self.rows for a, b in zip(r["beta"], old[tuple(r[k] for k in keys)])]
        return max(moves, default=0.0)


def _largest_move(after: DataFrame, before: DataFrame, keys: list[str]) -> float:
    old = before.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("beta").alias("_b"))
    change = F.array_max(F.zip_with("beta", "_b", lambda a, b: F.abs(a - b) / (1 + F.abs(b))))
    return after.join(old, _same(keys)).agg(F.max(change)).first()[0] or 0.0


#: Links: (mean of eta, derivative of the mean, eta of a mean).
LINKS = {
    "identity": (lambda e: e, lambda e: F.lit(1.0), lambda m: m),
    "log": (lambda e: F.exp(e), lambda e: F.exp(e), lambda m: F.log(m)),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-e) / F.pow(1 + F.exp(-e), F.lit(2.0)), lambda m: F.log(m / (1 - m))),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda e: F.exp(e - F.exp(e)), lambda m: F.log(-F.log(1 - m))),
    "inverse": (lambda e: 1 / e, lambda e: -1 / (e * e), lambda m: 1 / m),
    "sqrt": (lambda e: e * e, lambda e: 2 * e, lambda m: F.sqrt(m)),
}
#: Families: variance of the mean, mean to begin with, usual link; negative binomial with theta 1, Tweedie with power 1.5.
FAMILIES = {
    "gaussian": (lambda m: F.lit(1.0), lambda y: y, "identity"),
    "poisson": (lambda m: m, lambda y: y + 0.5, "log"),
    "binomial": (lambda m: m * (1 - m), lambda y: (y + 0.5) / 2, "logit"),
    "gamma": (lambda m: m * m, lambda y: F.greatest(y, F.lit(1e-6)), "log"),
    "negative_binomial": (lambda m: m + m * m, lambda y: y + 0.5, "log"),
    "tweedie": (lambda m: F.pow(m, F.lit(1.5)), lambda y: y + 0.5, "log"),
}


def irls(rows: DataFrame, keys: list[str], x: list[Column], y: Column, family: str, rounds: int = 25, ridge: float = 1e-8, link: str | None = None, tol: float = 1e-8) -> DataFrame:
    """Coefficients of a generalised linear model by key: weighted Gram aggregates over all groups at once, until none moves.

    Only coefficients pass between rounds. Without keys all rows are one group: its one row of coefficients is joined."""
    variance, begin, usual = FAMILIES[family]
    mean, slope, eta_of = LINKS[link or usual]
    p = len(x)
    base = staged(rows.select(*keys, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)), y.cast("double").alias("_y")))
    own = [F.col(f"_x{i}") for i in range(p)]
    fit = _Held(solved(design_sums(base.withColumn("_z", eta_of(begin(F.col("_y")))), keys, own, F.col("_z")), keys, p, ridge).select(*keys, "beta", "n"), None, p)
    for _ in range(rounds):
        eta = sum((F.col("_b")[i] * c for i, c in enumerate(own)), F.lit(0.0))
        step = fit.joined(base, keys).withColumn("_eta", F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0)))
        mu, d = mean(F.col("_eta")), slope(F.col("_eta"))
        d = F.when(F.abs(d) < 1e-10, 1e-10).otherwise(d)
        step = step.withColumn("_z", F.col("_eta") + (F.col("_y") - mu) / d).withColumn("_w", d * d / F.greatest(variance(mu), F.lit(1e-10)))
        after = _Held(solved(design_sums(step, keys, own, F.col("_z"), F.col("_w")), keys, p, ridge).select(*keys, "beta", "n"), fit.few)
        moved = after.largest_move(fit, keys)
        fit = after
        if moved <= tol:
            break
    if fit.few:
        discard(base)
    return fit.table


def product_sums(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over rows of the outer product of two array columns of fixed width: each task sums its own, so no row is exploded."""
    def run(batches):
        total = 0.0
        for batch in batches:
            a, b = (np.asarray(batch.column(k).flatten(), float).reshape(batch.num_rows, -1) for k in (0, 1))
            total = total + a.T @ b if batch.num_rows else total
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.shape[1]], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["width", "s"])

    both = rows.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*(F.transform(c, lambda v: v.cast("double")).alias(k) for c, k in ((left, "a"), (right, "b"))))
    cells = both.mapInArrow(run, "width int, s array<double>").select("width", F.posexplode("s").alias("at", "x"))
    out = cells.groupBy("width", "at").agg(F.sum("x").alias("s")).orderBy("at").toPandas()  # as many sums as the product has cells
    return out["s"].to_numpy().reshape(-1, out["width"].iloc[0])


def covariance(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance with n - 1, n) of an array column of fixed width: d * d sums, whatever the number of rows."""
    with_one = F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.lit(1.0)))
    sums = product_sums(rows.select(with_one.alias("v")), "v", "v")  # the sums and the count stand in the last row
    n = int(sums[-1, -1])
    mean = sums[-1, :-1] / n
    centred = rows.select(F.zip_with(vector, F.array(*map(F.lit, map(float, mean))), lambda v, m: v.cast("double") - m).alias("v"))
    return mean, product_sums(centred, "v", "v") / (n - 1), n


def pca(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, explained variances, mean); the largest loading of each component is positive."""
    mean, cov, _ = covariance(rows, vector)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    components = vectors[:, top].T
    signs = np.sign(components[np.arange(k), np.abs(components).argmax(axis=1)])
    return components * signs[:, None], values[top], mean


def whitening(cov: np.ndarray, sphering: float = 1.0, eps: float = 0.0) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov + eps * np.eye(len(cov)))
    return (vectors * np.maximum(values, 1e-12) ** (-sphering / 2)) @ vectors.T


def _mapped(matrix: np.ndarray, before: np.ndarray, after: np.ndarray) -> Callable[[Column], Column]:
    """matrix (x - before) + after for the vectors of a batch at once; a null vector stays null."""

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        held = [v for v in vectors if v is not None]
        if not held:
            return pd.Series([None] * len(vectors), dtype=object)
        found = iter((np.stack(held).astype(float) - before) @ matrix.T + after)
        return pd.Series([None if v is None else next(found) for v in vectors], dtype=object)

    return run


def projected(rows: DataFrame, vector: str, matrix: np.ndarray, mean: np.ndarray, name: str = "z") -> DataFrame:
    """matrix (x - mean) of an array column."""
    return rows.withColumn(name, _mapped(matrix, mean, np.zeros(len(matrix)))(F.col(vector)))


def restored(rows: DataFrame, vector: str, matrix: np.ndarray, mean: np.ndarray, name: str = "restored") -> DataFrame:
    """matrix z + mean: the way back from `projected`."""
    return rows.withColumn(name, _mapped(matrix, np.zeros(matrix.shape[1]), mean)(F.col(vector)))


def shrinkage(rows: DataFrame, vector: str) -> DataFrame:
    """One row: Ledoit-Wolf and oracle-approximating intensities and the scale of the target, of the covariance with n."""
    mean, cov, n = covariance(rows, vector)
    centre = F.array(*map(F.lit, map(float, mean)))
    norm2 = F.aggregate(F.zip_with(F.transform(vector, lambda v: v.cast("double")), centre, lambda a, m: (a - m) * (a - m)), F.lit(0.0), lambda s, v: s + v)
    fourth = rows.agg(F.sum(norm2 * norm2)).first()[0]
    s = cov * (n - 1) / n
    p, mu = len(s), np.trace(s) / len(s)
    delta = ((s - mu * np.eye(p)) ** 2).sum()
    beta = min((fourth / n - (s**2).sum()) / n, delta)
    lw = beta / delta if delta else 0.0
    a2, t2 = (s**2).mean(), mu * mu
    denominator = (n + 1.0) * (a2 - t2 / p)
    oas = min((a2 + t2) / denominator, 1.0) if denominator else 1.0
    return rows.sparkSession.createDataFrame([(float(lw), float(oas), float(mu))], "ledoit_wolf double, oas double, mu double")


def kmeans(rows: DataFrame, vector: str, start: np.ndarray, rounds: int = 20, tol: float = 1e-4) -> np.ndarray:
    """Lloyd's rounds from given centroids; an empty cluster keeps its centroid, and the largest move ends them."""
    centroids = start.astype(float)
    for _ in range(rounds):
        member = F.array(*((F.col("cluster") == c).cast("double") for c in range(len(centroids))))
        with_one = F.concat(F.transform(vector, lambda v: v.cast("double")), F.array(F.lit(1.0)))
        sums = product_sums(assigned(rows, vector, centroids).select(member.alias("m"), with_one.alias("v")), "m", "v")  # k * (d + 1) numbers
        moved = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centroids)
        shift = np.abs(moved - centroids).max()
        centroids = moved
        if shift <= tol:
            break
    return centroids


def assigned(rows: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """rows with the number of the nearest centroid; of equals, the first."""
    distances = [squared_distance(F.transform(vector, lambda v: v.cast("double")), F.array(*map(F.lit, map(float, c)))) for c in centroids]
    return rows.withColumn("_d", F.array(*distances)).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def sinkhorn(spark: SparkSession, cost: DataFrame, a: DataFrame, b: DataFrame, eps: float, rounds: int) -> DataFrame:
    """Plan (i, j, p) of entropic transport: f, then g, a fixed number of rounds. cost: i, j, cost; a: i, a; b: j, b."""
    cost = staged(cost)
    f, g = a.select("i", F.lit(0.0).alias("f")), staged(b.select("j", F.lit(0.0).alias("g")))
    for _ in range(rounds):
        lse = stable_log_sum(cost.join(g, "j").select("i", ((F.col("g") - F.col("cost")) / eps).alias("t")), ["i"], "t")
        f = staged(a.join(lse, "i").select("i", (eps * (F.log("a") - F.col("value"))).alias("f")))
        lse = stable_log_sum(cost.join(f, "i").select("j", ((F.col("f") - F.col("cost")) / eps).alias("t")), ["j"], "t")
        g = staged(b.join(lse, "j").select("j", (eps * (F.log("b") - F.col("value"))).alias("g")))
    plan = F.exp((F.col("f") + F.col("g") - F.col("cost")) / eps)
    return cost.join(f, "i").join(g, "j").select("i", "j", plan.alias("p"))


def barycentric_map(plan: DataFrame, a: DataFrame, targets: DataFrame) -> DataFrame:
    """(i, y): the plan's mean of targets (j, y) by source, over its marginal (i, a)."""
    sums = plan.join(targets, "j").groupBy("i").agg(F.sum(F.col("p") * F.col("y")).alias("_y"))
    return sums.join(a, "i").select("i", (F.col("_y") / F.col("a")).alias("y"))


def nmf(rows: DataFrame, vector: str, start: np.ndarray, rounds: int = 10, eps: float = 1e-10) -> tuple[DataFrame, np.ndarray]:
    """Multiplicative updates with the small factor (k x d) on the driver: each round is one pass and k * (k + d) sums."""
    k, d = start.shape
    h = start.astype(float)
    rows = staged(rows.withColumn("_w", F.array(*[F.lit(1.0)] * k)).withColumn("_x", F.transform(vector, lambda v: F.greatest(v.cast("double"), F.lit(0.0)))))
    for _ in range(rounds):
        hh = h @ h.T
        num = [F.aggregate(F.zip_with("_x", F.array(*map(F.lit, map(float, h[r]))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for r in range(k)]
        den = [F.aggregate(F.zip_with("_w", F.array(*map(F.lit, map(float, hh[r]))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for r in range(k)]
        rows = staged(rows.withColumn("_w", F.array(*(F.col("_w")[r] * num[r] / (den[r] + eps) for r in range(k)))))
        wx, ww = product_sums(rows, "_w", "_x"), product_sums(rows, "_w", "_w")
        h = h * wx / (ww @ h + eps)
    return rows.withColumnRenamed("_w", "basis").drop("_x"), h


def group_grams(rows: DataFrame, group: str, x: Column, z: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.sum(z * z).alias("ztz"), F.sum(x * z).alias("xtz"), F.sum(x * x).alias("xtx"), F.count("*").alias("n"))


def crossed_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by each factor and by both, in one pass over grouping sets."""
    return rows.groupingSets([[first], [second], [first, second]], first, second).agg(F.count("*").alias("n"))


def nested_counts(rows: DataFrame, outer: str, inner: str, x: Column) -> DataFrame:
    """Counts and sums by (outer, inner) and by outer, as a rollup without the grand total."""
    return rows.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.count("*").alias("n"), F.sum(x).alias("s"))
