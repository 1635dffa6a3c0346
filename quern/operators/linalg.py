"""Matrices as cell tables (i, j, value), symmetric matrices by row, and solvers on edge tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.semiring import edge_rmatvec
from quern.session import staged


def symmetric(cells: DataFrame, skew: bool = False) -> DataFrame:
    """(X + X^T) / 2, or (X - X^T) / 2."""
    sign = -1.0 if skew else 1.0
    swapped = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), (sign * F.col("value")).alias("value"))
    return cells.select("i", "j", "value").union(swapped).groupBy("i", "j").agg((F.sum("value") / 2).alias("value"))


def fill_diagonal(cells: DataFrame, fill: float = 0.0, offset: int = 0) -> DataFrame:
    return cells.select("i", "j", F.when(F.col("j") - F.col("i") == offset, fill).otherwise(F.col("value")).alias("value"))


def delete_diagonal(cells: DataFrame) -> DataFrame:
    return fill_diagonal(cells, 0.0)


def recondition(cells: DataFrame, psi: float, xi: float = 0.0, seed: int = 0) -> DataFrame:
    """A + (psi - xi) I + diag(uniform(0, xi)), the uniform number by hash of the index."""
    noise = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) / float(1 << 30)
    return cells.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("value") + (psi - xi) + xi * noise).otherwise(F.col("value")).alias("value"))


def vec_to_sym(vec: DataFrame, n: int, offset: int = 1) -> DataFrame:
    """Cells of the symmetric matrix whose upper triangle, in row order, is (k, value)."""
    starts = [0]
    for i in range(n):
        starts.append(starts[-1] + max(0, n - offset - i))
    table = F.array(*map(F.lit, starts))
    row = (F.size(F.filter(table, lambda s: s <= F.col("k"))) - 1).cast("long")
    upper = vec.select(row.alias("i"), (F.col("k") - F.get(table, row.cast("int")) + row + offset).cast("long").alias("j"), "value")
    lower = upper.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return upper.union(lower)


def spectral_density(omega: Column, kernel: str, rho: float, amplitude: float = 1.0, dim: int = 1) -> Column:
    """Spectral density of a squared-exponential or Matern 1/2, 3/2 or 5/2 kernel."""
    if kernel == "se":
        return F.exp(-0.5 * rho**2 * omega * omega) * (amplitude * (2 * math.pi) ** (dim / 2) * rho**dim)
    nu = {"matern12": 0.5, "matern32": 1.5, "matern52": 2.5}[kernel]
    scale = amplitude * 2**dim * math.pi ** (dim / 2) * math.gamma(nu + dim / 2) * (2 * nu) ** nu / (math.gamma(nu) * rho ** (2 * nu))
    return scale * F.pow(2 * nu / rho**2 + omega * omega, F.lit(-(nu + dim / 2)))


def spd_function(name: str, power: float = 1.0, psi: float = 0.0) -> Callable[[Column], Column]:
    """A function on the eigenvalues of symmetric matrices held by row as flat arrays: log, exp, sqrt, inverse_sqrt, power."""
    of = {"log": lambda w: np.log(np.maximum(w, 1e-12)), "exp": np.exp, "sqrt": lambda w: np.sqrt(np.maximum(w, 0)), "inverse_sqrt": lambda w: 1 / np.sqrt(np.maximum(w, 1e-12)), "power": lambda w: np.maximum(w, 1e-12) ** power}[name]

    @F.pandas_udf("array<double>")
    def run(matrices: pd.Series) -> pd.Series:
        out = []
        for flat in matrices:
            m = np.asarray(flat, float)
            m = m.reshape(math.isqrt(len(m)), -1)
            w, v = np.linalg.eigh((m + m.T) / 2 + psi * np.eye(len(m)))
            out.append(((v * of(w)) @ v.T).ravel())
        return pd.Series(out)

    return run


def tangent_project(reference: np.ndarray, inverse: bool = False) -> Callable[[Column], Column]:
    """log(R^-1/2 S R^-1/2) of flat matrices S at a reference R, or back from the tangent space."""
    w, v = np.linalg.eigh(reference)
    outer = (v * np.sqrt(w) ** (1 if inverse else -1)) @ v.T

    @F.pandas_udf("array<double>")
    def run(matrices: pd.Series) -> pd.Series:
        out = []
        for flat in matrices:
            m = np.asarray(flat, float).reshape(outer.shape)
            x, u = np.linalg.eigh(m if inverse else outer @ m @ outer)
            y = (u * (np.exp(x) if inverse else np.log(np.maximum(x, 1e-12)))) @ u.T
            out.append((outer @ y @ outer if inverse else y).ravel())
        return pd.Series(out)

    return run


def mean_log_euclidean(rows: DataFrame, matrix: str) -> DataFrame:
    """exp of the mean of logs of flat matrices, one row: the mean is an aggregate of d * d cells."""
    logs = rows.select(F.posexplode(spd_function("log")(F.col(matrix))).alias("k", "x"))
    cells = logs.groupBy("k").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    return cells.select(spd_function("exp")(F.col("mean")).alias("mean"))


def conjugate_gradient(edges: DataFrame, b: DataFrame, rounds: int = 50, tol: float = 1e-8, l2: float = 0.0) -> DataFrame:
    """x of (A + l2 I) x = b for a symmetric positive definite edge table; b: id, v. Scalars go to the driver, vectors don't."""
    def applied(p: DataFrame) -> DataFrame:
        image = edge_rmatvec(edges, p).select(F.col("dst").alias("id"), F.col("value").alias("_a"))
        return p.join(image, "id", "left").select("id", F.col("v").alias("p"), (F.coalesce("_a", F.lit(0.0)) + l2 * F.col("v")).alias("ap"))

    edges = staged(edges)  # every round reads them
    state = staged(b.select("id", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")))
    rr = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    stop = tol * tol * rr
    for _ in range(rounds):
        if rr <= stop:
            break
        image = staged(applied(state.select("id", F.col("p").alias("v"))))
        alpha = rr / image.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = staged(state.join(image.select("id", "ap"), "id").select("id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p"))
        after = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = moved.select("id", "x", "r", (F.col("r") + (after / rr) * F.col("p")).alias("p"))
        rr = after
    return state.select("id", F.col("x").alias("v"))


def procrustes(rows: DataFrame, a: str, b: str, width: int, allow_reflection: bool = True) -> np.ndarray:
    """The orthogonal map of array column a onto b: width * width sums, then a small decomposition."""
    pairs = rows.select(F.posexplode(a).alias("i", "x"), F.col(b).alias("_b")).select("i", "x", F.posexplode("_b").alias("j", "y"))
    m = np.zeros((width, width))
    for r in pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():
        m[r["i"], r["j"]] = r["s"]
    u, _, vt = np.linalg.svd(m)
    if not allow_reflection and np.linalg.det(u @ vt) < 0:
        u[:, -1] = -u[:, -1]
    return u @ vt


def subspace_angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    q, _ = np.linalg.qr(x)
    r, _ = np.linalg.qr(y)
    return np.arccos(np.clip(np.linalg.svd(q.T @ r, compute_uv=False), -1, 1))
