"""Sparse precision by connected parts, and decompositions of tall matrices by trees of small QRs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import graph
from quern.operators.models import product_sums
from quern.session import discard, staged


def _precision(s: np.ndarray, lam: float, sweeps: int, tol: float) -> np.ndarray:
    """The sparse precision of one part: each column's lasso on the working covariance, until no entry moves."""
    p = len(s)
    if p == 1:
        return 1 / s
    w, b = s.copy(), np.zeros((p, p))
    scale = np.abs(s).max()
    for _ in range(sweeps):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            inner, target, beta = w[np.ix_(rest, rest)], s[rest, j], b[rest, j]
            left = target - inner @ beta
            for _ in range(sweeps):
                moved = 0.0
                for k in range(p - 1):
                    wanted = left[k] + inner[k, k] * beta[k]
                    new = np.sign(wanted) * max(abs(wanted) - lam, 0.0) / inner[k, k]
                    if new != beta[k]:
                        left -= inner[:, k] * (new - beta[k])
                        moved = max(moved, abs(new - beta[k]) * inner[k, k])
                        beta[k] = new
                if moved <= tol * scale:
                    break
            b[rest, j] = beta
            w[rest, j] = w[j, rest] = inner @ beta
        if np.abs(w - before).max() <= tol * scale:
            break
    diagonal = 1 / (np.diag(w) - np.einsum("ij,ij->j", w * (1 - np.eye(p)), b))
    out = -b * diagonal
    out[np.diag_indices(p)] = diagonal
    return np.where((out != 0) & (out.T != 0), (out + out.T) / 2, 0.0)


def glasso(cov: DataFrame, lam: float, sweeps: int = 200, tol: float = 1e-11) -> DataFrame:
    """(i, j, value): the non-zero entries of the precision that minimises tr(S P) - log det P + lam sum of |P_ij| off the
    diagonal. cov: (i, j, value), symmetric, with a positive diagonal (else an error).

    Variables whose covariances beyond lam connect them are parts of their own, exactly; a part is solved in one task, so
    its square is what a task must hold."""
    edges = cov.filter((F.col("i") < F.col("j")) & (F.abs("value") > lam)).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    labels = graph.connected_components(edges, cov.select(F.col("i").alias("id")).distinct())
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
    inside = cov.join(of("i"), "i").join(of("j"), "j").filter(F.col("_i") == F.col("_j")).select(F.col("_i").alias("part"), "i", "j", F.col("value").cast("double").alias("value"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(part["i"])
        s = np.zeros((len(names), len(names)))
        s[np.searchsorted(names, part["i"]), np.searchsorted(names, part["j"])] = part["value"]
        if (np.diag(s) <= 0).any():
            raise ValueError("a variance is not positive")
        out = _precision(s, lam, sweeps, tol)
        i, j = np.nonzero(out)
        return pd.DataFrame({"i": names[i], "j": names[j], "value": out[i, j]})

    kind = cov.schema["i"].dataType.simpleString()
    return inside.groupBy("part").applyInPandas(run, f"i {kind}, j {kind}, value double")


#: Factors that one step of the tree stacks and decomposes again.
FAN = 16


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def tall_r(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    """R of the QR of the matrix whose rows are a table's vectors: a small QR a batch, then a tree of QRs of stacked factors.
    Signs are such that the diagonal is not negative."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            held = np.linalg.qr(np.vstack([held, _stacked(batch.column(0), width)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.ravel()], pa.list_(pa.float64()))], names=["r"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.vstack([np.reshape(v, (-1, width)) for v in part["r"]]), mode="r")
        return pd.DataFrame({"r": [r.ravel()]})

    factors = staged(rows.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(first, "r array<double>"), release=False)
    while (number := factors.count()) > 1:
        dealt = factors.withColumn("_g", F.pmod(F.xxhash64("r"), F.lit(-(-number // FAN))))
        after = staged(dealt.groupBy("_g").applyInPandas(merged, "r array<double>"), release=False)
        discard(factors)
        factors = after
    found = factors.first()
    if found is None:
        return np.zeros((0, width))
    r = np.reshape(found["r"], (-1, width))
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _times(rows: DataFrame, vector: str, matrix: np.ndarray, name: str) -> DataFrame:
    """rows with each vector times a matrix that a task can hold."""
    width = len(matrix)
    names = rows.columns
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _stacked(batch.column(vector), width) @ matrix
                kept = [n for n in names if n != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(list(found), pa.list_(pa.float64()))], names=[*kept, name])

    return rows.mapInArrow(run, f"{kinds}`{name}` array<double>")


def orthonormal(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """rows with the vectors of Q in the column's place: twice divided by R, so that Q is orthonormal to rounding. Directions
    in which the matrix has nothing come out as zeros."""
    for _ in range(2):
        r = tall_r(rows, vector, width)
        if not len(r):
            return rows
        rows = staged(_times(rows, vector, np.linalg.pinv(r, rcond=1e-13), vector), release=False)
    return rows


def randomized_svd(rows: DataFrame, key: str, vector: str, k: int, oversample: int = 10, power: int = 2, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(table key, u), s, vt: the k largest singular triplets of the matrix of a table's vectors (all of one width, nulls left
    out), by a seeded Gaussian sketch, power rounds and a small decomposition. The driver holds matrices of the vectors'
    width by k + oversample; the largest entry of each row of vt is positive."""
    x = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.transform(vector, lambda v: v.cast("double")).alias("_x"))
    head = x.first()
    if head is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, u array<double>"), np.zeros(0), np.zeros((0, 0))
    n = len(head["_x"])
    width = min(k + oversample, n)
    basis = orthonormal(_times(x, "_x", np.random.default_rng(seed).normal(size=(n, width)), "_q"), "_q", width)
    for _ in range(power):
        basis = orthonormal(_times(x, "_x", np.linalg.qr(product_sums(basis, "_x", "_q"))[0], "_q"), "_q", width)
    small = product_sums(basis, "_q", "_x")  # width x n
    u, s, vt = np.linalg.svd(small, full_matrices=False)
    signs = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(axis=1)])
    u, vt = u * signs, vt * signs[:, None]
    table = _times(basis.select(F.col("_key").alias(key), F.col("_q").alias("u")), "u", u[:, :k], "u")
    return table, s[:k], vt[:k]
