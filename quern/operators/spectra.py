"""Extreme eigenvectors of large symmetric edge tables, and embeddings of graphs by them.

Block Lanczos: a node's row holds its entries of all basis vectors so far, and each step multiplies the newest block by the
matrix (one join of the edges and one sum by node), takes the products of the basis with the result (sums a task makes, a
few thousand numbers to the driver), and appends what is orthogonal. The matrix in the basis is small; its eigenvectors
give those of the graph, and the last products tell their residuals, so that steps end when those are small.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.factors import _times
from quern.operators.models import product_sums
from quern.session import discard, staged


def _start(nodes: DataFrame, width: int, seed: int) -> DataFrame:
    """Normal numbers from hashes of the node and the seed."""
    uniform = lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(j)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    draws = [F.sqrt(-2 * F.log(uniform(2 * j))) * F.cos(2 * math.pi * uniform(2 * j + 1)) for j in range(width)]
    return nodes.select("id", F.array(*draws).alias("w"))


def _independent(gram: np.ndarray, tol: float = 1e-20) -> np.ndarray:
    """A matrix that turns vectors of this Gram matrix into orthonormal ones; directions with nothing are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > max(tol, 1e-14 * values.max(initial=0.0))
    return vectors[:, kept] / np.sqrt(values[kept])


def _appended(rows: DataFrame, size: int, width: int) -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
    """rows (id, s, w) with what of w is orthogonal to s appended to s; how many; s'w; and the Gram matrix of what was left."""
    first, left = None, None
    for _ in range(2):  # the second time clears what rounding left
        both = rows.withColumn("_b", F.concat("s", "w"))
        sums = product_sums(both, "_b", "w")
        inside, gram = sums[:size], sums[size:]
        rest = gram - inside.T @ inside
        first = inside if first is None else first
        left = rest if left is None else left
        turn = _independent(rest)
        if not turn.shape[1]:
            return rows, 0, first, left
        rows = _times(both.select("id", "s", F.col("_b").alias("w")), "w", np.vstack([-inside @ turn, turn]), "w")
    return rows.select("id", F.concat("s", "w").alias("s")), turn.shape[1], first, left


def eigenvectors(edges: DataFrame, nodes: DataFrame, k: int, steps: int = 40, extra: int = 4, tol: float = 1e-8, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(table id, vector), values: the k largest eigenvalues of a symmetric matrix (src, dst, value) over nodes (id), and
    unit vectors whose largest entry is positive. Fewer than k nodes give as many. Steps end when all residuals are at most
    tol of the largest value, or the space is used up."""
    held = staged(_start(nodes.select("id").distinct(), k + extra, seed).select("id", F.array().cast("array<double>").alias("s"), "w"))
    number = held.count()
    if not number:
        return nodes.select("id", F.array().cast("array<double>").alias("vector")), np.zeros(0)
    turn = _independent(product_sums(held, "w", "w"))
    basis = staged(_times(held, "w", turn, "w").select("id", F.col("w").alias("s")))
    discard(held)
    size = width = turn.shape[1]
    matrix = np.zeros((0, 0))
    for step in range(steps):
        newest = basis.select("id", F.slice("s", size - width + 1, width).alias("q"))
        sums = [F.sum(F.col("value") * F.col("q")[j]).alias(f"_{j}") for j in range(width)]
        image = edges.join(newest.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(*sums)
        met = basis.join(image.withColumnRenamed("dst", "id"), "id", "left")
        rows = staged(met.select("id", "s", F.array(*(F.coalesce(f"_{j}", F.lit(0.0)) for j in range(width))).alias("w")))
        after, added, inside, left = _appended(rows, size, width)
        whole = np.zeros((size, size))
        whole[: len(matrix), : len(matrix)] = matrix
        whole[:, size - width :] = inside
        whole[size - width :, :] = inside.T
        matrix = (whole + whole.T) / 2
        values, vectors = np.linalg.eigh(matrix)
        top = np.argsort(values)[::-1][:k]
        last = vectors[size - width :, top]
        residuals = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", last, left, last), 0))
        if not added or size + added > number or step == steps - 1 or residuals.max() <= tol * max(np.abs(values).max(), 1e-300):
            found = _times(basis.select("id", F.col("s").alias("vector")), "vector", vectors[:, top], "vector")
            return _signed(staged(found), len(top)), values[top]
        grown = staged(after)
        discard(basis, rows)
        basis, size, width = grown, size + added, added
    raise AssertionError("steps end within the loop")


def _signed(table: DataFrame, k: int) -> DataFrame:
    """Vectors whose largest entry (of equals, that of the least id) is positive."""
    best = table.agg(*(F.max_by(F.signum(F.col("vector")[j]), F.struct(F.round(F.abs(F.col("vector")[j]), 9), -F.xxhash64("id"))).alias(f"s{j}") for j in range(k))).first()
    signs = F.array(*(F.lit(float(v or 1.0)) for v in best))
    return table.select("id", F.zip_with("vector", signs, lambda a, s: a * s).alias("vector"))


def affinity(edges: DataFrame, alpha: float = 0.0, eps: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(D^-1/2 W D^-1/2 as edges, degrees id, d) of W = (A + A') / 2, first divided by the alpha-th powers of its degrees."""
    both = edges.select("src", "dst", F.col("value") / 2).union(edges.select("dst", "src", F.col("value") / 2))
    w = staged(both.toDF("src", "dst", "value").groupBy("src", "dst").agg(F.sum("value").alias("value")))

    def scaled(table: DataFrame, power: float) -> tuple[DataFrame, DataFrame]:
        d = table.groupBy(F.col("src").alias("id")).agg(F.greatest(F.sum("value"), F.lit(eps)).alias("d"))
        near = lambda c: d.select(F.col("id").alias(c), F.col("d").alias(f"_{c}"))
        met = table.join(near("src"), "src").join(near("dst"), "dst")
        return met.select("src", "dst", (F.col("value") / F.pow(F.col("_src") * F.col("_dst"), F.lit(power))).alias("value")), d

    if alpha:
        w = staged(scaled(w, alpha)[0])
    scaled_edges, degrees = scaled(w, 0.5)
    return staged(scaled_edges), staged(degrees)


def laplacian_eigenmap(edges: DataFrame, k: int, skip_trivial: bool = True, **options) -> tuple[DataFrame, np.ndarray]:
    """(table id, vector), values: the k smallest eigenvalues of I - D^-1/2 W D^-1/2 over the nodes of the edges (the first
    one left out if skip_trivial), ascending."""
    m, degrees = affinity(edges)
    table, values = eigenvectors(m, degrees, k + skip_trivial, **options)
    first = int(skip_trivial)
    return table.select("id", F.slice("vector", 1 + first, k).alias("vector")), 1 - values[first:]


def diffusion_embedding(edges: DataFrame, k: int, alpha: float = 0.5, t: float = 0.0, skip_trivial: bool = True, **options) -> tuple[DataFrame, np.ndarray]:
    """(table id, vector), values: right eigenvectors D^-1/2 v of the random walk, its largest eigenvalues first; with t,
    times the eigenvalues' t-th powers (of their size, with their sign)."""
    m, degrees = affinity(edges, alpha)
    table, values = eigenvectors(m, degrees, k + skip_trivial, **options)
    first = int(skip_trivial)
    values = values[first:]
    scale = F.array(*(F.lit(float(np.sign(v or 1.0) * abs(v) ** t) if t else 1.0) for v in values))
    moved = table.join(degrees, "id").select("id", "d", F.slice("vector", 1 + first, k).alias("vector"))
    return moved.select("id", F.zip_with("vector", scale, lambda a, s: a * s / F.sqrt("d")).alias("vector")), values
