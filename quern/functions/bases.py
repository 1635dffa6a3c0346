"""Rows of regression bases as arrays: splines, harmonics, Gaussian-process features, factors, products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import kronecker


def _weights(t, degree: int) -> tuple:
    """The weights of `uniform_bspline_weights`, of a column or of numbers."""
    u = 1 - t
    if degree == 1:
        return u, t
    if degree == 2:
        return u * u / 2, (1 + 2 * t - 2 * t * t) / 2, t * t / 2
    return u * u * u / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6, t * t * t / 6


def uniform_bspline_weights(t: Column, degree: int = 3) -> Column:
    """The degree + 1 weights of uniform B-splines at a place t within a span; they sum to one."""
    return F.array(*_weights(t, degree))


def bspline_basis(x: Column, low: float, high: float, number: int = 10, degree: int = 3) -> Column:
    """All values of a basis of uniform B-splines on [low, high], constant beyond it; not centred."""
    spans = number - degree
    s = (x - low) / (high - low) * spans
    span = F.least(F.greatest(F.floor(s), F.lit(0)), F.lit(spans - 1)).cast("int")
    at = F.least(F.greatest(s - span, F.lit(0.0)), F.lit(1.0))
    weights = uniform_bspline_weights(at, degree)
    held = F.struct(span.alias("k"), weights.alias("w"))
    places = F.sequence(F.lit(0), F.lit(number - 1))
    return F.get(F.transform(F.array(held), lambda h: F.transform(places, lambda i: F.coalesce(F.when((i >= h["k"]) & (i <= h["k"] + degree), F.get(h["w"], i - h["k"])), F.lit(0.0)))), F.lit(0))


def cyclic_basis(x: Column, low: float, high: float, number: int = 10, degree: int = 3) -> Column:
    """Periodic B-splines: places beyond the end go on at the start."""
    s = (x - low) / (high - low) * number
    span = F.pmod(F.floor(s), F.lit(number)).cast("int")
    held = F.struct(span.alias("k"), uniform_bspline_weights(s - F.floor(s), degree).alias("w"))
    places = F.sequence(F.lit(0), F.lit(number - 1))
    shifted = lambda h, i: F.pmod(i - h["k"], F.lit(number))
    return F.get(F.transform(F.array(held), lambda h: F.transform(places, lambda i: F.coalesce(F.when(shifted(h, i) <= degree, F.get(h["w"], shifted(h, i))), F.lit(0.0)))), F.lit(0))


def bspline_values(x: np.ndarray, low: float, high: float, number: int = 10, degree: int = 3) -> np.ndarray:
    """`bspline_basis` of numbers within a task, a row each."""
    spans = number - degree
    s = (x - low) / (high - low) * spans
    s = np.where(np.isnan(s), 1.0, s)  # SQL's least and greatest take NaN as the largest number
    span = np.clip(np.floor(s), 0, spans - 1)
    out, row, first = np.zeros((len(s), number)), np.arange(len(s)), span.astype(int)
    for j, w in enumerate(_weights(np.clip(s - span, 0.0, 1.0), degree)):
        out[row, first + j] = w
    return out


def cyclic_values(x: np.ndarray, low: float, high: float, number: int = 10, degree: int = 3) -> np.ndarray:
    """`cyclic_basis` of numbers within a task, a row each."""
    s = (x - low) / (high - low) * number
    down = np.floor(s)
    out, row, first = np.zeros((len(s), number)), np.arange(len(s)), np.where(np.isfinite(s), np.mod(down, number), 0).astype(int)
    for j, w in enumerate(_weights(s - down, degree)[:number]):
        out[row, (first + j) % number] = w
    return out


def periodic_features(x: Column, period: float, order: int) -> Column:
    """cos and sin of each harmonic, interleaved."""
    return F.array(*(f(2 * math.pi * j / period * x) for j in range(1, order + 1) for f in (F.cos, F.sin)))


def hilbert_basis(x: Column, low: float, high: float, number: int, density, boundary: float = 1.5) -> Column:
    """Hilbert-space features of a Gaussian process: sines of the box, by the square root of a spectral density."""
    middle, half = (low + high) / 2, boundary * max((high - low) / 2, 1e-6)
    roots = [math.pi * j / (2 * half) for j in range(1, number + 1)]
    return F.array(*(F.sqrt(density(F.lit(w))) * F.sin(w * (x - middle + half)) / math.sqrt(half) for w in roots))


def random_effect(level: Column, levels: list) -> Column:
    """One-hot of a factor."""
    return F.array(*((level == v).cast("double") for v in levels))


def by_factor(basis: Column, level: Column, levels: list) -> Column:
    """The basis in the block of the row's level, zeros in the others."""
    return kronecker(random_effect(level, levels), basis)


def varying_coefficient(basis: Column, by: Column) -> Column:
    return F.transform(basis, lambda b: b * by)


def gaussian_profile(x: Column, sigma: float, center: float = 0.0) -> Column:
    return F.exp(-(x - center) * (x - center) / (2 * sigma * sigma))


def gaussian_window(at: list[Column], shape: list[int], scale: float = 0.125) -> Column:
    """Separable Gaussian weight of a cell of a window of this shape, 1 in the middle."""
    out = F.lit(1.0)
    for x, n in zip(at, shape):
        out = out * gaussian_profile(x, max(scale * n, 1e-8), (n - 1) / 2)
    return out


def difference_penalty(n: int, order: int) -> list[list[float]]:
    """D^T D of the differences of an order."""
    rows = [[(-1.0) ** (order - k) * math.comb(order, k) if 0 <= (k := j - i) <= order else 0.0 for j in range(n)] for i in range(n - order)]
    return [[sum(r[i] * r[j] for r in rows) for j in range(n)] for i in range(n)]
