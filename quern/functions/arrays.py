"""Row vectors as arrays of doubles: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column, theta: Column | None = None) -> Column:
    """Sum of theta (a - b) ** 2, at least 0."""
    terms = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    terms = terms if theta is None else F.zip_with(terms, theta, lambda t, w: t * w)
    return F.greatest(_sum(terms), F.lit(0.0))


def lp_norm(a: Column, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(_sum(F.transform(a, lambda v: v * v)))
    return F.pow(_sum(F.transform(a, lambda v: F.pow(F.abs(v), F.lit(p)))), F.lit(1.0 / p))


def lp_normalize(a: Column, p: float = 2.0, eps: float = 1e-12) -> Column:
    norm = F.greatest(lp_norm(a, p), F.lit(eps))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(a, lambda v: v / n)), F.lit(0))


def log_softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = top + F.log(_sum(F.transform(a, lambda v: F.exp(v - top))))
    return F.get(F.transform(F.array(total), lambda t: F.transform(a, lambda v: v - t)), F.lit(0))


def eta_squared(x: Column, y: Column) -> Column:
    """1 - sum of squares within pairs / total sum of squares."""
    grand = (_sum(x) + _sum(y)) / (2 * F.size(x))
    within = _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b) / 2))
    total = _sum(F.zip_with(x, y, lambda a, b: (a - grand) * (a - grand) + (b - grand) * (b - grand)))
    return 1 - within / total


def top_k(logits: Column, k: int) -> Column:
    """Positions of the k largest entries; of equals, the first ones."""
    ordered = F.array_sort(F.transform(logits, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ordered, 1, k), lambda s: s["i"])


def kronecker(a: Column, b: Column) -> Column:
    """Row-wise tensor product of two bases."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def kl_diagonal_gaussian(mean: Column, log_var: Column) -> Column:
    return 0.5 * _sum(F.zip_with(mean, log_var, lambda m, v: m * m + F.exp(v) - 1 - v))


def dino_cross_entropy(student: Column, teacher: Column, center: Column, student_temp: float = 0.1, teacher_temp: float = 0.04) -> Column:
    own = log_softmax(F.transform(student, lambda v: v / student_temp))
    aim = log_softmax(F.zip_with(teacher, center, lambda t, c: (t - c) / teacher_temp))
    return -_sum(F.zip_with(aim, own, lambda t, s: F.exp(t) * s))
