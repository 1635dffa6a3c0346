"""Recursive filters over series of any length: cascades of second-order sections as scans of their state spaces."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import scans
from quern.session import staged


def butterworth_sos(order: int, btype: str, lo: float | None = None, hi: float | None = None, fs: float = 1.0) -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a Butterworth filter by the bilinear map of its prewarped poles."""
    warp = lambda f: 4 * math.tan(math.pi * f / fs)
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if btype == "lowpass":
        w = warp(hi)
        poles, zeros, gain = w * poles, np.zeros(0, complex), w**order
    elif btype == "highpass":
        w = warp(lo)
        poles, zeros, gain = w / poles, np.zeros(order, complex), 1.0
    else:
        width, middle = warp(hi) - warp(lo), warp(lo) * warp(hi)
        half = width * poles / 2 if btype == "bandpass" else width / (2 * poles)
        root = np.sqrt(half**2 - middle + 0j)
        poles = np.concatenate([half + root, half - root])
        zeros, gain = (np.zeros(order, complex), width**order) if btype == "bandpass" else (np.concatenate([np.full(order, 1j), np.full(order, -1j)]) * math.sqrt(middle), 1.0)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), np.full(len(poles) - len(zeros), -1.0)])
    poles = (4 + poles) / (4 - poles)

    def pairs(roots: np.ndarray) -> list[np.ndarray]:
        upper = sorted(roots[roots.imag > 1e-10], key=lambda r: -abs(r))
        real = sorted(roots[np.abs(roots.imag) <= 1e-10].real, key=lambda r: -abs(r))
        out = [np.real(np.poly([r, np.conj(r)])) for r in upper]
        return out + [np.concatenate([np.poly(real[i : i + 2]), np.zeros(max(0, 2 - len(real[i : i + 2])))]) for i in range(0, len(real), 2)]

    sections = [np.concatenate([b, a]) for b, a in zip(pairs(zeros), pairs(poles))]
    sections[0][:3] *= gain
    return np.array(sections)


def dc_gain(sos: np.ndarray) -> float:
    return float(np.prod(sos[:, :3].sum(axis=1) / sos[:, 3:].sum(axis=1)))


def impulse_response(sos: np.ndarray, n: int) -> np.ndarray:
    a, b, c, d = state_space(sos)
    out, state = np.empty(n), np.zeros(len(a))
    for k in range(n):
        x = 1.0 if k == 0 else 0.0
        out[k] = c @ state + d * x
        state = a @ state + b * x
    return out


def _section(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A, b, c of what a section adds to b0 x, in coordinates in which A turns and shrinks, so that its powers stay as exact
    for slow poles as for fast ones. Differences that nearly cancel are taken in fractions."""
    exact = Fraction
    one, two = exact(b1) - exact(a1) * exact(b0), exact(b2) - exact(a2) * exact(b0)
    middle, square = -exact(a1) / 2, exact(a1) ** 2 / 4 - exact(a2)
    root = math.sqrt(abs(square))
    if square < 0:
        turn = [[float(middle), -root], [root, float(middle)]]
        return np.array(turn), np.array([1.0, 0.0]), np.array([float(one), float(two + one * middle) / root])
    low, high = float(middle) - root, float(middle) + root
    return np.array([[high, 0.0], [1.0, low]]), np.array([1.0, 0.0]), np.array([float(one), float(two + one * exact(low))])


def state_space(sos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A, B, C, D of the cascade: s' = A s + B x, y = C s + D x; two states a section."""
    n = 2 * len(sos)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(np.asarray(sos, float)):
        own, into, out = _section(*map(float, (b0, b1, b2, a1, a2)))
        here = slice(2 * k, 2 * k + 2)
        a[here], b[here] = np.outer(into, c), into * d  # what the sections before give goes in
        a[here, here] = own
        c, d = c * b0, d * b0
        c[here] = out
    return a, b, c, d


def sosfilt(rows: DataFrame, series: str, t: str, value: str, sos: np.ndarray) -> DataFrame:
    """series, t, filtered: the causal cascade over each series in the order of time, from rest; a null counts as 0."""
    found = scans.scan(rows, series, t, [F.col(value)], scans.Constant(*state_space(sos)))
    return found.select("series", "t", F.col("y")[0].alias("filtered"))


def sosfiltfilt(rows: DataFrame, series: str, t: str, value: str, sos: np.ndarray, padlen: int | None = None) -> DataFrame:
    """series, t, filtered: forward and backward, each series prolonged at both ends by its odd reflection, from the steady
    state of its first value. A series of padlen values or fewer is left out, as it can't be reflected."""
    trivial = int(min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))
    padlen = 3 * (2 * len(sos) + 1 - trivial) if padlen is None else padlen
    w = Window.partitionBy("series")
    own = rows.select(F.col(series).alias("series"), F.col(t).alias("_t"), F.col(value).cast("double").alias("v"))
    own = own.withColumn("k", F.row_number().over(w.orderBy("_t")).cast("long") - 1).withColumn("n", F.count("*").over(w)).filter(F.col("n") > padlen)
    ends = own.groupBy("series").agg(F.min_by("v", "k").alias("_a"), F.max_by("v", "k").alias("_b"))
    both = own.join(ends, "series")
    left = F.when((F.col("k") >= 1) & (F.col("k") <= padlen), F.struct((-F.col("k")).alias("k"), (2 * F.col("_a") - F.col("v")).alias("v")))
    back = 2 * (F.col("n") - 1) - F.col("k")
    right = F.when((F.col("k") <= F.col("n") - 2) & (F.col("k") >= F.col("n") - 1 - padlen), F.struct(back.alias("k"), (2 * F.col("_b") - F.col("v")).alias("v")))
    here = F.struct(F.col("k").alias("k"), F.col("v").alias("v"))
    long = both.select("series", F.explode(F.array_compact(F.array(here, left, right))).alias("s")).select("series", "s.k", "s.v")
    for turn in (1, -1):
        long = staged(long.withColumn("k", F.col("k") * turn)) if turn == -1 else long
        start = long.groupBy("series").agg(F.min_by("v", "k").alias("_s"))
        moved = long.join(start, "series").withColumn("_d", F.col("v") - F.col("_s"))
        found = sosfilt(moved, "series", "k", "_d", sos)
        long = found.join(start, "series").select("series", F.col("t").alias("k"), (F.col("filtered") + dc_gain(sos) * F.col("_s")).alias("v"))
    out = long.select("series", (-F.col("k")).alias("k"), F.col("v").alias("filtered"))
    return own.select("series", "k", F.col("_t").alias("t")).join(out, ["series", "k"]).select("series", "t", "filtered")


def sample_windows(rows: DataFrame, series: str, t: str, size: int, number: int, seed: int = 0) -> DataFrame:
    """Windows of `size` values of each series at starts by hash of the seed: rows with window and place."""
    w = Window.partitionBy(series)
    placed = rows.withColumn("_k", F.row_number().over(w.orderBy(t)) - 1).withColumn("_n", F.count("*").over(w))
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(series).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    starts = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.struct(i.alias("window"), F.pmod(draw(i), F.col("_n") - size + 1).alias("start")))
    met = placed.filter(F.col("_n") >= size).withColumn("_w", F.explode(starts))
    inside = met.filter((F.col("_k") >= F.col("_w.start")) & (F.col("_k") < F.col("_w.start") + size))
    return inside.withColumn("window", F.col("_w.window")).withColumn("place", F.col("_k") - F.col("_w.start")).drop("_k", "_n", "_w")
