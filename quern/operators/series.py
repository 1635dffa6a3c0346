"""Time series operators: windows by series ordered by time."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_interpolate(rows: DataFrame, series: str, t: str, value: str, observed: str) -> DataFrame:
    """Fill unobserved values between the nearest observed ones; edges repeat the nearest, nothing observed gives 0."""
    back = Window.partitionBy(series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(series).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(observed), F.struct(F.col(t).cast("double").alias("t"), F.col(value).alias("v")))
    a, b = F.last(seen, True).over(back), F.first(seen, True).over(ahead)
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    share = (F.col(t).cast("double") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    between = F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))
    filled = F.when(F.col(observed), F.col(value)).otherwise(F.coalesce(between, F.col("_a.v"), F.col("_b.v"), F.lit(0.0)))
    return rows.withColumn("filled", filled).drop("_a", "_b")


def polynomial_detrend(rows: DataFrame, series: str, t: str, value: str) -> DataFrame:
    """Residual of a straight line by series; moments are aggregated and joined back."""
    fit = rows.groupBy(F.col(series).alias("_k")).agg(F.regr_slope(value, t).alias("_b"), F.regr_intercept(value, t).alias("_a"), F.avg(value).alias("_m"))
    line = F.coalesce(F.col("_a") + F.col("_b") * F.col(t), F.col("_m"))
    return rows.join(fit, F.col(series).eqNullSafe(F.col("_k"))).withColumn("detrended", F.col(value) - line).drop("_k", "_a", "_b", "_m")


def tsconv(rows: DataFrame, series: str, t: str, value: str, taps: list[float]) -> DataFrame:
    """Cross-correlation with centred taps (the kernel isn't flipped); off the ends the series is 0."""
    w, half = Window.partitionBy(series).orderBy(t), len(taps) // 2
    terms = [F.coalesce(F.lag(value, half - k).over(w) if k != half else F.col(value), F.lit(0.0)) * tap for k, tap in enumerate(taps)]
    return rows.withColumn("convolved", sum(terms[1:], terms[0]))


def _frame(series: str, t: str, half: int) -> Window:
    return Window.partitionBy(series).orderBy(t).rowsBetween(-half, half)


def dilate(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return rows.withColumn("dilated", F.max(value).over(_frame(series, t, half)))


def erode(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return rows.withColumn("eroded", F.min(value).over(_frame(series, t, half)))


def opening(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return dilate(erode(rows, series, t, value, half), series, t, "eroded", half).withColumnRenamed("dilated", "opened")


def closing(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return erode(dilate(rows, series, t, value, half), series, t, "dilated", half).withColumnRenamed("eroded", "closed")


def box_mean(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return rows.withColumn("smoothed", F.avg(value).over(_frame(series, t, half)))


def median_filter(rows: DataFrame, series: str, t: str, value: str, half: int) -> DataFrame:
    return rows.withColumn("median", F.percentile(value, 0.5).over(_frame(series, t, half)))


def gradient(rows: DataFrame, series: str, t: str, value: str, spacing: float = 1.0) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(series).orderBy(t)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    inner = (after - before) / (2 * spacing)
    out = F.coalesce(inner, (after - F.col(value)) / spacing, (F.col(value) - before) / spacing, F.lit(0.0))
    return rows.withColumn("gradient", out)


def unwrapped_phase(rows: DataFrame, series: str, t: str, phase: str, period: float = 2 * math.pi) -> DataFrame:
    """Phase with jumps of over half a period removed."""
    w = Window.partitionBy(series).orderBy(t)
    step = F.col(phase) - F.lag(phase).over(w)
    jump = F.coalesce(-F.round(step / period) * period, F.lit(0.0))
    return rows.withColumn("_j", jump).withColumn("unwrapped", F.col(phase) + F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def instantaneous_frequency(rows: DataFrame, series: str, t: str, phase: str, fs: float = 1.0, period: float = 2 * math.pi) -> DataFrame:
    """Differences of the unwrapped phase; one sample fewer in each series."""
    w = Window.partitionBy(series).orderBy(t)
    steps = unwrapped_phase(rows, series, t, phase, period)
    out = steps.withColumn("frequency", (F.col("unwrapped") - F.lag("unwrapped").over(w)) * fs / period)
    return out.filter(F.col("frequency").isNotNull()).drop("unwrapped")


def lomb_scargle(rows: DataFrame, series: str, t: str, value: str, frequencies: list[float]) -> DataFrame:
    """Normalised periodogram of unevenly sampled series: two aggregates over samples x frequencies, means first."""
    stats = rows.groupBy(F.col(series).alias("_k")).agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    x = rows.join(stats, F.col(series).eqNullSafe(F.col("_k"))).withColumn("_x", F.col(value) - F.col("_m"))
    grid = F.explode(F.array(*map(F.lit, frequencies)))
    at = x.select(F.col(series).alias("series"), F.col(t).cast("double").alias("_t"), "_x", "_v", grid.alias("frequency")).withColumn("_w", 2 * math.pi * F.col("frequency"))
    angle = 2 * F.col("_w") * F.col("_t")
    taus = at.groupBy("series", "frequency").agg(F.sum(F.sin(angle)).alias("_s"), F.sum(F.cos(angle)).alias("_c"))
    both = at.join(taus, ["series", "frequency"]).withColumn("_tau", F.atan2("_s", "_c") / (2 * F.col("_w")))
    c, s = F.cos(F.col("_w") * (F.col("_t") - F.col("_tau"))), F.sin(F.col("_w") * (F.col("_t") - F.col("_tau")))
    sums = both.groupBy("series", "frequency").agg(F.sum(F.col("_x") * c).alias("xc"), F.sum(F.col("_x") * s).alias("xs"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.first("_v").alias("v"))
    power = (F.pow("xc", F.lit(2)) / F.greatest("cc", F.lit(1e-12)) + F.pow("xs", F.lit(2)) / F.greatest("ss", F.lit(1e-12))) / (2 * F.greatest("v", F.lit(1e-12)))
    return sums.select("series", "frequency", power.alias("power"))


def ar1_whiten(rows: DataFrame, series: str, t: str, value: str, rho: float) -> DataFrame:
    """Innovations (x - rho lag(x)) / sqrt(1 - rho^2); the first value of a series stays."""
    before = F.lag(value).over(Window.partitionBy(series).orderBy(t))
    return rows.withColumn("white", F.coalesce((F.col(value) - rho * before) / math.sqrt(1 - rho * rho), F.col(value)))


def car1_whiten(rows: DataFrame, series: str, t: str, value: str, rho: float) -> DataFrame:
    """As ar1_whiten with rho to the power of the elapsed time."""
    w = Window.partitionBy(series).orderBy(t)
    r = F.pow(F.lit(rho), F.col(t).cast("double") - F.lag(F.col(t).cast("double")).over(w))
    return rows.withColumn("white", F.coalesce((F.col(value) - r * F.lag(value).over(w)) / F.sqrt(1 - r * r), F.col(value)))


def cs_whiten(rows: DataFrame, group: str, value: str, a: float, b: float) -> DataFrame:
    """Compound symmetry: a z + (b - a) group mean, the mean aggregated and joined back."""
    means = rows.groupBy(F.col(group).alias("_k")).agg(F.avg(value).alias("_m"))
    return rows.join(means, F.col(group).eqNullSafe(F.col("_k"))).withColumn("white", a * F.col(value) + (b - a) * F.col("_m")).drop("_k", "_m")


def per_series(rows: DataFrame, series: str, t: str, value: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """A NumPy kernel over each whole series in the order of time, for recurrences and transforms; a series is one group."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        out = kernel(part["v"].to_numpy(float))
        return pd.DataFrame({"series": part["series"], "t": part["t"], **{n: out[n] for n in names}})

    ready = rows.select(F.col(series).alias("series"), F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    kind = {f.name: f.dataType.simpleString() for f in ready.schema}
    schema = f"series {kind['series']}, t {kind['t']}, " + ", ".join(f"{n} double" for n in names)
    return ready.groupBy("series").applyInPandas(run, schema)


def analytic(x: np.ndarray) -> dict[str, np.ndarray]:
    """Real and imaginary part, envelope and phase of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    z = np.fft.ifft(np.fft.fft(x) * gain)
    return {"re": z.real, "im": z.imag, "envelope": np.abs(z), "phase": np.angle(z)}


def rank_average(rows: DataFrame, keys: list[str], value: str) -> Column:
    """Average rank of ties within keys."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2
