"""Convolutions of series of any length by blocks with a halo: wavelet transforms and frequency filters.

What a gain over frequencies does to a series is a convolution with its impulse response. Where that fades, a block of the
series needs only so many samples beyond its ends (the halo; at the series' own ends those of its other end, as the
discrete Fourier transform has it). Rows go to the blocks whose halo they lie in, once or a few times; a block is a group
of bounded size and is convolved by its own transform. A series that is shorter than a block with its halos is one group
and gets the transform of its own length, exactly.

Samples of a series stand at consecutive whole numbers. A null value counts as 0. Without rows there are none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a block at least; it has at least so many halos' length.
BLOCK, HALOS = 1 << 14, 2
#: A response is left off where the norm of all that follows is less than FADED of its own. Longest halo that is tried.
FADED, LONGEST = 1e-8, 1 << 18

Gain = Callable[[np.ndarray], np.ndarray]


def response(gain: Gain, number: int) -> np.ndarray:
    """Impulse response, centred, of a gain over angular frequencies, from a grid of `number` of them."""
    return np.fft.fftshift(np.fft.ifft(gain(2 * np.pi * np.fft.fftfreq(number))))


def halo(gains: list[Gain]) -> int:
    """Samples on either side after which all responses have faded; a gain that jumps has none, which is an error."""
    number = 1 << 10
    while number <= 2 * LONGEST:
        reach = 0
        for gain in gains:
            h = np.abs(response(gain, number))
            loud = np.flatnonzero(h > FADED * h.max())
            reach = max(reach, int(np.abs(loud - number // 2).max()))
        if reach < number // 4:
            return reach + 1
        number *= 2
    raise ValueError("the response of a gain does not fade within the longest halo")


def convolved(rows: DataFrame, series: str, t: str, value: str, gains: list[Gain]) -> DataFrame:
    """series, t, re, im: arrays with what each gain makes of the series."""
    reach = halo(gains)
    length = max(BLOCK, HALOS * reach)
    own = rows.select(F.col(series).alias("series"), F.col(t).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    ends = own.groupBy(F.col("series").alias("_s")).agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.count("*").alias("_n"))
    whole = F.when(F.col("_last") - F.col("_first") + 1 == F.col("_n"), F.col("_n")).otherwise(F.raise_error(F.lit("samples do not stand at consecutive whole numbers")).cast("long"))
    ends = ends.select("_s", "_first", whole.alias("_n"))
    met = own.join(ends, F.col("series").eqNullSafe(F.col("_s"))).withColumn("_at", F.col("t") - F.col("_first")).drop("_s", "_first")
    short = F.col("_n") <= length + 2 * reach
    last = F.floor((F.col("_n") - 1) / length)
    turns = F.array(F.lit(0), F.col("_n"), -F.col("_n"))

    def blocks(p: Column) -> Column:
        low, high = F.greatest(F.lit(0), F.floor((p - reach) / length)), F.least(last, F.floor((p + reach) / length))
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda b: F.struct(b.alias("block"), p.alias("p")))).otherwise(F.array().cast("array<struct<block: long, p: long>>"))

    dealt = F.when(short, F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("_at").cast("long").alias("p")))).otherwise(F.flatten(F.transform(turns, lambda s: blocks(F.col("_at") + s))))
    placed = met.select("series", "t", "v", "_n", short.alias("_short"), F.explode(dealt).alias("_b")).select("series", "t", "v", "_n", "_short", "_b.block", "_b.p")
    number = 1 << math.ceil(math.log2(length + 4 * reach))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p", kind="stable")
        x, p = part["v"].to_numpy(float), part["p"].to_numpy(np.int64)
        if part["_short"].iloc[0]:
            f, mine = np.fft.fft(x), slice(None)
            found = [np.fft.ifft(f * g(2 * np.pi * np.fft.fftfreq(len(x)))) for g in gains]
        else:
            start = int(part["block"].iloc[0]) * length
            mine = (p >= start) & (p < start + length) & (p < part["_n"].iloc[0])
            f, found = np.fft.fft(x, number), []
            for g in gains:
                h = response(g, number)
                h = h[number // 2 - reach : number // 2 + reach + 1]
                found.append(np.fft.ifft(f * np.fft.fft(h, number))[reach : reach + len(x)])
        z = np.stack(found, axis=1)[mine]
        return pd.DataFrame({"series": part["series"][mine], "t": part["t"][mine], "re": list(z.real), "im": list(z.imag)})

    return placed.groupBy("series", "block").applyInPandas(run, f"series {kinds['series']}, t {kinds['t']}, re array<double>, im array<double>")


def wavelet(kind: str, scale: float, omega0: float = 6.0, order: int = 4, dt: float = 1.0) -> Gain:
    """The conjugate Fourier transform of a wavelet at a scale, of unit energy: morlet, ricker or paul."""
    def gain(w: np.ndarray) -> np.ndarray:
        s = scale * w / dt
        up = np.maximum(s, 0.0)
        if kind == "morlet":
            psi = math.pi**-0.25 * (s > 0) * np.exp(-0.5 * (s - omega0) ** 2)
        elif kind == "ricker":
            psi = s**2 * np.exp(-0.5 * s**2) / math.sqrt(math.gamma(2.5))
        elif kind == "paul":
            psi = 2.0**order / math.sqrt(order * math.factorial(2 * order - 1)) * up**order * np.exp(-up)
        else:
            raise ValueError(f"no wavelet {kind!r}")
        return psi * math.sqrt(2 * math.pi * scale / dt)

    return gain


def cwt(rows: DataFrame, series: str, t: str, value: str, scales: list[float], kind: str = "morlet", omega0: float = 6.0, order: int = 4, dt: float = 1.0) -> DataFrame:
    """series, t, re, im: arrays of wavelet coefficients, one a scale."""
    return convolved(rows, series, t, value, [wavelet(kind, s, omega0, order, dt) for s in scales])


def flat_gain(lo: float | None, hi: float | None, fs: float = 1.0, order: int = 2, stop: bool = False, once: bool = False) -> Gain:
    """Zero-phase maximally flat filter: below hi, above lo, or between; with stop, what is left without that. Once: in
    one direction, so that the gain is the root of that of both."""
    def gain(w: np.ndarray) -> np.ndarray:
        f, g = np.abs(w) * fs / (2 * np.pi), np.ones_like(w)
        if hi is not None:
            g = g / (1 + (f / hi) ** (2 * order))
        if lo is not None:
            g = g * f ** (2 * order) / (f ** (2 * order) + lo ** (2 * order))
        g = np.sqrt(g) if once else g
        return 1 - g if stop else g

    return gain
