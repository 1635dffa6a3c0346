"""Recursive and frequency-domain filters of the values of users in the order of time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import blocks, filters, scans, series
from quern.sources.tables import read

DECAY = math.exp(-0.1)
LOW = filters.butterworth_sos(2, "lowpass", hi=0.2)
BAND = filters.butterworth_sos(2, "bandpass", lo=0.1, hi=0.3)
STOP = filters.butterworth_sos(2, "bandstop", lo=0.1, hi=0.3)
HIGH = filters.butterworth_sos(3, "highpass", lo=0.2)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("event_id", "user_id", "value", F.row_number().over(order).alias("t"))


def _sos(sos):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = filters.sosfilt(_series(spark, sf_dir), "user_id", "t", "value", sos)
        return out.select(F.col("series").alias("user_id"), "t", (F.round("filtered", 6) + 0.0).alias("filtered"))

    return query


def sosfiltfilt(spark, sf_dir):
    out = filters.sosfiltfilt(_series(spark, sf_dir), "user_id", "t", "value", LOW, 3)
    return out.select(F.col("series").alias("user_id"), "t", (F.round("filtered", 6) + 0.0).alias("filtered"))


def _masked(lo=None, hi=None, stop=False, once=False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = blocks.convolved(_series(spark, sf_dir), "user_id", "t", "value", [blocks.flat_gain(lo, hi, 1.0, 2, stop, once)])
        return out.select(F.col("series").alias("user_id"), "t", (F.round(F.col("re")[0], 6) + 0.0).alias("filtered"))

    return query


def analytic_signal(spark, sf_dir):
    out = series.per_series(_series(spark, sf_dir), "user_id", "t", "value", series.analytic, ["re", "im", "envelope", "phase"])
    return out.select(F.col("series").alias("user_id"), "t", *((F.round(c, 6) + 0.0).alias(c) for c in ("re", "im", "envelope")))


def cwt(spark, sf_dir):
    """Morlet coefficients at two scales."""
    out = blocks.cwt(_series(spark, sf_dir), "user_id", "t", "value", [5.0, 9.0])
    parts = [(F.round(F.col(c)[i], 5) + 0.0).alias(f"{c}{i}") for i in range(2) for c in ("re", "im")]
    return out.select(F.col("series").alias("user_id"), "t", *parts)


def selective_scan(spark, sf_dir):
    """Two channels of two states whose steps and gates depend on time and value."""
    rows, v = _series(spark, sf_dir), F.col("value")
    x, delta = [v / 100, 1 / (1 + F.col("t"))], [0.1 + 0.05 * (F.col("t") % 3), F.lit(0.2)]
    out = scans.selective_scan(rows, "user_id", "t", x, delta, np.array([[-0.5, -0.1], [-1.0, -0.3]]), [F.lit(1.0), v / 200], [F.lit(0.7), v / 300], np.array([0.1, -0.2]))
    return out.select(F.col("series").alias("user_id"), "t", *((F.round(F.col("y")[i], 6) + 0.0).alias(f"y{i}") for i in range(2)))


def sample_windows(spark, sf_dir):
    out = filters.sample_windows(_series(spark, sf_dir), "user_id", "t", 3, 2, 11)
    return out.select("user_id", "window", F.col("place").cast("long").alias("place"), "event_id")


QUERIES = {
    "iir_one_pole": _sos(np.array([[1 - DECAY, 0.0, 0.0, 1.0, -DECAY, 0.0]])), "sosfilt_lowpass": _sos(LOW), "sosfilt_bandpass": _sos(BAND), "sosfilt_bandstop": _sos(STOP),
    "sosfilt_highpass": _sos(HIGH), "sosfiltfilt": sosfiltfilt, "lowpass": _masked(hi=0.2), "highpass": _masked(lo=0.1), "bandpass": _masked(0.1, 0.3),
    "bandstop": _masked(0.1, 0.3, stop=True), "product_filter": _masked(hi=0.2, once=True), "analytic_signal": analytic_signal, "sample_windows": sample_windows, "selective_scan": selective_scan, "cwt": cwt,
}

_S = "s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events WHERE user_id IS NOT NULL)"


def _response(sos) -> str:
    """The impulse response as a list, as long as it matters."""
    values = filters.impulse_response(sos, 400)
    return "[" + ", ".join(f"{v!r}" for v in map(float, values)) + "]::DOUBLE[]"


def _causal(sos) -> str:
    return f"WITH {_S}, h AS (SELECT {_response(sos)} AS h) SELECT a.user_id, a.t::INT AS t, (round(sum(b.value * coalesce(h[a.t - b.t + 1], 0)), 6) + 0.0::DOUBLE) AS filtered FROM s a JOIN s b ON b.user_id = a.user_id AND b.t <= a.t, h GROUP BY 1, 2"


_TWICE = (
    f"WITH {_S}, h AS (SELECT {_response(LOW)} AS h), n AS (SELECT user_id, t - 1 AS k, value AS v, count(*) OVER (PARTITION BY user_id) AS n FROM s), "
    "e AS (SELECT user_id, arg_min(v, k) AS a, arg_max(v, k) AS b FROM n GROUP BY 1), "
    "x AS (SELECT user_id, k, v FROM n WHERE n > 3 UNION ALL SELECT user_id, -k, 2 * a - v FROM n JOIN e USING (user_id) WHERE n > 3 AND k BETWEEN 1 AND 3 UNION ALL SELECT user_id, 2 * (n - 1) - k, 2 * b - v FROM n JOIN e USING (user_id) WHERE n > 3 AND k BETWEEN n - 4 AND n - 2), "
    f"f AS (SELECT user_id, arg_min(v, k) AS s FROM x GROUP BY 1), y AS (SELECT p.user_id, p.k, sum((q.v - s) * coalesce(h[p.k - q.k + 1], 0)) + any_value(s) * {filters.dc_gain(LOW)!r} AS v FROM x p JOIN x q ON q.user_id = p.user_id AND q.k <= p.k JOIN f ON f.user_id = p.user_id, h GROUP BY 1, 2), "
    f"g AS (SELECT user_id, arg_max(v, k) AS s FROM y GROUP BY 1), z AS (SELECT p.user_id, p.k, sum((q.v - s) * coalesce(h[q.k - p.k + 1], 0)) + any_value(s) * {filters.dc_gain(LOW)!r} AS v FROM y p JOIN y q ON q.user_id = p.user_id AND q.k >= p.k JOIN g ON g.user_id = p.user_id, h GROUP BY 1, 2) "
    "SELECT z.user_id, (z.k + 1)::INT AS t, (round(z.v, 6) + 0.0::DOUBLE) AS filtered FROM z JOIN n ON n.user_id = z.user_id AND n.k = z.k"
)
#: Sums over the frequencies f = j / n of each series; gain is an expression of f.
_DFT = "WITH {s}, n AS (SELECT user_id, t, value AS v, count(*) OVER (PARTITION BY user_id) AS n FROM s), k AS (SELECT DISTINCT user_id, n, unnest(range(n)) AS j FROM (SELECT DISTINCT user_id, n FROM n)), c AS (SELECT k.user_id, k.n, j, least(j, k.n - j) / k.n::DOUBLE AS f, sum(v * cos(2 * pi() * j * (t - 1) / k.n)) AS re, -sum(v * sin(2 * pi() * j * (t - 1) / k.n)) AS im FROM k JOIN n USING (user_id) GROUP BY 1, 2, 3)"


def _gained(gain: str) -> str:
    head = _DFT.format(s=_S)
    return f"{head}, g AS (SELECT *, {gain} AS g FROM c) SELECT n.user_id, n.t::INT AS t, (round(sum(g * (re * cos(2 * pi() * j * (t - 1) / n.n) - im * sin(2 * pi() * j * (t - 1) / n.n))) / any_value(n.n), 6) + 0.0::DOUBLE) AS filtered FROM n JOIN g ON g.user_id = n.user_id GROUP BY 1, 2"


_BELOW, _ABOVE = "(1 / (1 + pow(f / {}, 4)))", "(pow(f, 4) / (pow(f, 4) + pow({}, 4)))"

_MORLET = "pow(pi(), -0.25) * exp(-0.5 * pow({s} * 2 * pi() * j / n - 6, 2)) * sqrt(2 * pi() * {s})"


def _wavelets(scales: tuple[float, ...]) -> str:
    gains = ", ".join(f"CASE WHEN j > 0 AND 2 * j < n THEN {_MORLET.format(s=s)} ELSE 0 END AS g{i}" for i, s in enumerate(scales))
    angle = "2 * pi() * j * (t - 1) / n.n"
    sums = ", ".join(f"round(sum(g{i} * (re * cos({angle}) - im * sin({angle}))) / any_value(n.n), 5) + 0.0::DOUBLE AS re{i}, round(sum(g{i} * (re * sin({angle}) + im * cos({angle}))) / any_value(n.n), 5) + 0.0::DOUBLE AS im{i}" for i, _ in enumerate(scales))
    return f"{_DFT.format(s=_S)}, g AS (SELECT *, {gains} FROM c) SELECT n.user_id, n.t::INT AS t, {sums} FROM n JOIN g ON g.user_id = n.user_id GROUP BY 1, 2"


ORACLE_SQL = {
    "cwt": _wavelets((5.0, 9.0)),
    "iir_one_pole": f"WITH {_S} SELECT a.user_id, a.t::INT AS t, (round(sum(b.value * {1 - DECAY!r} * pow({DECAY!r}::DOUBLE, a.t - b.t)), 6) + 0.0::DOUBLE) AS filtered FROM s a JOIN s b ON b.user_id = a.user_id AND b.t <= a.t GROUP BY 1, 2",
    "sosfilt_lowpass": _causal(LOW), "sosfilt_bandpass": _causal(BAND), "sosfilt_bandstop": _causal(STOP), "sosfilt_highpass": _causal(HIGH), "sosfiltfilt": _TWICE,
    "lowpass": _gained(_BELOW.format(0.2)), "highpass": _gained(_ABOVE.format(0.1)), "bandpass": _gained(f"{_BELOW.format(0.3)} * {_ABOVE.format(0.1)}"),
    "bandstop": _gained(f"1 - {_BELOW.format(0.3)} * {_ABOVE.format(0.1)}"), "product_filter": _gained(f"sqrt({_BELOW.format(0.2)})"),
    "analytic_signal": _DFT.format(s=_S) + ", g AS (SELECT *, CASE WHEN j = 0 OR 2 * j = n THEN 1 WHEN 2 * j < n THEN 2 ELSE 0 END AS g FROM c), z AS (SELECT n.user_id, n.t::INT AS t, sum(g * (re * cos(2 * pi() * j * (t - 1) / n.n) - im * sin(2 * pi() * j * (t - 1) / n.n))) / any_value(n.n) AS re, sum(g * (re * sin(2 * pi() * j * (t - 1) / n.n) + im * cos(2 * pi() * j * (t - 1) / n.n))) / any_value(n.n) AS im FROM n JOIN g ON g.user_id = n.user_id GROUP BY 1, 2) SELECT user_id, t, (round(re, 6) + 0.0::DOUBLE) AS re, (round(im, 6) + 0.0::DOUBLE) AS im, round(sqrt(re * re + im * im), 6) AS envelope FROM z",
    "selective_scan": f"WITH {_S}, r AS (SELECT user_id, t, value / 100 AS x0, 1 / (1 + t::DOUBLE) AS x1, 0.1 + 0.05 * (t % 3)::DOUBLE AS d0, 0.2::DOUBLE AS d1, value / 200 AS b1, value / 300 AS c1 FROM s), p AS (SELECT *, sum(d0) OVER w AS s0, sum(d1) OVER w AS s1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT a.user_id, a.t::INT AS t, round(sum(b.d0 * b.x0 * (0.7 * exp(-0.5 * (a.s0 - b.s0)) + b.b1 * a.c1 * exp(-0.1 * (a.s0 - b.s0)))) + 0.1 * any_value(a.x0), 6) + 0.0::DOUBLE AS y0, round(sum(b.d1 * b.x1 * (0.7 * exp(-1.0 * (a.s1 - b.s1)) + b.b1 * a.c1 * exp(-0.3 * (a.s1 - b.s1)))) - 0.2 * any_value(a.x1), 6) + 0.0::DOUBLE AS y1 FROM p a JOIN p b ON b.user_id = a.user_id AND b.t <= a.t GROUP BY 1, 2",
    "sample_windows": f"WITH {_S}, n AS (SELECT *, t - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s), w AS (SELECT *, ('0x' || substr(md5('11:' || user_id || ':' || w), 1, 8))::BIGINT % (n - 2) AS start FROM n, range(2) r(w) WHERE n >= 3) SELECT user_id, w::INT AS \"window\", k - start AS place, event_id FROM w WHERE k >= start AND k < start + 3",
}
