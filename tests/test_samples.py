"""Samples of images by tiles equal sums over taps; points off the image, without a place and crowded in one tile."""

import math

import numpy as np
import pytest

from quern.operators import fields


def plain(cells, px, py, method, cval):
    reach, _, scaled = fields.KERNELS[method]
    a = {"linear": lambda d: max(1 - abs(d), 0), "catmull_rom": lambda d: 1.5 * abs(d) ** 3 - 2.5 * d * d + 1 if abs(d) < 1 else -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 if abs(d) < 2 else 0,
         "lanczos": lambda d: 1 if abs(d) < 1e-9 else np.sinc(d) * np.sinc(d / 3) if abs(d) < 3 else 0}[method]
    taps = [(x, y, a(px - x) * a(py - y)) for x in range(math.floor(px) + 1 - reach, math.floor(px) + reach + 1) for y in range(math.floor(py) + 1 - reach, math.floor(py) + reach + 1)]
    total = sum(w * cells.get((x, y), cval) for x, y, w in taps)
    return total / sum(w for *_, w in taps) if scaled else total


@pytest.mark.parametrize("method", ["linear", "catmull_rom", "lanczos"])
def test_samples_by_tiles(spark, monkeypatch, method):
    monkeypatch.setattr(fields, "TILE", 4)
    monkeypatch.setattr(fields, "POINTS", 5)
    rng = np.random.default_rng(3)
    cells = {(x, y): float(rng.normal()) for x in range(11) for y in range(9) if (x, y) != (4, 4)}
    table = spark.createDataFrame([(n, x, y, v) for n in (0, 1) for (x, y), v in cells.items()], "img int, x long, y long, v double")
    places = [*map(tuple, rng.uniform(-4, 14, (60, 2))), *((5 + u, 6.5) for u in rng.uniform(0, 1, 30)), (3.0, 4.0), (8.0, 7.5)]
    points = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(places)] + [(7, 900, 3.5, 3.5), (0, 901, None, 1.0), (0, 902, float("nan"), 1.0)]
    out = fields.sample(table, spark.createDataFrame(points, "img int, pid int, px double, py double"), method, 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array" not in plan  # no row a tap
    got = {r["pid"]: r["v"] for r in out.collect()}
    assert len(got) == len(points) and got[901] is None and math.isnan(got[902])
    assert got[900] == pytest.approx(plain({}, 3.5, 3.5, method, 0.5))
    assert [got[i] for i in range(len(places))] == pytest.approx([plain(cells, x, y, method, 0.5) for x, y in places], abs=1e-12)
