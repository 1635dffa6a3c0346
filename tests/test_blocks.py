"""Block convolutions against the transform of the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import blocks

SCHEMA = "s string, t long, v double"


def whole(x, gains):
    f = np.fft.fft(x)
    return np.stack([np.fft.ifft(f * g(2 * np.pi * np.fft.fftfreq(len(x)))) for g in gains], axis=1)


@pytest.mark.parametrize("kind,scales", [("morlet", [5.0, 9.0, 40.0]), ("ricker", [3.0, 8.0, 30.0])])
def test_wavelets_across_block_ends(spark, monkeypatch, kind, scales):
    monkeypatch.setattr(blocks, "BLOCK", 500)
    rng = np.random.default_rng(0)
    series = {"long": rng.normal(size=20_011), "short": rng.normal(size=700), "one": np.array([2.0]), None: rng.normal(size=5000)}
    table = spark.createDataFrame([(k, 10 + i, float(v)) for k, x in series.items() for i, v in enumerate(x)], SCHEMA).repartition(4)
    gains = [blocks.wavelet(kind, s) for s in scales]
    length, reach = max(500, 2 * blocks.halo(gains)), blocks.halo(gains)
    assert length + 2 * reach < 5000  # the long series are cut
    got = blocks.cwt(table, "s", "t", "v", scales, kind).toPandas()
    assert len(got) == sum(map(len, series.values()))
    for name, x in series.items():
        mine = got[got["series"].isna()] if name is None else got[got["series"] == name]
        mine = mine.sort_values("t")
        z = np.stack(mine["re"]) + 1j * np.stack(mine["im"])
        assert mine["t"].tolist() == list(range(10, 10 + len(x))) and np.allclose(z, whole(x, gains), atol=1e-6)


def test_wavelet_is_the_direct_convolution(spark, monkeypatch):
    """With the Morlet wavelet in time, over the ends of blocks."""
    monkeypatch.setattr(blocks, "BLOCK", 300)
    x = np.sin(np.arange(3000) / 7.0) + (np.arange(3000) == 1234)
    got = blocks.cwt(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], SCHEMA), "s", "t", "v", [8.0]).toPandas().sort_values("t")
    m = np.arange(-200, 201) / 8.0
    psi = np.pi**-0.25 * np.exp(6j * m - m * m / 2) / np.sqrt(8.0)
    direct = np.array([(np.take(x, np.arange(b - 200, b + 201), mode="wrap") * np.conj(psi)).sum() for b in range(0, 3000, 97)])
    z = (np.stack(got["re"])[:, 0] + 1j * np.stack(got["im"])[:, 0])[::97]
    assert np.allclose(z, direct, atol=1e-6)


@pytest.mark.parametrize("lo,hi,stop,once", [(None, 0.2, False, False), (0.1, None, False, False), (0.05, 0.3, False, False), (0.05, 0.3, True, False), (None, 0.2, False, True)])
def test_filters_of_long_series(spark, monkeypatch, lo, hi, stop, once):
    monkeypatch.setattr(blocks, "BLOCK", 1000)
    x = np.random.default_rng(1).normal(size=200_000)
    gain = blocks.flat_gain(lo, hi, 1.0, 2, stop, once)
    got = blocks.convolved(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], SCHEMA), "s", "t", "v", [gain]).toPandas().sort_values("t")
    assert np.allclose(np.stack(got["re"])[:, 0], whole(x, [gain])[:, 0].real, atol=1e-6)


def test_odd_series(spark):
    gain = [blocks.flat_gain(None, 0.2)]
    assert blocks.convolved(spark.createDataFrame([], SCHEMA), "s", "t", "v", gain).count() == 0
    nulls = blocks.convolved(spark.createDataFrame([("a", 0, 1.0), ("a", 1, None)], SCHEMA), "s", "t", "v", gain).toPandas().sort_values("t")
    assert np.allclose(np.stack(nulls["re"])[:, 0], whole(np.array([1.0, 0.0]), gain)[:, 0].real)
    with pytest.raises(Exception, match="consecutive"):
        blocks.convolved(spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], SCHEMA), "s", "t", "v", gain).collect()
    with pytest.raises(ValueError, match="fade"):
        blocks.halo([lambda w: (w > 0.5).astype(float)])
