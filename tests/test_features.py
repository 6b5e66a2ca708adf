"""Windows and features: fixture values, window arithmetic, degenerate windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.functions import spectrum
from sparkwave.operators import features, windows

from test_signals import SCHEMA, table


def close(row, expected, tol=2e-6):
    for k, v in expected.items():
        assert abs(row[k] - v) < tol, (k, row[k], v)


def test_sine_of_0_1(spark):
    s = table(spark, [math.sin(0.1 * i) for i in range(256)])
    r = features.features(s, 256).collect()[0]
    close(r, {
        "mean": 0.003304, "rms": 0.701267, "mav": 0.628337, "zero_crossings": 8, "waveform_length": 16.352221, "slope_sign_changes": 8, "variance": 0.491764, "peak_to_peak": 1.999783,
        "skewness": -0.013346, "kurtosis": -1.477163, "entropy": 4.062971, "energy": 125.894477, "total_power": 16114.824856, "peak_frequency": 15.625, "spectral_centroid": 15.919934,
        "spectral_spread": 6.940301, "mean_frequency": 15.920641, "median_frequency": 15.625, "spectral_entropy": 0.194754,
    })
    half = features.features(s, 128).orderBy("k").collect()
    assert [r.start_sample for r in half] == [0, 64, 128]
    close(half[0], {"mean": 0.001216, "rms": 0.700730, "zero_crossings": 4, "waveform_length": 8.130089, "slope_sign_changes": 4, "total_power": 4022.460144, "peak_frequency": 15.625, "spectral_centroid": 15.773965, "mean_frequency": 15.774060})


def test_two_tones(spark):
    s = table(spark, [math.sin(2 * math.pi * 10 * i / 256) + 0.5 * math.sin(2 * math.pi * 50 * i / 256) for i in range(256)], rate=256.0)
    r = features.features(s, 256, rate=256.0).collect()[0]
    close(r, {"rms": 0.790569, "variance": 0.625, "total_power": 20480, "peak_frequency": 10, "spectral_centroid": 18, "spectral_spread": 16, "mean_frequency": 18, "median_frequency": 10, "spectral_entropy": 0.721928}, 1e-5)
    assert r.band_powers["High"] == 0.0  # the band begins above half the sampling rate


def test_one_to_five(spark):
    r = features.features(table(spark, [1, 2, 3, 4, 5]), 5).collect()[0]
    close(r, {"mean": 3, "rms": 3.316625, "mav": 3, "waveform_length": 4, "slope_sign_changes": 0, "variance": 2, "peak_to_peak": 4, "skewness": 0, "kurtosis": -1.3, "entropy": math.log2(5), "energy": 55, "power": 11})
    assert spectrum.padded(5) == 8


def test_constant_and_short_windows(spark):
    r = features.features(table(spark, [0.0] * 8), 8).collect()[0]
    assert r.total_power == 0 and r.band_powers == {} and r.entropy == r.skewness == r.kurtosis == 0 and r.zero_crossings == 0
    r = features.features(table(spark, [2.0]), 1).collect()[0]
    assert (r["mean"], r.waveform_length, r.energy, r.power, r.entropy, r.total_power) == (2.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_null_samples_leave_spectra_null(spark):
    s = spark.createDataFrame([("s", 0, i, i / 1000, None if i == 3 else float(i)) for i in range(8)], SCHEMA)
    r = features.features(s, 8).collect()[0]
    assert r.window_size == 8 and r.total_power is None and r.band_powers is None and r["mean"] == sum(i for i in range(8) if i != 3) / 7
    assert features.features(spark.createDataFrame([], SCHEMA), 8).count() == 0


@pytest.mark.parametrize("size,overlap,hop", [(1024, 0.5, 512), (512, 0.5, 256), (256, 0.5, 128), (512, 0.75, 128), (128, 0.5, 64), (10, -1.0, 10), (3, 0.99, 1)])
def test_hops(size, overlap, hop):
    assert windows.hop_of(size, overlap) == hop


def test_windows_that_cannot_be():
    for size, overlap in [(0, 0.5), (4, 1.0)]:
        with pytest.raises(ValueError):
            windows.hop_of(size, overlap)


@pytest.mark.parametrize("n,size,overlap", [(100, 8, 0.5), (100, 8, 0.9), (7, 8, 0.5), (1000, 3, 0.0), (9, 4, 0.7)])
def test_windows_hold_their_samples(spark, monkeypatch, n, size, overlap):
    monkeypatch.setattr(windows, "RUN", 5)
    hop = windows.hop_of(size, overlap)
    got = windows.sliding(table(spark, range(n)), size, overlap).orderBy("k").collect()
    assert [(r.k, r.x) for r in got] == [(k, [float(v) for v in range(k * hop, k * hop + size)]) for k in range(max(0, (n - size) // hop + 1))]


def test_lags_stay_right_at_run_borders(spark, monkeypatch):
    x = np.random.default_rng(0).normal(0, 1, 300)
    whole = features.features(table(spark, x), 16, enabled=features.TIME).orderBy("k").collect()
    monkeypatch.setattr(windows, "RUN", 3)
    assert features.features(table(spark, x), 16, enabled=features.TIME).orderBy("k").collect() == whole


def test_only_what_is_asked_for_is_computed(spark):
    s = table(spark, range(64))
    out = features.features(s, 16, enabled=["rms"])
    assert out.columns[-1] == "rms" and "Python" not in out._jdf.queryExecution().toString() and "collect_list" not in out._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        features.features(s, 16, enabled=["loudness"])


def test_one_shuffle_of_the_samples(spark):
    plan = features.features(table(spark, range(64)), 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_parseval():
    x = np.random.default_rng(3).normal(0, 1, (5, 64))
    full = np.abs(np.fft.fft(x, axis=1)) ** 2
    assert np.allclose(full.sum(axis=1), 64 * (x**2).sum(axis=1)) and np.allclose(spectrum.power(x), full[:, :32])


def test_ready_windows_of_mixed_lengths(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0, -1.0] * 4), (3, [1.0, float("nan"), 1.0, 1.0])], "k long, x array<double>")
    got = {r.k: r for r in features.window_spectra(rows, 1000.0).collect()}
    assert got[0].total_power == 0 and got[1].total_power is None and got[3].total_power is None
    p = spectrum.power_spectrum(rows).where(F.col("k") == 2).head().p
    assert len(p) == 4
