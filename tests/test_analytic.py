"""The analytic signal: a chirp, blocks of any length, gaps and samples that are no numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import analytic
from test_signals import SCHEMA, table


@pytest.mark.parametrize("n, half", [(1, 1), (100, 3), (4096, 32), (10_000, 32), (300, 500)])
def test_overlap_save_is_the_convolution(n, half):
    x, taps = np.random.default_rng(n).normal(0, 1, n), analytic.hilbert_taps(half)
    assert np.allclose(analytic.overlap_save(x, taps, 64), np.convolve(x, taps)[half : half + n], atol=1e-12)


def test_a_chirp_within_one_percent(spark):
    t = np.arange(4000) / 1000
    x = 3 * np.sin(2 * np.pi * (60 * t + 20 * t * t))  # 60 to 220 Hz
    got = analytic.instantaneous(table(spark, x), 1000.0).orderBy("idx").collect()
    true = 60 + 40 * (t - 0.0005)
    assert all(abs(r.frequency / f - 1) < 0.01 and abs(r.amplitude - 3) < 0.05 for r, f in list(zip(got, true))[100:-100])
    assert got[0].frequency is None and got[0].amplitude is not None


def test_block_lengths_gaps_and_odd_samples(spark):
    rng = np.random.default_rng(5)
    idx = np.flatnonzero(rng.random(700) < 0.95) + 5
    rows = [("s", 0, int(i), int(i) / 1000, float("nan") if i == 300 else None if i == 401 else float(rng.normal(50, 9))) for i in idx]
    s = spark.createDataFrame(rows, SCHEMA).withColumn("amplitude", F.lit("old"))
    whole = analytic.instantaneous(s, 1000.0, half=8).orderBy("idx").collect()
    for length in (20, 64, 701):
        got = analytic.instantaneous(s, 1000.0, half=8, length=length).orderBy("idx").collect()
        for a, b in zip(whole, got, strict=True):
            assert a.idx == b.idx and all((u is None) == (v is None) and (u is None or abs(u - v) < 1e-7) for u, v in ((a.amplitude, b.amplitude), (a.frequency, b.frequency)))
    held = set(idx.tolist())
    for r in whole:
        near = any(abs(r.idx - b) <= 8 for b in (300, 401) if b in held)
        assert (r.amplitude is None) == near and (r.frequency is None) >= (near or r.idx - 1 not in held)
    assert analytic.instantaneous(s.limit(0), 1000.0).count() == 0
