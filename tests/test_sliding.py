"""Means and medians of windows of any size against plain loops, with nulls, NaN, infinities, ties and gaps."""

import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import filters, sliding
from test_signals import SCHEMA, table


def odd(n, seed, special=True):
    rng = np.random.default_rng(seed)
    idx = np.cumsum(rng.choice([1, 1, 1, 2, 40], n)) + 17
    x = rng.integers(0, 9, n) / 2.0 if seed % 2 else rng.normal(50, 20, n)
    real = rng.random(n) > 0.1
    if special:
        x[rng.integers(0, n, 3)] = np.nan
        x[rng.integers(0, n, 2)] = np.inf
        x[rng.integers(0, n, 2)] = -np.inf
    return idx, np.where(real, x, np.nan), real


def plain(idx, x, real, size, of):
    out = []
    for i in range(len(idx)):
        held = [v for j, v, r in zip(idx, x, real) if r and idx[i] - size < j <= idx[i]]
        out.append(of(held) if held else None)
    return out


def mean(held):
    return sum(held) / len(held)


def median(held):
    held = sorted(held, key=lambda v: (np.isnan(v), v))
    return (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2


def same(found, want):
    values, some = found
    assert [w is not None for w in want] == some.tolist()
    for v, w in zip(values, want):
        assert w is None or np.isnan(w) and np.isnan(v) or v == w or abs(v - w) < 1e-9, (v, w)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 501, 5000])
@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_plain_ones(size, seed):
    given = odd(400, seed)
    with np.errstate(invalid="ignore"):
        same(sliding.means(*given, size), plain(*given, size, mean))
        same(sliding.medians(*given, size), plain(*given, size, median))


@pytest.mark.parametrize("size", [5, 900])
def test_filters_over_several_blocks(spark, size):
    idx, x, real = odd(3000, 4)
    rows = [("s", 0, int(i), int(i) / 1000, float(v) if r else None, f"n{i}") for i, v, r in zip(idx, x, real)]
    s = spark.createDataFrame(rows, SCHEMA + ", `my note` string").repartition(5)
    for apply, of in ((filters.moving_average, sliding.means), (filters.median_filter, sliding.medians)):
        got = apply(s, size).orderBy("idx").collect()
        values, some = of(idx, x, real, size)
        assert [r["my note"] for r in got] == [f"n{i}" for i in idx] and got[0].asDict().keys() == set(s.columns)
        for r, v, there in zip(got, values, some):
            assert (r.x is not None) == there and (not there or np.isnan(v) and np.isnan(r.x) or v == r.x or abs(v - r.x) < 1e-9)
        assert apply(s.limit(0), size).count() == 0
        assert {r.x for r in apply(s.withColumn("x", F.lit(None).cast("double")), size).collect()} == {None}
    with pytest.raises(ValueError):
        filters.moving_average(s, 0)


def test_more_samples_than_a_block(spark):
    x = np.random.default_rng(1).normal(50, 20, 70_000)
    got = {r.idx: r.x for r in filters.moving_average(table(spark, x), 4000).collect()}
    sums = np.append(0, np.cumsum(x.astype(np.longdouble)))
    assert all(abs(got[i] - float((sums[i + 1] - sums[max(0, i - 3999)]) / min(4000, i + 1))) < 1e-9 for i in range(70_000))
    got = {r.idx: r.x for r in filters.median_filter(table(spark, x), 501).collect()}
    assert all(got[i] == statistics.median(x[max(0, i - 500) : i + 1]) for i in range(0, 70_000, 97))


@pytest.mark.parametrize("of, small, large, times", [(sliding.means, 10, 4000, 1.5), (sliding.medians, 5, 501, 3)])
def test_time_does_not_grow_with_the_window(of, small, large, times):
    given = np.arange(200_000), np.random.default_rng(3).normal(0, 1, 200_000), np.ones(200_000, bool)

    def took(size):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            of(*given, size)
            best.append(time.perf_counter() - began)
        return min(best)

    assert took(large) < times * took(small) + 0.02
