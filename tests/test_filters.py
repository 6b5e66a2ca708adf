"""Filter design, the block scan against a plain recursion, and window filters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import design, filters
from tests_support import recursion, values

from test_signals import SCHEMA, table

FS = 1000.0


def test_highpass_response():
    s = design.highpass(20.0, FS)
    db = lambda f: 20 * math.log10(abs(design.response(s, f, FS)))
    assert abs(db(20) + 3.0103) < 1e-3 and abs(db(100)) < 0.01 and abs(design.response(s, 0, FS)) < 1e-12


@pytest.mark.parametrize("q", [10.0, 30.0, 50.0])
def test_notch_response(q):
    s = design.notch(50.0, FS, q)
    assert abs(design.response(s, 50, FS)) < 1e-5 and abs(20 * math.log10(abs(design.response(s, 10, FS)))) < 0.01


def test_order_only_counts_in_a_cascade():
    assert design.lowpass(100, FS, 6) == design.lowpass(100, FS, 2)
    four = design.lowpass(100, FS, 4, cascade=True)
    assert len(four) == 2 and abs(20 * math.log10(abs(design.response(four, 100, FS))) + 3.0103) < 1e-3
    assert abs(design.response(four, 300, FS)) < abs(design.response(design.lowpass(100, FS), 300, FS))


@pytest.mark.parametrize("make", [lambda: design.lowpass(500, FS), lambda: design.highpass(600, FS), lambda: design.lowpass(None, FS), lambda: design.bandpass(300, 20, FS), lambda: design.lowpass(9, FS, 3, True)])
def test_designs_that_cannot_be(make):
    with pytest.raises(design.DesignError):
        make()


@pytest.mark.parametrize("n", [1, 255, 256, 257, 3000])
def test_block_scan_equals_recursion(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(50, 20, n)
    sections = design.highpass(10, FS) + design.notch(50, FS, 50.0) + design.lowpass(450, FS)
    got = values(filters.recursive(table(spark, x), sections, FS))
    assert np.abs(np.array(got) - recursion(sections, x)).max() < 1e-9


def test_two_levels_of_folding(spark, monkeypatch):
    monkeypatch.setattr(filters, "GROUP", 3)
    x = np.random.default_rng(1).normal(0, 1, 256 * 11 + 17)
    sections = design.notch(50, FS, 50.0)
    assert np.abs(np.array(values(filters.recursive(table(spark, x), sections, FS))) - recursion(sections, x)).max() < 1e-9


def test_channels_are_independent_and_linear(spark):
    a, b = np.sin(np.arange(600) * 0.01), np.cos(np.arange(600) * 0.3)
    s = design.highpass(20, FS)
    both = filters.recursive(table(spark, a).union(table(spark, b, channel=1)), s, FS)
    one = values(both.where("channel = 0"))
    assert np.allclose(one, values(filters.recursive(table(spark, a), s, FS)), rtol=0, atol=1e-12)
    total = values(filters.recursive(table(spark, 2 * a + 3 * b), s, FS))
    assert np.allclose(total, 2 * np.array(one) + 3 * np.array(values(both.where("channel = 1"))), atol=1e-9)


def test_partitions_do_not_matter(spark):
    s = table(spark, np.random.default_rng(2).normal(0, 1, 2000))
    a, b = (values(filters.recursive(x, design.notch(50, FS), FS)) for x in (s.repartition(13), s.coalesce(1)))
    assert np.allclose(a, b, rtol=0, atol=1e-12)  # but for the last bits of matrix products


def test_nulls_count_as_zero_and_other_columns_stay(spark):
    s = spark.createDataFrame([("s", 0, 0, 0.0, 1.0, "a"), ("s", 0, 1, 0.001, None, "b")], SCHEMA + ", note string")
    got = filters.recursive(s, design.highpass(20, FS), FS).orderBy("idx").collect()
    assert [r.note for r in got] == ["a", "b"] and got[1].x is not None and [r.t for r in got] == [0.0, 0.001]
    assert filters.recursive(spark.createDataFrame([], SCHEMA), design.highpass(20, FS), FS).count() == 0


def same(got, want):
    return len(got) == len(want) and np.allclose(np.array(got, float), np.array(want, float), rtol=0, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("at,value", [(200, math.nan), (10, math.inf), (255, -math.inf), (256, math.nan), (254, math.inf), (700, math.inf)])
@pytest.mark.parametrize("group", [2, 4096])
def test_a_sample_that_is_no_number_spoils_nothing_before_it(spark, monkeypatch, at, value, group):
    monkeypatch.setattr(filters, "GROUP", group)
    x = np.random.default_rng(at).normal(50, 20, 1100)
    x[at] = value
    sections = design.highpass(20, FS) + design.notch(50, FS, 10.0)
    with np.errstate(invalid="ignore"):
        want = recursion(sections, x)
    got = values(filters.recursive(table(spark, x), sections, FS))
    assert same(got, want) and np.isfinite(got[:at]).all() and np.isnan(got[-1])


@pytest.mark.parametrize("group", [3, 4096])
def test_gaps_and_a_late_start(spark, monkeypatch, group):
    monkeypatch.setattr(filters, "GROUP", group)
    rng = np.random.default_rng(5)
    idx = np.sort(rng.choice(6000, 1500, replace=False)) + 1000
    x = rng.normal(0, 1, 1500)
    sections = design.notch(50, FS, 50.0) + design.lowpass(100, FS)
    s = spark.createDataFrame([("s", 0, int(i), float(i / FS), float(v), {"k": int(i)}, "n") for i, v in zip(idx, x)], SCHEMA + ", `my map` map<string,int>, `odd.name` string").repartition(5)
    got = filters.recursive(s, sections, FS).orderBy("idx").collect()
    assert [r.idx for r in got] == idx.tolist() and same([r.x for r in got], recursion(sections, x))
    assert all(r["my map"]["k"] == r.idx and abs(r.t - r.idx / FS) < 1e-9 and r["odd.name"] == "n" for r in got)
    mean = {r.idx: r.x for r in filters.moving_average(s, 4).collect()}
    assert all(abs(mean[i] - x[(idx > i - 4) & (idx <= i)].mean()) < 1e-12 for i in idx)


def test_moving_average_of_a_constant_and_its_start(spark):
    assert values(filters.moving_average(table(spark, [1.0] * 100), 10)) == [1.0] * 100
    assert values(filters.moving_average(table(spark, [1, 2, 3, 4]), 3)) == [1.0, 1.5, 2.0, 3.0]
    with pytest.raises(ValueError):
        filters.moving_average(table(spark, [1.0]), 0)


def test_windows_look_across_blocks(spark):
    from sparkwave.operators.blocks import in_block, rolling

    s = table(spark, range(100))
    got = rolling(s, 4, {"y": F.avg("x").over(in_block().rowsBetween(-4, 0))}, length=7).orderBy("idx").collect()
    assert [r.y for r in got] == [sum(range(max(0, i - 4), i + 1)) / min(5, i + 1) for i in range(100)]


def test_median(spark):
    assert values(filters.median_filter(table(spark, [5, 1, 9, 3, 2, 8]), 3)) == [5.0, 3.0, 5.0, 3.0, 3.0, 3.0]
