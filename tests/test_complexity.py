"""Entropies of templates and Lempel-Ziv parsing against their definitions."""

import math

import numpy as np
import pytest

from sparkwave.functions import complexity
from sparkwave.operators import features
from test_signals import SCHEMA, table


def near(x, m, i, j, r):
    return max(abs(x[i + k] - x[j + k]) for k in range(m)) <= r


def sample_entropy(x, m=2):
    r, n = 0.2 * np.std(x), len(x) - m
    a, b = (sum(near(x, k, i, j, r) for i in range(n) for j in range(i + 1, n)) for k in (m + 1, m))
    return -math.log(a / b) if a and b else math.nan


def approximate_entropy(x, m=2):
    r = 0.2 * np.std(x)
    phi = [np.mean([math.log(sum(near(x, k, i, j, r) for j in range(len(x) - k + 1)) / (len(x) - k + 1)) for i in range(len(x) - k + 1)]) for k in (m, m + 1)]
    return phi[0] - phi[1]


def phrases(s):
    count, at = 0, 0
    while at < len(s):
        n = 1
        while at + n <= len(s) and s[at : at + n] in s[: at + n - 1]:
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize("n", [4, 5, 33, 64, 130])
def test_entropies_equal_all_pairs(n):
    rng = np.random.default_rng(n)
    x = np.stack([rng.normal(0, 1, n), np.round(rng.normal(0, 1, n), 1), np.sin(np.arange(n) * 0.3), np.full(n, 2.0), rng.integers(0, 3, n).astype(float), 1e9 * rng.random(n)])
    assert np.allclose(complexity.sample_entropy(x), [sample_entropy(v) for v in x], atol=1e-12, equal_nan=True)
    assert np.allclose(complexity.approximate_entropy(x), [approximate_entropy(v) for v in x], atol=1e-12)


def test_pairs_in_pieces(monkeypatch):
    x = np.random.default_rng(1).normal(0, 1, (3, 100))
    whole = complexity.approximate_entropy(x)
    monkeypatch.setattr(complexity, "PAIRS", 50)
    assert np.allclose(complexity.approximate_entropy(x), whole)


def test_parsing_equals_plain_search():
    rng = np.random.default_rng(2)
    for n in range(1, 120):
        for p in (0.5, 0.1):
            bits = (rng.random(n) < p).astype(int).tolist()
            assert complexity.phrases(bits) == phrases("".join(map(str, bits))), bits
    assert complexity.phrases([0] * 50) == 2 and complexity.phrases([int(c) for c in "0001101001000101"]) == 6


def test_short_null_and_constant_windows(spark):
    r = features.features(table(spark, [2.0] * 8), 8, enabled=complexity.NAMES).head()
    assert (r.sample_entropy, r.approximate_entropy) == (0.0, 0.0) and r.lempel_ziv == 2 * 3 / 8
    r = features.features(table(spark, [1.0, 2.0]), 2, enabled=complexity.NAMES).head()
    assert (r.sample_entropy, r.approximate_entropy, r.lempel_ziv) == (None, None, 1.0)
    s = spark.createDataFrame([("s", 0, i, i / 1000, None if i == 3 else float(i)) for i in range(8)], SCHEMA)
    r = features.features(s, 8, enabled=[*complexity.NAMES, "mean", "entropy", "total_power"]).head()
    assert (r.sample_entropy, r.lempel_ziv, r.total_power) == (None, None, None) and r["mean"] is not None and r.entropy > 0
