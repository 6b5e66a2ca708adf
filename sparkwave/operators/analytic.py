"""Instantaneous amplitude and frequency: the analytic signal of a channel, block by block.

The imaginary part is the signal through a Hilbert transformer, a finite filter that is long on both sides. A block and
its halo go through it by FFT convolution with overlap-save: pieces of ``FFT`` samples, of each of which the first
ones, that the filter's length spoils, are thrown away. The frequency is the turn of the analytic signal from the
sample before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkwave.operators.blocks import BLOCK, by_block

#: Samples of a transform, unless the filter is longer.
FFT = 4096


def hilbert_taps(half: int) -> np.ndarray:
    """2 / (pi k) at odd k from -half to half, under a Hamming window."""
    k = np.arange(-half, half + 1)
    ideal = np.where(k % 2 != 0, 2 / (np.pi * np.where(k == 0, 1, k)), 0.0)
    return ideal * (0.54 + 0.46 * np.cos(np.pi * k / max(1, half)))


def overlap_save(x: np.ndarray, taps: np.ndarray, size: int = FFT) -> np.ndarray:
    """The convolution of x and an odd number of taps, centred: as long as x, which counts as 0 beyond its ends."""
    extra = len(taps) - 1
    size = max(size, 1 << (4 * extra).bit_length())
    step = size - extra
    pieces = max(1, -(-(len(x) + extra // 2) // step))
    line = np.zeros(extra + pieces * step)
    line[extra : extra + len(x)] = x
    held = np.lib.stride_tricks.sliding_window_view(line, size)[::step][:pieces]
    out = np.fft.irfft(np.fft.rfft(held, axis=1) * np.fft.rfft(taps, size), size, axis=1)[:, extra:].ravel()
    return out[extra // 2 : extra // 2 + len(x)]


def analytic(idx: np.ndarray, x: np.ndarray, half: int, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(amplitude, where), (frequency, where) at each row; x isn't a number where a sample is null or not finite."""
    if not len(idx):
        return [(x, x > 0)] * 2
    at = idx - idx[0] + 1  # place 0 is the one before the first
    n, finite = int(at[-1]) + 1, np.isfinite(x)
    line, bad, there = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, bool)
    line[at], bad[at], there[at] = np.where(finite, x, 0.0), ~finite, True
    z = line + 1j * overlap_save(line, hilbert_taps(half))
    spoiled = np.append(0, np.cumsum(bad))
    clean = spoiled[np.minimum(n, np.arange(n) + half + 1)] == spoiled[np.maximum(0, np.arange(n) - half)]
    turn = z[at] * np.conj(z[at - 1])
    return [(np.abs(z[at]), clean[at]), (np.angle(turn) * rate / (2 * np.pi), clean[at] & clean[at - 1] & there[at - 1])]


def instantaneous(samples: DataFrame, rate: float, half: int = 32, length: int = BLOCK) -> DataFrame:
    """``samples`` with amplitude and frequency (Hz) of the analytic signal; earlier columns of these names are replaced.

    The filter reaches ``half`` samples to both sides; frequencies from about rate / half up to rate / 2 less that are
    true. Samples that are missing, by a gap in idx or beyond the ends, count as 0. Where a null, NaN or infinite sample is in reach both
    are null, and so is the frequency where the sample before is missing. Blocks overlap by the filter's reach, so
    results don't depend on ``length``.
    """
    if half < 1:
        raise ValueError("the filter must reach a sample to both sides at least")
    return by_block(samples, half + 1, lambda idx, x, real: analytic(idx, x, half, rate), ["amplitude", "frequency"], length=length, after=half)
