"""Sliding windows over the samples of one block, in time that doesn't depend on the window's size.

Means: the line is cut into pieces as long as the window; any window is the end of one piece and the start of the next,
whose sums run along each piece once. Nothing is subtracted, so nothing cancels, and NaN and infinities, counted apart,
reach no further than the windows that hold them.

Medians: a wavelet matrix over the samples' ranks. Level by level, from the highest bit of the rank, samples are parted
by that bit in order; how many zeros there are before each place says in which half a window's k-th smallest sample is,
for all windows at once.
"""

from __future__ import annotations

import numpy as np


def means(idx: np.ndarray, x: np.ndarray, real: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the samples with idx from ``idx - size + 1`` on, for each row, and where there is one; null samples are left out."""
    if not len(idx):
        return x, real
    at = idx - idx[0]
    n = -(-int(at[-1] + 1) // size) * size
    finite = np.isfinite(x)
    pieces = np.bincount(at, np.where(finite, x, 0.0), n).reshape(-1, size)
    ahead, behind = np.cumsum(pieces, axis=1).ravel(), np.cumsum(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    first = at - size + 1
    total = ahead[at] + np.where((first > 0) & (first % size != 0), behind[np.maximum(first, 0)], 0.0)

    def count(which: np.ndarray) -> np.ndarray:
        before = np.append(0, np.cumsum(np.bincount(at[which], minlength=n)))
        return before[at + 1] - before[np.maximum(first, 0)]

    held = count(real)
    out = total / np.maximum(held, 1)
    if not finite[real].all():
        nan, high, low = (count(real & which) for which in (np.isnan(x), x == np.inf, x == -np.inf))
        out = np.where((nan > 0) | ((high > 0) & (low > 0)), np.nan, np.where(high > 0, np.inf, np.where(low > 0, -np.inf, out)))
    return out, held > 0


def kth_smallest(ranks: np.ndarray, first: np.ndarray, end: np.ndarray, ks: list[np.ndarray]) -> list[np.ndarray]:
    """For each k of ``ks``: the k-th smallest (from 0) of ranks[first:end], for all windows at once. Ranks are below their number."""
    levels = max(1, (len(ranks) - 1).bit_length())
    state = [(first, end, k, np.zeros_like(k)) for k in ks]
    for level in range(levels - 1, -1, -1):
        ones = (ranks >> level) & 1
        zeros = np.zeros(len(ranks) + 1, np.int64)
        np.cumsum(1 - ones, out=zeros[1:])
        after = []
        for low, high, k, found in state:
            low_0, high_0 = zeros[low], zeros[high]
            there = high_0 - low_0
            up = k >= there
            after.append(
                (np.where(up, zeros[-1] + low - low_0, low_0), np.where(up, zeros[-1] + high - high_0, high_0), np.where(up, k - there, k), found | up.astype(np.int64) << level)
            )
        state = after
        ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])
    return [found for *_, found in state]


def medians(idx: np.ndarray, x: np.ndarray, real: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the samples with idx from ``idx - size + 1`` on, for each row, and where there is one; null samples are left out, NaN is above all others."""
    held, line = x[real], idx[real]
    first, end = np.searchsorted(line, idx - size + 1, side="left"), np.searchsorted(line, idx, side="right")
    some = end > first
    out = np.full(len(idx), np.nan)
    if some.any():
        order = np.argsort(held, kind="stable")
        ranks = np.empty(len(held), np.int64)
        ranks[order] = np.arange(len(held))
        first, end = first[some], end[some]
        lower, upper = kth_smallest(ranks, first, end, [(end - first - 1) // 2, (end - first) // 2])
        with np.errstate(invalid="ignore"):
            out[some] = (held[order[lower]] + held[order[upper]]) / 2
    return out, some
