"""Complexity of windows: sample and approximate entropy, and the Lempel-Ziv parsing of the binarised window.

Entropies count pairs of templates (runs of m samples) whose samples all differ by at most a tolerance. Templates are
put into a grid of cells as wide as the tolerance, over their first two samples, and sorted by cell: those that can match
are in a template's own cell or next to it, which is one stretch of the sorted cells for each row of three. All
windows of a batch are in one grid, and pairs are looked at in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np

NAMES = ["sample_entropy", "approximate_entropy", "lempel_ziv"]
#: Samples of a template, the tolerance as a share of a window's standard deviation, pairs that are looked at at a time.
M, TOLERANCE, PAIRS = 2, 0.2, 1 << 20


def tolerance(x: np.ndarray) -> np.ndarray:
    return TOLERANCE * x.std(axis=1)


def matches(x: np.ndarray, m: int, templates: int, r: np.ndarray) -> np.ndarray:
    """(windows, templates): how many of a window's first ``templates`` runs of m >= 2 samples are within r of each, itself included."""
    n = len(x)
    runs = np.lib.stride_tricks.sliding_window_view(x, m, axis=1)[:, :templates]
    width = np.where(r > 0, r * (1 + 1e-9), 1.0)[:, None]
    low = x.min(axis=1)[:, None]
    cx, cy = (np.floor((runs[:, :, i] - low) / width).astype(np.int64) + 1 for i in (0, 1))
    wide, high = int(cy.max(initial=0)) + 2, int(cx.max(initial=0)) + 2
    row = np.arange(n)[:, None] * high + cx
    cell = (row * wide + cy).ravel()
    order = np.argsort(cell, kind="stable")
    line, flat, limit = cell[order], runs.reshape(-1, m), np.repeat(r, templates)
    count = np.zeros(n * templates, np.int64)
    for step in (-1, 0, 1):
        base = (row + step) * wide + cy
        start, end = np.searchsorted(line, (base - 1).ravel(), "left"), np.searchsorted(line, (base + 1).ravel(), "right")
        sizes = end - start
        heap = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(heap, (heap[at - 1] if at else 0) + PAIRS, "right")))
            own = sizes[at:to]
            one = np.repeat(np.arange(at, to), own)
            two = order[np.repeat(start[at:to] - (np.cumsum(own) - own), own) + np.arange(len(one))]
            close = (np.abs(flat[one] - flat[two]) <= limit[one][:, None]).all(axis=1)
            count += np.bincount(one[close], minlength=len(count))
            at = to
    return count.reshape(n, templates)


def sample_entropy(x: np.ndarray, m: int = M) -> np.ndarray:
    """-ln(A / B): A pairs of runs of m + 1 samples, B of m, among those that can be prolonged; NaN where either has none."""
    templates = x.shape[1] - m
    if templates < 2:
        return np.full(len(x), np.nan)
    r = tolerance(x)
    b, a = (matches(x, k, templates, r).sum(axis=1) - templates for k in (m, m + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), np.log(b / np.where(a > 0, a, 1)) + 0.0, np.nan)


def approximate_entropy(x: np.ndarray, m: int = M) -> np.ndarray:
    """Mean log share of runs of m samples near each run, less that for m + 1; NaN for windows of m + 1 samples or fewer."""
    n = x.shape[1]
    if n < m + 2:
        return np.full(len(x), np.nan)
    r = tolerance(x)
    phi = [np.log(matches(x, k, n - k + 1, r) / (n - k + 1)).mean(axis=1) for k in (m, m + 1)]
    return phi[0] - phi[1]


class SuffixAutomaton:
    """All substrings of the bits so far; one bit more takes constant time on average."""

    def __init__(self):
        self.next: list[list[int]] = [[-1, -1]]
        self.link, self.length, self.last = [-1], [0], 0

    def _state(self, length: int, link: int, moves: list[int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def add(self, bit: int) -> None:
        state = self._state(self.length[self.last] + 1, 0, [-1, -1])
        p = self.last
        while p >= 0 and self.next[p][bit] < 0:
            self.next[p][bit] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][bit]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(self.length[p] + 1, self.link[q], list(self.next[q]))
                while p >= 0 and self.next[p][bit] == q:
                    self.next[p][bit] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            self.link[state] = q
        self.last = state


def phrases(bits) -> int:
    """Phrases of the Lempel-Ziv parsing of 1976: each the shortest run that doesn't occur earlier (overlaps count); the last may be cut off."""
    automaton, count, state, held = SuffixAutomaton(), 0, 0, 0
    for bit in bits:
        to = automaton.next[state][bit]
        if to < 0:
            count, state, held = count + 1, 0, 0
        else:
            state, held = to, held + 1
        automaton.add(bit)
        # A state that was divided: the phrase so far is among the shorter strings.
        while state and held <= automaton.length[automaton.link[state]]:
            state = automaton.link[state]
    return count + (held > 0)


def lempel_ziv(x: np.ndarray) -> np.ndarray:
    """Phrases of each window, as bits for samples above its median, over the n / log2(n) of a random sequence; 0 for a single sample."""
    n = x.shape[1]
    above = x > np.median(x, axis=1)[:, None]
    if n < 2:
        return np.zeros(len(x))
    return np.array([phrases(row) for row in above.astype(int).tolist()]) * np.log2(n) / n


OF = {"sample_entropy": sample_entropy, "approximate_entropy": approximate_entropy, "lempel_ziv": lempel_ziv}
