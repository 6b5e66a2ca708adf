"""A linear-chain conditional random field over two labels: training, and Viterbi decoding.

An item is a line, described by a set of binary features (a bitmask); label 1 is content, 0 is boilerplate. The score
of a labelling is the sum of the features' weights under each line's label and of a weight for each pair of
neighbouring labels.
"""

from __future__ import annotations

import numpy as np


class Chain:
    """weights: (features, 2); moves: (2, 2), from label to label."""

    def __init__(self, weights, moves):
        self.weights, self.moves = np.asarray(weights, float), np.asarray(moves, float)

    def scores(self, masks: np.ndarray) -> np.ndarray:
        """(lines, 2): each label's score from the features alone."""
        on = (np.asarray(masks, np.int64)[:, None] >> np.arange(len(self.weights)) & 1).astype(float)
        return on @ self.weights

    def viterbi(self, masks) -> list[int]:
        """The best labelling; ties go to content (1)."""
        if len(masks) == 0:
            return []
        s = self.scores(masks).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            f0, f1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((f0, f1))
            a, b = (b + m10 if f0 else a + m00) + x, (b + m11 if f1 else a + m01) + y
        label = b >= a
        out = [int(label)]
        for f in reversed(back):
            label = f[label]
            out.append(int(label))
        return out[::-1]


def filled(rows: list) -> np.ndarray:
    """(steps, sequences): sequences side by side, filled up with zeros."""
    out = np.zeros((max(map(len, rows), default=0), len(rows)), np.int64)
    for r, row in enumerate(rows):
        out[: len(row), r] = row
    return out


def label_within(chain: Chain, masks: list, words: list, least: np.ndarray, most: np.ndarray, rounds: int = 12, strongest: float = 16.0) -> list[np.ndarray]:
    """The best labelling of each sequence whose share of words in content lies between ``least`` and ``most``.

    A sequence out of bounds gets one bias for content on all of its lines (the multiplier of the bound): the smallest
    one, by bisection, that brings it in.
    """
    n, size = np.array([len(m) for m in masks]), filled(words)
    total = np.maximum(size.sum(axis=0), 1)
    scores = chain.scores(filled(masks).ravel()).reshape(*size.shape, 2)
    steps, at = np.arange(len(size))[:, None], np.arange(len(n))

    def decode(bias: np.ndarray) -> np.ndarray:
        best, back = scores[0] + np.stack([np.zeros(len(n)), bias], axis=1), np.zeros(size.shape + (2,), bool)
        for t in range(1, len(size)):
            step = best[:, :, None] + chain.moves
            back[t] = step[:, 1] >= step[:, 0]
            now = np.maximum(step[:, 0], step[:, 1]) + scores[t]
            now[:, 1] += bias
            best = np.where((t < n)[:, None], now, best)
        label = np.zeros(size.shape, np.int64)
        y = (best[:, 1] >= best[:, 0]).astype(int)
        for t in range(len(size) - 1, -1, -1):
            label[t] = np.where(t < n, y, 0)
            y = np.where((0 < t) & (t < n), back[t, at, y], y)
        return label

    share = lambda label: (label * size).sum(axis=0) / total
    free = decode(np.zeros(len(n)))
    way = np.where(share(free) < least, 1.0, np.where(share(free) > most, -1.0, 0.0))
    low, high = np.zeros(len(n)), np.full(len(n), strongest)
    for _ in range(rounds):
        middle = (low + high) / 2
        s = share(decode(way * middle))
        inside = np.where(way > 0, s >= least, s <= most)
        low, high = np.where(inside, low, middle), np.where(inside, middle, high)
    out = np.where(way != 0, decode(way * high), free)
    return [out[:k, i] for i, k in enumerate(n)]


def train(
    prior: Chain,
    masks: list[np.ndarray],
    labels: list[np.ndarray],
    rounds: int = 150,
    pull: float = 1.0,
    step: float = 0.1,
    pull_moves: float | None = None,
    start: Chain | None = None
) -> Chain:
    """Maximum a posteriori weights: the sequences' log likelihood, with a Gaussian pull towards ``prior``.

    ``pull_moves`` is the pull of the label pairs' weights, ``start`` where the ascent begins. Full-batch gradient ascent
    (Adam), deterministic. Without sequences the prior comes back.
    """
    kept = [i for i in range(len(masks)) if len(masks[i])]
    if not kept:
        return prior
    n, longest, k = len(kept), max(len(masks[i]) for i in kept), len(prior.weights)
    # Time comes first: (steps, sequences).
    held, gold, real = np.zeros((longest, n), np.int64), np.zeros((longest, n), int), np.zeros((longest, n, 1), bool)
    for r, i in enumerate(kept):
        held[: len(masks[i]), r] = masks[i]
        gold[: len(masks[i]), r], real[: len(masks[i]), r] = labels[i], True
    # Lines share few masks: scores and slopes are those of masks.
    different, place = np.unique(held, return_inverse=True)
    place = place.reshape(longest, n)
    on = (different[:, None] >> np.arange(k) & 1).astype(float)
    of_mask = lambda v: on.T @ np.stack([np.bincount(place.ravel(), v[..., y].ravel(), len(different)) for y in (0, 1)], axis=1)
    one = np.eye(2)[gold] * real
    seen_w, seen_m = of_mask(one), one[:-1].reshape(-1, 2).T @ one[1:].reshape(-1, 2)
    flat = lambda c: np.concatenate([c.weights.ravel(), c.moves.ravel()])
    centre, theta = flat(prior), flat(start or prior)
    hold, m1, m2 = np.full_like(centre, pull), np.zeros_like(centre), np.zeros_like(centre)
    hold[2 * k :] = pull if pull_moves is None else pull_moves
    for t in range(1, rounds + 1):
        w, moves = theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2)
        s = (on @ w)[place]
        step_e, step_m = np.exp(s - s.max(axis=2, keepdims=True)), np.exp(moves)
        ahead, behind, scale = np.empty((longest, n, 2)), np.ones((longest, n, 2)), np.ones((longest, n, 1))
        for j in range(longest):  # each step's probabilities sum to 1; after a sequence's end they stay
            now = step_e[0] if j == 0 else (ahead[j - 1] @ step_m) * step_e[j]
            scale[j] = now[:, :1] + now[:, 1:]
            ahead[j] = now / scale[j] if j == 0 else np.where(real[j], now / scale[j], ahead[j - 1])
        after = np.zeros((longest, n, 2))
        for j in range(longest - 2, -1, -1):
            after[j] = step_e[j + 1] * behind[j + 1] / scale[j + 1]
            behind[j] = np.where(real[j + 1], after[j] @ step_m.T, behind[j + 1])
        edge = step_m * (ahead[:-1].reshape(-1, 2).T @ (after[:-1] * real[1:]).reshape(-1, 2))
        slope = np.concatenate([(seen_w - of_mask(ahead * behind * real)).ravel(), (seen_m - edge).ravel()]) - hold * (theta - centre)
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        theta = theta + step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Chain(theta[: 2 * k].reshape(k, 2), theta[2 * k :].reshape(2, 2))
