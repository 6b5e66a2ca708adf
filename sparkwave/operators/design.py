"""Filter coefficients: second-order sections (b0, b1, b2, a1, a2), designed on the driver in double precision."""

from __future__ import annotations

import math

import numpy as np

Section = tuple[float, float, float, float, float]


class DesignError(ValueError):
    """A filter that can't be had at this sampling rate."""


def _warped(cutoff: float | None, rate: float) -> float:
    if cutoff is None:
        raise DesignError("a cutoff frequency is required")
    if not cutoff > 0:
        raise DesignError(f"cutoff {cutoff} Hz must be above 0")
    if cutoff >= rate / 2:
        raise DesignError(f"cutoff {cutoff} Hz must be below half the sampling rate {rate} Hz")
    return math.tan(math.pi * cutoff / rate)


def _damping(order: int, cascade: bool) -> list[float]:
    """1/Q of each section: sqrt(2) for the single section that stands for any order, or a true Butterworth cascade."""
    if not cascade:
        return [math.sqrt(2)]
    if order < 2 or order % 2:
        raise DesignError("a cascade needs an even order of 2 or more")
    return [2 * math.sin(math.pi * (2 * j + 1) / (2 * order)) for j in range(order // 2)]


def lowpass(cutoff: float | None, rate: float, order: int = 2, cascade: bool = False) -> list[Section]:
    k, out = _warped(cutoff, rate), []
    for q in _damping(order, cascade):
        d = k * k + q * k + 1
        out.append((k * k / d, 2 * k * k / d, k * k / d, 2 * (k * k - 1) / d, (k * k - q * k + 1) / d))
    return out


def highpass(cutoff: float | None, rate: float, order: int = 2, cascade: bool = False) -> list[Section]:
    k, out = _warped(cutoff, rate), []
    for q in _damping(order, cascade):
        d = k * k + q * k + 1
        out.append((1 / d, -2 / d, 1 / d, 2 * (k * k - 1) / d, (k * k - q * k + 1) / d))
    return out


def bandpass(low: float, high: float, rate: float, order: int = 2, cascade: bool = False) -> list[Section]:
    """High-pass, then low-pass."""
    if low >= high:
        raise DesignError("the lower cutoff must be below the upper one")
    return highpass(low, rate, order, cascade) + lowpass(high, rate, order, cascade)


def notch(frequency: float, rate: float, q: float = 30.0) -> list[Section]:
    if not (0 < frequency < rate / 2 and q > 0):
        raise DesignError(f"a notch needs a frequency between 0 and half the sampling rate {rate} Hz, and a quality above 0: {frequency} Hz, {q}")
    w = 2 * math.pi * frequency / rate
    alpha = math.sin(w) / (2 * q)
    a0 = 1 + alpha
    return [(1 / a0, -2 * math.cos(w) / a0, 1 / a0, -2 * math.cos(w) / a0, (1 - alpha) / a0)]


def response(sections: list[Section], frequency: float, rate: float) -> complex:
    """Transfer function of a cascade at a frequency."""
    z = np.exp(-2j * np.pi * frequency / rate)
    out = 1 + 0j
    for b0, b1, b2, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return complex(out)
