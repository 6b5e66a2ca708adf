"""Power spectra of windows, batched through numpy's FFT: no taper, zeros up to the next power of two, bins below Nyquist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwave.functions import complexity
from sparkwave.session import importable

# The frequency bands of surface EMG, in Hz.
EMG_BANDS = [("Low", 10.0, 60.0), ("Mid", 60.0, 150.0), ("High", 150.0, 300.0)]
#: Spectral features in the order of the result.
FEATURES = ["mean_frequency", "median_frequency", "peak_frequency", "spectral_centroid", "spectral_spread", "spectral_entropy", "total_power", "peak_magnitude"]
EXTENSIONS = ["spectral_edge_95", *complexity.NAMES]
#: A window shorter than this has no spectrum.
LEAST = 4


def padded(n: int) -> int:
    """The next power of two."""
    return 1 << max(0, n - 1).bit_length()


def power(windows: np.ndarray) -> np.ndarray:
    """(windows, bins): squared magnitude of bins 0 to N/2 - 1."""
    spectrum = np.fft.rfft(windows, padded(windows.shape[1]), axis=1)[:, : padded(windows.shape[1]) // 2]
    return spectrum.real**2 + spectrum.imag**2


def _by_length(arrays: pd.Series):
    """(places, windows of one length): arrays of a batch that are long enough and have finite values only."""
    groups: dict[int, list[int]] = {}
    for i, a in enumerate(arrays):
        if a is not None and len(a) >= LEAST:
            groups.setdefault(len(a), []).append(i)
    for places in groups.values():
        x = np.stack([np.asarray(arrays.iloc[i], float) for i in places])
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield np.array(places)[good], x[good]


def _spectra(arrays: pd.Series) -> pd.Series:
    out = [None] * len(arrays)
    for places, x in _by_length(arrays):
        for i, p in zip(places, power(x)):
            out[i] = p
    return pd.Series(out, dtype=object)


def power_spectrum(windows: DataFrame, col: str = "x") -> DataFrame:
    """``windows`` with an array ``p`` in place of ``col``; null for windows that are too short or hold no number."""
    importable(windows.sparkSession)
    spectra = F.pandas_udf(_spectra, "array<double>")
    return windows.withColumn("p", spectra(F.col(col))).drop(col)


def band_bins(low: float, high: float, rate: float, n: int) -> tuple[int, int]:
    """First and last bin of a band, both included; past the last bin below Nyquist there is none."""
    df = rate / padded(n)
    return int(low / df), min(int(high / df), padded(n) // 2 - 1)


def describe(p: np.ndarray, rate: float, n: int, bands, names: list[str]) -> dict[str, np.ndarray]:
    """Features of power spectra (rows of p). Without any power all are 0 and there are no bands."""
    total = p.sum(axis=1)
    some = total > 0
    share = p / np.where(some, total, 1)[:, None]
    bins = np.arange(p.shape[1])
    f = bins * (rate / padded(n))
    out: dict[str, np.ndarray] = {"total_power": total}
    peak = p.shape[1] - 1 - np.argmax(p[:, ::-1], axis=1)  # of equal ones the last
    out["peak_frequency"], out["peak_magnitude"] = f[peak], np.sqrt(p[np.arange(len(p)), peak])
    out["spectral_centroid"] = share @ f
    out["spectral_spread"] = np.sqrt((share * (f[None, :] - out["spectral_centroid"][:, None]) ** 2).sum(axis=1))
    rest = p[:, 1:].sum(axis=1)
    out["mean_frequency"] = (p[:, 1:] @ f[1:]) / np.where(rest > 0, rest, 1)
    heap = np.cumsum(p, axis=1)
    out["median_frequency"] = f[np.argmax(heap >= total[:, None] / 2, axis=1)]
    out["spectral_edge_95"] = f[np.argmax(heap >= 0.95 * heap[:, -1:], axis=1)]
    out["spectral_entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    out = {k: np.where(some, v, 0.0) for k, v in out.items() if k in names}
    found = {name: p[:, a : b + 1].sum(axis=1) for name, low, high in bands for a, b in [band_bins(low, high, rate, n)]}
    out["band_powers"] = np.array([{k: float(v[i]) for k, v in found.items()} if some[i] else {} for i in range(len(p))], dtype=object)
    return out


def histogram_entropy(x: np.ndarray, bins: int = 20) -> np.ndarray:
    """Bits of the histograms of windows (rows of x) over ``bins`` bins from a row's minimum to its maximum, the last one for the maximum alone; NaN is left out.

    0 without a range or with fewer than two samples.
    """
    real = np.isfinite(x)
    n = real.sum(axis=1)
    low, high = (f(np.where(real, x, e), axis=1, initial=e) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
    some = (n >= 2) & (high > low)
    out = np.zeros(len(x))
    if some.any():
        x, real, n = x[some], real[some], n[some][:, None]
        place = np.minimum(bins - 1, (np.where(real, x - low[some][:, None], 0) / (high - low)[some][:, None] * (bins - 1)).astype(int))
        counts = np.bincount((np.arange(len(x))[:, None] * bins + place)[real], minlength=len(x) * bins).reshape(-1, bins)
        share = counts / n
        out[some] = -(share * np.log2(np.where(counts > 0, share, 1))).sum(axis=1)
    return out


def spectral_struct(col: str, rate: float, bands=EMG_BANDS, names: list[str] = FEATURES) -> Column:
    """Struct of the spectral features ``names`` and band_powers of an array column.

    A window of fewer than 4 samples has the values of one without power; one with a null or non-finite sample has nulls.
    ``entropy`` among the names is that of the histogram, without such samples; those of ``complexity`` are null where they aren't defined.
    """
    spectral = [n for n in names if n != "entropy" and n not in complexity.OF]
    others = [n for n in names if n in complexity.OF]

    def run(arrays: pd.Series) -> pd.DataFrame:
        sizes = np.array([0 if a is None else len(a) for a in arrays])
        good = np.array([a is not None and bool(np.isfinite(np.asarray(a, float)).all()) for a in arrays], bool)
        found = {k: np.where(good, 0.0, np.nan) if k in spectral else np.full(len(arrays), np.nan) if k in others else np.zeros(len(arrays)) for k in names}
        powers = np.empty(len(arrays), object)
        powers[:] = [{} if g else None for g in good]
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == n)
            x = np.stack([np.asarray(arrays.iloc[i], float) for i in at])
            if "entropy" in names:
                found["entropy"][at] = histogram_entropy(x)
            at, x = at[good[at]], x[good[at]]
            for k in others if len(at) else []:
                found[k][at] = complexity.OF[k](x)
            if n >= LEAST and len(at):
                for k, v in describe(power(x), rate, n, bands, spectral).items():
                    (powers if k == "band_powers" else found[k])[at] = v
        return pd.DataFrame({**found, "band_powers": pd.Series(powers, dtype=object)})

    return F.pandas_udf(run, ", ".join([*(f"{k} double" for k in names), "band_powers map<string,double>"]))(F.col(col))
