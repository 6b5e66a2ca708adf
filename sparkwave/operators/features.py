"""Features of windows: time domain, statistics and spectra, each window one row.

Time-domain features and moments are plain aggregates over the windows' samples. Arrays are gathered, and go to numpy
in Arrow batches, only if the histogram's entropy or a spectral feature is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwave.functions import spectrum
from sparkwave.operators import windows
from sparkwave.session import importable

TIME = ["mean", "rms", "mav", "zero_crossings", "waveform_length", "slope_sign_changes", "variance", "std_dev", "min_value", "max_value", "peak_to_peak"]
STATISTICS = ["skewness", "kurtosis", "entropy", "energy", "power"]
SPECTRAL = [*spectrum.FEATURES, "band_powers"]
ALL = [*TIME, *SPECTRAL, *STATISTICS]
#: The short form of a feature row.
SUMMARY = ["rms", "mav", "zero_crossings", "mean_frequency", "spectral_centroid", "total_power"]


def _aggregates() -> dict[str, Column]:
    x, at = F.col("x"), F.col("at")
    crossed = (at >= 1) & ((F.col("x") >= 0) != (F.col("_x1") >= 0))
    turned = (at >= 2) & ((x > F.col("_x1")) != (F.col("_x1") > F.col("_x2")))
    count = lambda c: F.count(F.when(c, 1))
    enough = F.count("*") >= 2
    return {
        "mean": F.avg(x), "rms": F.sqrt(F.avg(x * x)), "mav": F.avg(F.abs(x)), "zero_crossings": count(crossed), "waveform_length": F.coalesce(
            F.sum(F.when(at >= 1, F.abs(x - F.col("_x1")))), F.lit(0.0)
        ),
        "slope_sign_changes": count(turned), "variance": F.var_pop(x), "std_dev": F.stddev_pop(x), "min_value": F.min(x), "max_value": F.max(x), "peak_to_peak": F.max(x) - F.min(x),
        "skewness": F.when(
            enough, F.coalesce(F.skewness(x), F.lit(0.0))
        ).otherwise(0.0), "kurtosis": F.when(enough, F.coalesce(F.kurtosis(x), F.lit(0.0))).otherwise(0.0),
        "energy": F.when(enough, F.sum(x * x)).otherwise(0.0), "power": F.when(enough, F.avg(x * x)).otherwise(0.0),
    }


def features(
    samples: DataFrame, size: int, overlap: float = 0.5, rate: float = 1000.0, enabled: list[str] | None = None, bands=spectrum.EMG_BANDS
) -> DataFrame:
    """One row for each full window: signal_id, channel, k, start_sample, end_sample, window_size, sampling_rate and the features.

    ``enabled`` names the features to compute, all by default; what isn't asked for isn't computed. Null samples are
    left out of time features and statistics; spectral features of such a window are null.
    """
    names = ALL if enabled is None else [n for n in [*ALL, *spectrum.EXTENSIONS] if n in enabled]
    if enabled is not None and (unknown := set(enabled) - {*ALL, *spectrum.EXTENSIONS}):
        raise ValueError(f"unknown features {sorted(unknown)}")
    importable(samples.sparkSession)
    hop = windows.hop_of(size, overlap)
    rows = windows.runs(samples.select("signal_id", "channel", "idx", "x"), size, hop).repartition("signal_id", "channel", "_run")
    if {"zero_crossings", "waveform_length", "slope_sign_changes"} & set(names):
        w = Window.partitionBy("signal_id", "channel", "_run").orderBy("idx")
        rows = rows.withColumns({"_x1": F.lag("x", 1).over(w), "_x2": F.lag("x", 2).over(w)})
    spectral = [n for n in names if n in spectrum.FEATURES or n in spectrum.EXTENSIONS]
    wide = bool(spectral) or "band_powers" in names or "entropy" in names
    described = [*spectral, *(["entropy"] if "entropy" in names else [])]
    aggregates = {n: c for n, c in _aggregates().items() if n in names}
    if wide:
        aggregates["_window"] = windows.ordered()
    out = windows.members(rows, hop).groupBy(*windows.KEY).agg(
        F.count("*").alias("window_size"), *[c.alias(n) for n, c in aggregates.items()]
    ).where(F.col("window_size") == size)
    if wide:
        out = out.withColumn("_spectral", spectrum.spectral_struct("_window", rate, bands, described))
    start = F.col("k") * hop
    return out.select(
        "signal_id", "channel", "k", start.alias("start_sample"), (start + size).alias("end_sample"), "window_size", F.lit(rate).alias("sampling_rate"),
        *[(F.col(f"_spectral.{n}").alias(n) if n in described or n == "band_powers" else F.col(n)) for n in names],
    )


def window_spectra(rows: DataFrame, rate: float, names: list[str] = spectrum.FEATURES, bands=spectrum.EMG_BANDS) -> DataFrame:
    """Spectral features of ready-made windows (a column x of arrays); other columns stay."""
    importable(rows.sparkSession)
    keep = [c for c in rows.columns if c != "x"]
    return rows.withColumn("_s", spectrum.spectral_struct("x", rate, bands, names)).select(*keep, *[F.col(f"_s.{n}").alias(n) for n in [*names, "band_powers"]])


def summary(feature_rows: DataFrame) -> DataFrame:
    return feature_rows.select("signal_id", "channel", "k", "window_size", *SUMMARY)
