"""Slices, trailing windows, statistics and joins over samples tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["signal_id", "channel"]


def channel(samples: DataFrame, number: int, channels: int | None = None) -> DataFrame:
    """One channel's samples; a number outside ``channels`` is an error."""
    if number < 0 or channels is not None and number >= channels:
        raise IndexError(f"channel {number} of {channels}")
    return samples.where(F.col("channel") == number)


def time_slice(samples: DataFrame, start: float, end: float, rate: float = 1000.0, duration: float | None = None) -> DataFrame:
    """Samples with start <= t < end, idx and t counted from the slice's first sample.

    Bounds are taken to the sample: a bound less than a millionth of a sample below one counts as that sample.
    """
    if not 0 <= start < end or duration is not None and end > duration:
        raise ValueError(f"a slice from {start} to {end} s isn't within the signal")
    first, last = int(start * rate + 1e-6), int(end * rate + 1e-6)
    rows = samples.where(F.col("idx").between(first, last - 1))
    idx = F.col("idx") - first
    return rows.withColumns({"idx": idx, "t": idx / F.lit(rate)})


def time_vector(samples: DataFrame, rate: float = 1000.0) -> DataFrame:
    """signal_id, channel, idx, t: the times alone."""
    return samples.select(*KEY, "idx", (F.col("idx") / F.lit(rate)).alias("t"))


def _ends(samples: DataFrame, last: DataFrame | None) -> DataFrame:
    """signal_id, channel, last: each channel's last idx. ``last`` spares a second pass over ``samples`` where it is known (``samples.last_idx``)."""
    return samples.groupBy(*KEY).agg(F.max("idx").alias("last")) if last is None else last.select(*KEY, "last")


def recent(samples: DataFrame, seconds: float = 3.0, rate: float = 1000.0, last: DataFrame | None = None) -> DataFrame:
    """Samples of a signal's last ``seconds`` (the latest one's time minus that, included)."""
    now = _ends(samples, last).groupBy("signal_id").agg((F.max("last") / F.lit(rate)).alias("_now"))
    return samples.join(now, "signal_id").where(F.col("t") >= F.col("_now") - seconds).select(*samples.columns)


def channel_stats(samples: DataFrame) -> DataFrame:
    """mean, rms, std_dev (population), min, max, peak_to_peak and n of each channel: aggregated before the shuffle."""
    x = F.col("x")
    return samples.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.stddev_pop(x).alias("std_dev"), F.min(x).alias("min_value"), F.max(x).alias("max_value"),
        (F.max(x) - F.min(x)).alias("peak_to_peak"),
    )


def chunk_stats(samples: DataFrame, turns: int = 100) -> DataFrame:
    """For each chunk of ``turns`` samples a channel: channels, samples, mean and rms."""
    x = F.col("x")
    return samples.groupBy("signal_id", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg(
        F.count_distinct("channel").alias("channels"), F.count("*").alias("samples"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms")
    )


def buffer_stats(samples: DataFrame, turns: int = 100, rate: float = 1000.0) -> DataFrame:
    """What a buffer of chunks holds: chunks, samples and seconds of each signal."""
    per = samples.groupBy("signal_id", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg(
        F.count("*").alias("n"), (F.count_distinct("idx") / F.lit(rate)).alias("s")
    )
    return per.groupBy("signal_id").agg(F.count("*").alias("chunks"), F.sum("n").alias("samples"), F.sum("s").alias("duration"))


def chunk_durations(samples: DataFrame, turns: int = 100, rate: float = 1000.0) -> DataFrame:
    """signal_id, chunk_seq, duration: each chunk of a signal is as long as its longest channel's part."""
    return samples.groupBy("signal_id", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg((F.count_distinct("idx") / F.lit(rate)).alias("duration"))


def latest_chunk(samples: DataFrame, turns: int = 100, last: DataFrame | None = None) -> DataFrame:
    """Samples of a signal's last chunk."""
    return buffer_tail(samples, 1, turns, last)


def buffer_tail(samples: DataFrame, chunks: int = 100, turns: int = 100, last: DataFrame | None = None) -> DataFrame:
    """Samples of a signal's last ``chunks`` chunks."""
    end = _ends(samples, last).groupBy("signal_id").agg(F.expr(f"max(last) div {int(turns)}").alias("_last"))
    return samples.join(end, "signal_id").where(F.expr(f"idx div {int(turns)}") > F.col("_last") - chunks).select(*samples.columns)


def plot_tail(samples: DataFrame, points: int = 3000, last: DataFrame | None = None) -> DataFrame:
    """Each channel's last ``points`` samples: idx has no gaps, so the last one's tells which."""
    end = _ends(samples, last).withColumnRenamed("last", "_last")
    return samples.join(end, KEY).where(F.col("idx") > F.col("_last") - points).select(*samples.columns)


def by_time(samples: DataFrame, channels: int) -> DataFrame:
    """One row for each time with a column ch0, ch1, … for every channel; null where a channel has no sample."""
    held = [F.max(F.when(F.col("channel") == c, F.col("x"))).alias(f"ch{c}") for c in range(channels)]
    return samples.groupBy("signal_id", "idx", "t").agg(*held)


def rebased(chunks: DataFrame, run: int = 4096) -> DataFrame:
    """Chunks (signal_id, chunk_seq, duration, …) with start_time, the sum of the durations of earlier ones.

    Sums are taken within runs of chunks and shifted by those of earlier runs: no task holds a whole signal.
    """
    rows = chunks.withColumn("_run", F.expr(f"chunk_seq div {int(run)}"))
    total = rows.groupBy("signal_id", "_run").agg(F.sum("duration").alias("_total"))
    before = total.select("signal_id", "_run", (F.sum("_total").over(Window.partitionBy("signal_id").orderBy("_run")) - F.col("_total")).alias("_before"))
    within = F.sum("duration").over(Window.partitionBy("signal_id", "_run").orderBy("chunk_seq")) - F.col("duration")
    placed = rows.withColumn("_within", within).join(before, ["signal_id", "_run"])
    return placed.select(*chunks.columns, (F.col("_before") + F.col("_within")).alias("start_time"))


def paired(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Raw and processed samples side by side: signal_id, channel, idx, t, x_raw, x."""
    return raw.select(*KEY, "idx", F.col("x").alias("x_raw")).join(processed, [*KEY, "idx"]).select(*KEY, "idx", "t", "x_raw", "x")


def clamp(samples: DataFrame, low: float = -5.0, high: float = 5.0) -> DataFrame:
    return samples.withColumn("x", F.greatest(F.lit(low), F.least(F.lit(high), F.col("x"))))


def lengths(samples: DataFrame, rate: float = 1000.0) -> DataFrame:
    """Of each signal: channels, samples, samples of its longest channel and their duration."""
    per = samples.groupBy(*KEY).agg(F.count("*").alias("n"))
    return per.groupBy("signal_id").agg(
        F.count("*").alias("channels"),
        F.sum("n").alias("samples"),
        F.max("n").alias("samples_per_channel"),
        (F.max("n") / F.lit(rate)).alias("duration")
    )


def violations(samples: DataFrame, channels: int = 16) -> DataFrame:
    """Channels of a table that breaks the rules of samples tables: number out of range, idx null, repeated or with gaps."""
    per = samples.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("idx").alias("distinct"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    dense = (F.col("n") == F.col("distinct")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    valid = F.col("channel").between(0, channels - 1)
    return per.where(~F.coalesce(dense & valid, F.lit(False)))


def expected_samples(chunks: DataFrame) -> DataFrame:
    """Chunks (signal_id, chunk_seq, channel_count, sampling_rate, duration, data) that don't hold what they announce.

    Gives expected (duration times rate, in whole samples, times channels), actual (values in data) and channels_valid
    (1 to 16). A null figure counts as a mismatch. Empty table: empty result.
    """
    expected = F.floor(F.col("duration") * F.col("sampling_rate") + F.lit(1e-6)) * F.col("channel_count")
    actual = F.coalesce(F.size(F.when(F.col("data").isNotNull(), F.col("data"))), F.lit(0)).cast("long")
    valid = F.coalesce(F.col("channel_count").between(1, 16), F.lit(False))
    rows = chunks.select(
        "signal_id",
        "chunk_seq",
        expected.cast("long").alias("expected"),
        F.greatest(actual, F.lit(0)).alias("actual"),
        valid.alias("channels_valid")
    )
    return rows.where(~F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)) | ~F.col("channels_valid"))


def signal_quality(samples: DataFrame) -> DataFrame:
    """Of each channel: n, and the share of its samples that are numbers (neither null nor non-finite), the score of a signal's quality."""
    good = F.coalesce(F.abs("x") < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce("x", F.lit(0.0)))
    return samples.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg(good.cast("double")).alias("quality"))
