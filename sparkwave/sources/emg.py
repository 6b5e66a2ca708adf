"""A signal source: surface EMG made from an activation pattern, as column expressions over a range of samples.

Every random number is a hash of (seed, channel, idx, purpose), so a sample has the same value in any partitioning,
in batch and in a stream.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.functions.patterns import Pattern, mean_activation

# What a recording may have.
RATES = (500.0, 4000.0)
CHANNELS = (1, 16)
LIMIT = 5.0


@dataclass(frozen=True)
class Noise:
    gaussian_std: float = 0.05
    baseline_wander: float = 0.02
    motion_artifact_prob: float = 0.01
    motion_artifact_amp: float = 0.3

    @staticmethod
    def off() -> Noise:
        return Noise(0.0, 0.0, 0.0, 0.0)


@dataclass(frozen=True)
class Emg:
    """A recording to make. ``with_(…)`` gives a changed one; every change takes effect."""

    rate: float = 1000.0
    channels: int = 1
    pattern: Pattern = field(default_factory=lambda: Pattern.of("constant", level=0.3))
    noise: Noise = field(default_factory=Noise)
    powerline: float | None = 50.0
    recruitment: float = 0.2
    seed: int = 0
    muscle: str = "Biceps"

    def __post_init__(self):
        if not RATES[0] <= self.rate <= RATES[1]:
            raise ValueError(f"sampling rate {self.rate} is outside {RATES}")
        if not CHANNELS[0] <= self.channels <= CHANNELS[1]:
            raise ValueError(f"{self.channels} channels are outside {CHANNELS}")
        if self.noise.gaussian_std < 0:
            raise ValueError("the standard deviation of noise is negative")

    def with_(self, **changes) -> Emg:
        return replace(self, **changes)

    def uniform(self, purpose: str) -> Column:
        """In [0, 1), by hash."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.col("channel"), F.col("idx"), F.lit(purpose)), 11)
        return bits.cast("double") / F.lit(float(1 << 53))

    def normal(self) -> Column:
        return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform("n1"))) * F.cos(F.lit(2 * math.pi) * self.uniform("n2"))

    def value(self) -> Column:
        """The sample at columns channel, idx and t."""
        t = F.col("t")
        active = self.pattern.at(t)
        phase = F.lit(2 * math.pi) * (F.lit(80.0) + F.lit(10.0) * F.col("channel")) * t
        x = F.lit(2.0) * active * (F.sin(phase) + F.lit(0.3) * F.sin(2 * phase) + F.lit(0.1) * F.sin(3 * phase))
        n = self.noise
        if self.recruitment:
            x += active * F.lit(self.recruitment) * (2 * self.uniform("r") - 1)
        if n.gaussian_std:
            x += F.lit(n.gaussian_std) * self.normal()
        if n.baseline_wander:
            x += F.lit(n.baseline_wander) * F.sin(F.lit(2 * math.pi * 0.1) * t)
        if n.motion_artifact_prob:
            x += F.when(self.uniform("p") < n.motion_artifact_prob, F.lit(n.motion_artifact_amp) * (2 * self.uniform("a") - 1)).otherwise(0.0)
        if self.powerline:
            x += F.lit(0.05) * F.sin(F.lit(2 * math.pi * self.powerline) * t)
        return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x))

    def samples(self, spark: SparkSession, duration: float, start: float = 0.0, signal_id: str = "emg") -> DataFrame:
        """Samples of ``duration`` seconds from time ``start``; idx counts from time 0."""
        if duration <= 0:
            raise ValueError("the duration is not positive")
        first, n = round(start * self.rate), int(duration * self.rate + 1e-9)
        return self.fill(spark.range(first, first + n).select(F.col("id").alias("idx")), signal_id)

    def fill(self, ticks: DataFrame, signal_id: str = "emg") -> DataFrame:
        """Samples at the values of a column idx, batch or stream."""
        each = ticks.select(F.lit(signal_id).alias("signal_id"), F.explode(F.sequence(F.lit(0), F.lit(self.channels - 1))).alias("channel"), "idx")
        timed = each.withColumn("t", F.col("idx") / F.lit(self.rate))
        return timed.select("signal_id", "channel", "idx", "t", self.value().alias("x"))

    def metadata(self, spark: SparkSession, duration: float, signal_id: str = "emg") -> DataFrame:
        """One row that describes the recording, with its mean activation and what 16 channels at most allow."""
        activation = mean_activation(self.pattern, duration)
        return spark.range(1).select(
            F.lit(signal_id).alias("signal_id"), F.lit("surface").alias("kind"), F.lit(self.muscle).alias("muscle_group"), activation.alias("activation_level"), F.lit(self.rate).alias("sampling_rate"),
            F.lit(self.channels).alias("channel_count"), F.lit(float(duration)).alias("duration"), F.lit(self.noise.gaussian_std).alias("noise_level"),
            F.lit(int(duration * self.rate + 1e-9) * self.channels).cast("long").alias("expected_samples"),
        )
