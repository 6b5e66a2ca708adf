"""Muscle activation over time, as column expressions."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each kind is called, its parameters with their defaults.
KINDS = {
    "constant": ("Constant activation", {"level": 0.3}),
    "sinusoidal": ("Sinusoidal contraction", {"frequency": 1.0, "amplitude": 0.3, "baseline": 0.2}),
    "ramp": ("Gradual ramp", {"start_level": 0.0, "end_level": 1.0, "duration": 10.0}),
    "burst": ("Burst pattern", {"on_time": 1.0, "off_time": 1.0, "amplitude": 0.5}),
    "fatigue": ("Muscle fatigue", {"initial_level": 0.8, "decay_rate": 0.1}),
    "realistic": ("Realistic with tremor", {"base_level": 0.4, "tremor_frequency": 8.0, "tremor_amplitude": 0.05}),
}


@dataclass(frozen=True)
class Pattern:
    """A kind of ``KINDS`` with parameters; those not given have the kind's defaults."""

    kind: str
    params: tuple[tuple[str, float], ...] = ()

    @staticmethod
    def of(kind: str, **params: float) -> Pattern:
        if kind not in KINDS:
            raise ValueError(f"unknown activation pattern {kind!r}")
        if unknown := set(params) - set(KINDS[kind][1]):
            raise ValueError(f"{kind} has no parameters {sorted(unknown)}")
        return Pattern(kind, tuple({**KINDS[kind][1], **params}.items()))

    @property
    def description(self) -> str:
        return KINDS[self.kind][0]

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"params": dict(self.params)})

    @staticmethod
    def from_json(text: str) -> Pattern:
        d = json.loads(text)
        return Pattern.of(d["kind"], **d["params"])

    def at(self, t: Column) -> Column:
        """Activation at time t (seconds)."""
        p = dict(self.params)
        wave = lambda f: F.sin(F.lit(2 * math.pi * f) * t)
        if self.kind == "constant":
            return F.lit(p["level"])
        if self.kind == "sinusoidal":
            return F.lit(p["baseline"]) + F.lit(p["amplitude"]) * wave(p["frequency"])
        if self.kind == "ramp":
            return F.when(t >= p["duration"], F.lit(p["end_level"])).otherwise(
                F.lit(p["start_level"]) + F.lit((p["end_level"] - p["start_level"]) / p["duration"]) * t
            )
        if self.kind == "burst":
            return F.when(t % F.lit(p["on_time"] + p["off_time"]) < p["on_time"], F.lit(p["amplitude"])).otherwise(F.lit(0.0))
        if self.kind == "fatigue":
            return F.lit(p["initial_level"]) * F.exp(F.lit(-p["decay_rate"]) * t)
        tremor = F.lit(p["base_level"]) + F.lit(p["tremor_amplitude"]) * wave(p["tremor_frequency"])
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), tremor))


# The named patterns.
PRESETS = {
    "Rest": Pattern.of("constant", level=0.1),
    "Light Activity": Pattern.of("constant", level=0.3),
    "Moderate Activity": Pattern.of("constant", level=0.6),
    "High Activity": Pattern.of("constant", level=0.9),
    "Slow Contraction": Pattern.of("sinusoidal", frequency=0.5, amplitude=0.4, baseline=0.2),
    "Fast Contraction": Pattern.of("sinusoidal", frequency=2.0, amplitude=0.3, baseline=0.1),
    "Warmup": Pattern.of("ramp", start_level=0.1, end_level=0.7, duration=10.0),
    "Cooldown": Pattern.of("ramp", start_level=0.8, end_level=0.1, duration=15.0),
    "Exercise Bursts": Pattern.of("burst", on_time=2.0, off_time=1.0, amplitude=0.8),
    "Fatigue Test": Pattern.of("fatigue", initial_level=0.9, decay_rate=0.1),
    "Natural Movement": Pattern.of("realistic", base_level=0.4, tremor_frequency=8.0, tremor_amplitude=0.05),
}


def mean_activation(pattern: Pattern, duration: float, points: int = 100) -> Column:
    """Mean activation at evenly spaced points from 0, between 0 and 1."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: pattern.at(i * F.lit(duration / points)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(at, F.lit(0.0), lambda a, b: a + b) / points))
