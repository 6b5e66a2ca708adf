"""Processing profiles: named processors and the pipelines that chain them, as JSON, as tables and as ``Pipeline``."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.plans.spec import Pipeline, pipeline

ERRORS = ("strict", "bypass", "fallback")


def as_float(value, default: float | None = None) -> float | None:
    """Numbers as float; anything else, booleans too, gives the default."""
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def as_int(value, default: int | None = None) -> int | None:
    """Numbers as int, without their fraction."""
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def as_bool(value, default: bool | None = None) -> bool | None:
    return value if isinstance(value, bool) else default


@dataclass
class Constraints:
    max_latency_us: int = 10_000
    max_memory_bytes: int = 1 << 20
    rates: tuple[float, float] | None = None
    channels: tuple[int, int] | None = None

    def met_by(self, latency_us: int, memory_bytes: int, success: bool = True, rate: float | None = None, channels: int | None = None) -> bool:
        within = lambda v, r: v is None or r is None or r[0] <= v <= r[1]
        return success and latency_us <= self.max_latency_us and memory_bytes <= self.max_memory_bytes and within(rate, self.rates) and within(channels, self.channels)


@dataclass
class Processor:
    """``kind`` is one of the stages' kinds, ``params`` its parameters."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    constraints: Constraints = field(default_factory=Constraints)

    def validate(self) -> None:
        if not self.name:
            raise ValueError("a processor needs a name")
        if self.constraints.max_latency_us <= 0:
            raise ValueError(f"{self.name}: the latency limit must be positive")

    def estimate(self) -> float:
        """Filters: 0.1 for each of ``order`` (2 if none is given); features: a thousandth of the window's samples."""
        return as_int(self.params.get("size"), 256) / 1000 if self.kind == "features" else as_int(self.params.get("order"), 2) * 0.1


@dataclass
class Chain:
    processors: list[str]
    enabled: bool = True
    groups: list[list[str]] = field(default_factory=list)


@dataclass
class Profile:
    name: str
    max_latency_ms: float = 10.0
    buffer_size: int = 256
    parallel: bool = True
    on_error: str = "strict"
    processors: dict[str, Processor] = field(default_factory=dict)
    pipelines: dict[str, Chain] = field(default_factory=dict)
    #: With on_error "fallback": by processor, the one that runs in its place where it can't; without one it is left out.
    fallbacks: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, kind: str, **params) -> Profile:
        self.processors[name] = Processor(name, kind, params)
        return self

    def chain(self, name: str, processors: list[str]) -> Profile:
        self.pipelines[name] = Chain(processors)
        return self

    def processor(self, name: str) -> Processor | None:
        return self.processors.get(name)

    def update(self, name: str, **params) -> Profile:
        self.processors[name].params.update(params)  # KeyError if it isn't there
        return self

    def enable_processor(self, name: str, on: bool = True) -> Profile:
        self.processors[name].enabled = on
        return self

    def enable_pipeline(self, name: str, on: bool = True) -> Profile:
        self.pipelines[name].enabled = on
        return self

    def unknown(self) -> list[tuple[str, str]]:
        """(pipeline, processor) of names in chains and groups that no processor has."""
        named = [(p, n) for p, c in self.pipelines.items() for n in [*c.processors, *(n for g in c.groups for n in g)]]
        return [(p, n) for p, n in named if n not in self.processors]

    def validate(self) -> None:
        if self.max_latency_ms <= 0:
            raise ValueError("the latency limit must be positive")
        if self.buffer_size <= 0:
            raise ValueError("the buffer must hold something")
        if self.on_error not in ERRORS:
            raise ValueError(f"on_error must be one of {ERRORS}")
        for p in self.processors.values():
            p.validate()
        for name, c in self.pipelines.items():
            if not c.processors:
                raise ValueError(f"pipeline {name} is empty")
        if self.unknown():
            raise ValueError(f"unknown processors {self.unknown()}")

    def latency(self, name: str) -> float | None:
        """Sum of the estimates of a pipeline's known processors; None without such a pipeline."""
        if name not in self.pipelines:
            return None
        return sum(self.processors[n].estimate() for n in self.pipelines[name].processors if n in self.processors)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Profile:
        d = json.loads(text)
        limits = lambda c: Constraints(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()})
        d["processors"] = {n: Processor(**{**p, "constraints": limits(p["constraints"])}) for n, p in d["processors"].items()}
        d["pipelines"] = {n: Chain(**c) for n, c in d["pipelines"].items()}
        return Profile(**d)

    def to_pipeline(self, name: str) -> Pipeline:
        """The runnable pipeline of a chain. Processors that are disabled stay, disabled.

        With on_error ``fallback`` a processor that can't run is replaced by the one that ``fallbacks`` names for it, or left out.
        """
        self.validate()
        out = Pipeline(name, bypass_on_error=self.on_error != "strict", max_latency_ms=self.max_latency_ms)
        for n in self.pipelines[name].processors:
            out = out.add(self.processors[n].kind, n, **self.processors[n].params)
            other = self.processors.get(self.fallbacks.get(n, ""))
            if self.on_error == "fallback" and other is not None:
                out = out.with_fallback(out.stages[-1].name, other.kind, **other.params)
            out = out.enable(out.stages[-1].name, self.processors[n].enabled and self.pipelines[name].enabled)
        return out


# The profiles.
def realtime() -> Profile:
    out = Profile("Real-time EMG", 5.0, 128, True, "bypass")
    out.add("rt_highpass", "highpass", cutoff=20.0, order=2).add("rt_notch", "notch", frequency=50.0, q=10.0).add("rt_smooth", "moving_average", size=3)
    return out.chain("realtime", list(out.processors))


def research() -> Profile:
    out = Profile("Research EMG", 50.0, 1024, True, "strict")
    out.add("research_highpass", "highpass", cutoff=10.0, order=6).add("research_lowpass", "lowpass", cutoff=450.0, order=6)
    out.add("research_notch_50", "notch", frequency=50.0, q=50.0).add("research_notch_60", "notch", frequency=60.0, q=50.0).add(
        "research_features", "features", size=512, overlap=0.75
    )
    return out.chain("research", list(out.processors))


def clinical() -> Profile:
    out = Profile("Clinical EMG", 20.0, 256, False, "strict")
    out.add("clinical_highpass", "highpass", cutoff=20.0, order=4).add("clinical_lowpass", "lowpass", cutoff=500.0, order=4)
    out.add("clinical_notch", "notch", frequency=50.0, q=30.0).add("clinical_features", "features", size=256, overlap=0.5)
    return out.chain("clinical", list(out.processors))


PROFILES = {"realtime": realtime, "research": research, "clinical": clinical, "custom": realtime}


def for_profile(name: str) -> Profile:
    return PROFILES[name]()


def tables(spark: SparkSession, profiles: list[Profile]) -> tuple[DataFrame, DataFrame]:
    """(processors, chains) of profiles as tables: a few rows each."""
    processors = [
        (
            p.name, x.name, "features" if x.kind == "features" else "filter", as_int(x.params.get("order")), as_int(x.params.get("size"))
        ) for p in profiles for x in p.processors.values()
    ]
    chains = [(p.name, c, i, n) for p in profiles for c, chain in p.pipelines.items() for i, n in enumerate(chain.processors)]
    return (
        spark.createDataFrame(processors, "profile string, processor string, kind string, order int, size int"),
        spark.createDataFrame(chains, "profile string, pipeline string, position int, processor string"),
    )


def latencies(processors: DataFrame, chains: DataFrame) -> DataFrame:
    """profile, pipeline, latency: ``Profile.latency`` over tables."""
    each = F.when(
        F.col("kind") == "filter", F.coalesce("order", F.lit(2)) * F.lit(0.1)
    ).when(F.col("kind") == "features", F.coalesce("size", F.lit(256)) / 1000).otherwise(1.0)
    return chains.join(processors, ["profile", "processor"]).groupBy("profile", "pipeline").agg(F.sum(each).alias("latency"), F.count("*").alias("stages"))


def unknown_processors(processors: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows of ``chains`` that name no processor of their profile."""
    return chains.join(processors, ["profile", "processor"], "left_anti").select("profile", "pipeline", "position", "processor")
