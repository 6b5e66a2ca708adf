"""Pipelines as specifications: stages that become one DataFrame plan.

Everything that can go wrong with a stage (a cutoff above half the sampling rate, a missing parameter) shows when the
plan is made. A strict pipeline then raises; one with bypass leaves the stage out and says so in ``warnings``.
Neighbouring recursive filters become one cascade: one shuffle and one pass, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwave.operators import design, features, filters
from sparkwave.operators.design import DesignError, Section

RECURSIVE = ("highpass", "lowpass", "bandpass", "notch")
# The parameters of each kind of stage, with defaults (None: required).
KINDS: dict[str, dict] = {
    "highpass": {"cutoff": None, "order": 2},
    "lowpass": {"cutoff": None, "order": 2},
    "bandpass": {"low": None, "high": None, "order": 2},
    "notch": {"frequency": None, "q": 30.0},
    "moving_average": {"size": None},
    "median": {"size": None},
    "features": {"size": None, "overlap": 0.5, "enabled": None},
}
#: What a stage is to the pipeline, in the order of ``by_kind``.
ROLES = ("filter", "feature_extractor", "analyzer", "post_processor")
#: A user's own stage: (samples, rate) -> samples, a DataFrame to DataFrame step like any other of the plan.
Own = Callable[[DataFrame, float], DataFrame]


@dataclass(frozen=True)
class Stage:
    kind: str
    params: tuple[tuple[str, object], ...] = ()
    name: str = ""
    enabled: bool = True
    own: Own | None = field(default=None, compare=False)
    own_check: Callable[[float], None] | None = field(default=None, compare=False)
    #: Of kind "nested": a whole pipeline. Of its stages, once they are dealt out: whether filters are true cascades.
    inner: Pipeline | None = None
    cascade: bool | None = None
    #: What runs in place of a stage that can't.
    fallback: Stage | None = None
    #: One of ROLES, for a user's own stage or a pipeline of its own.
    role: str = "filter"

    @staticmethod
    def of(kind: str, name: str = "", **params) -> Stage:
        if kind not in KINDS:
            raise ValueError(f"unknown stage {kind!r}")
        if unknown := set(params) - set(KINDS[kind]):
            raise ValueError(f"{kind} has no parameters {sorted(unknown)}")
        return Stage(kind, tuple({**KINDS[kind], **params}.items()), name or kind)

    def with_(self, **params) -> Stage:
        return replace(self, params=Stage.of(self.kind, **{**dict(self.params), **params}).params)

    def sections(self, rate: float, cascade: bool = False) -> list[Section]:
        p, cascade = dict(self.params), cascade if self.cascade is None else self.cascade
        if self.kind == "highpass":
            return design.highpass(p["cutoff"], rate, p["order"], cascade)
        if self.kind == "lowpass":
            return design.lowpass(p["cutoff"], rate, p["order"], cascade)
        if self.kind == "bandpass":
            return design.bandpass(p["low"], p["high"], rate, p["order"], cascade)
        return design.notch(p["frequency"], rate, p["q"])

    def check(self, rate: float, cascade: bool = False, bandpass: bool = False) -> None:
        """Raises DesignError if the stage can't run at this rate."""
        if self.kind == "nested":
            self.inner.normalised(rate)
            return
        if self.kind == "own":
            if self.own is None:
                raise DesignError(f"{self.name}: the stage's function isn't known here")
            if self.own_check is not None:
                self.own_check(rate)
            return
        missing = [k for k, v in self.params if v is None and k != "enabled"]
        if missing:
            raise DesignError(f"{self.name}: {', '.join(missing)} required")
        if self.kind == "bandpass" and not bandpass:
            raise DesignError(f"{self.name}: band-pass filters must be allowed explicitly")
        if self.kind in RECURSIVE:
            self.sections(rate, cascade)
        elif self.kind == "features":
            features.windows.hop_of(dict(self.params)["size"], dict(self.params)["overlap"])
        elif dict(self.params)["size"] < 1:
            raise DesignError(f"{self.name}: the window must hold a sample at least")

    def more(self) -> dict:
        """What ``Pipeline.export`` has of the stage besides its parameters."""
        out = ({"inner": self.inner.export()} if self.inner else {}) | ({"role": self.role} if self.role != "filter" else {})
        back = self.fallback
        return out | ({"fallback": {"name": back.name, "kind": back.kind, "params": dict(back.params), "enabled": True}} if back else {})

    def latency_us(self) -> int:
        """Nominal delay: 10 µs a section, 50 µs for a notch, half a window or a whole one at 1 kHz."""
        p = dict(self.params)
        if self.kind == "nested":
            return self.inner.latency_us() if self.inner.enabled else 0
        if self.kind == "own":
            return p["latency_us"]
        return {
            "highpass": 10,
            "lowpass": 10,
            "bandpass": 20,
            "notch": 50,
            "moving_average": (p.get("size") or 0) * 500,
            "median": (p.get("size") or 0) * 500,
            "features": (p.get("size") or 0) * 1000
        }[self.kind]


@dataclass(frozen=True)
class Result:
    """``samples``: the filtered table, with x_raw. ``features``: one table for each feature stage. ``warnings``: what was left out."""

    samples: DataFrame
    features: list[DataFrame]
    warnings: list[str]
    stages: list[str]


@dataclass(frozen=True)
class Pipeline:
    name: str
    stages: tuple[Stage, ...] = ()
    bypass_on_error: bool = False
    max_latency_ms: float = 10.0
    cascade: bool = False
    allow_bandpass: bool = False
    enabled: bool = True

    # building: every call gives a new pipeline
    def add(self, kind: str, name: str = "", **params) -> Pipeline:
        """Adds a stage; a second one of the same name is numbered, so that names stay unique."""
        return self._append(Stage.of(kind, name, **params))

    def add_stage(self, name: str, own: Own, check: Callable[[float], None] | None = None, latency_us: int = 1000, role: str = "filter") -> Pipeline:
        """Adds a user's stage. It gets the samples and the rate, and returns samples with the columns it got (``x`` changed).

        ``check`` gets the rate when a plan is made and raises DesignError if the stage can't run at it; ``latency_us`` is
        the stage's nominal delay, ``role`` one of ROLES.
        """
        if not name:
            raise ValueError("a stage needs a name")
        if role not in ROLES:
            raise ValueError(f"a stage is one of {ROLES}")
        return self._append(Stage("own", (("latency_us", latency_us),), name, True, own, check, role=role))

    def add_pipeline(self, inner: Pipeline, name: str = "") -> Pipeline:
        """Adds a whole pipeline as one stage, with its own bypass, latency limit, cascades and switches.

        A stage of it that can't run is left out if the inner pipeline allows bypass; else the inner pipeline fails, and is
        left out as a whole if this one allows it. Its features come after those of earlier stages.
        """
        return self._append(Stage("nested", (), name or inner.name, inner=inner))

    def with_fallback(self, name: str, kind: str, **params) -> Pipeline:
        """Where the stage ``name`` can't run, one of ``kind`` runs in its place."""
        return self._put(name, replace(self.stage(name), fallback=Stage.of(kind, f"{name}_fallback", **params)))

    def _append(self, stage: Stage) -> Pipeline:
        name, taken, n = stage.name, {s.name for s in self.stages}, 2
        while stage.name in taken:
            stage, n = replace(stage, name=f"{name}_{n}"), n + 1
        return replace(self, stages=(*self.stages, stage))

    def add_stages(self, other: Pipeline) -> Pipeline:
        """Another pipeline's stages after these."""
        out = self
        for s in other.stages:
            out = out._append(s)
        return out

    def bypass(self, on: bool = True) -> Pipeline:
        return replace(self, bypass_on_error=on)

    def stage(self, name: str) -> Stage:
        for s in self.stages:
            if s.name == name:
                return s
        raise KeyError(f"pipeline {self.name} has no stage {name!r}")

    def update(self, name: str, **params) -> Pipeline:
        return self._put(name, self.stage(name).with_(**params))

    def enable(self, name: str, on: bool = True) -> Pipeline:
        return self._put(name, replace(self.stage(name), enabled=on))

    def _put(self, name: str, stage: Stage) -> Pipeline:
        return replace(self, stages=tuple(stage if s.name == name else s for s in self.stages))

    def by_kind(self) -> Pipeline:
        """Filters, then feature stages, analyzers and post-processors, otherwise in order."""
        return replace(self, stages=tuple(s for _, _, s in sorted((ROLES.index(k), i, s) for i, (k, s) in enumerate(zip(self.kinds(), self.stages)))))

    # what it says about itself
    def names(self) -> list[str]:
        return [s.name for s in self.stages]

    def kinds(self) -> list[str]:
        """The stages' roles."""
        return ["feature_extractor" if s.kind == "features" else s.role for s in self.stages]

    def latency_us(self) -> int:
        return sum(s.latency_us() for s in self.stages if s.enabled)

    def meets_latency(self) -> bool:
        return self.latency_us() <= self.max_latency_ms * 1000

    def validate(self) -> None:
        if not self.name:
            raise ValueError("a pipeline needs a name")
        if self.max_latency_ms <= 0:
            raise ValueError("the latency limit must be positive")
        if not self.stages:
            raise ValueError("a pipeline needs a stage")
        for s in self.stages:
            if s.kind == "nested":
                s.inner.validate()

    def export(self) -> dict:
        """Everything that makes the pipeline, for JSON."""
        stages = [{"name": s.name, "kind": s.kind, "params": dict(s.params), "enabled": s.enabled} | s.more() for s in self.stages]
        rest = {k: getattr(self, k) for k in ("name", "bypass_on_error", "max_latency_ms", "cascade", "allow_bandpass", "enabled")}
        return rest | {"stages": stages, "latency_us": self.latency_us()}

    @staticmethod
    def restore(d: dict, own: dict[str, Own] | None = None) -> Pipeline:
        """The pipeline that ``export`` described; ``own`` has the functions of users' stages by name."""

        def stage(s: dict) -> Stage:
            inner = Pipeline.restore(s["inner"], own) if "inner" in s else None
            fallback = stage(s["fallback"]) if "fallback" in s else None
            return Stage(s["kind"], tuple(s["params"].items()), s["name"], s["enabled"], (own or {}).get(s["name"]), inner=inner, fallback=fallback, role=s.get("role", "filter"))

        stages = tuple(map(stage, d["stages"]))
        return Pipeline(d["name"], stages, *(d[k] for k in ("bypass_on_error", "max_latency_ms", "cascade", "allow_bandpass")), d.get("enabled", True))

    # running
    def normalised(self, rate: float) -> tuple[list[Stage | list[Stage]], list[str]]:
        """Steps of the plan, neighbouring recursive filters as a list, and warnings."""
        steps: list = []
        warnings = []

        def put(s: Stage) -> None:
            if s.kind in RECURSIVE and steps and isinstance(steps[-1], list):
                steps[-1].append(s)
            else:
                steps.append([s] if s.kind in RECURSIVE else s)

        for s in (s for s in self.stages if s.enabled):
            try:
                if s.kind == "nested":
                    found, said = s.inner.normalised(rate) if s.inner.enabled else ([], [])
                    warnings += [f"{s.name}/{w}" for w in said]
                    if not s.inner.meets_latency():
                        warnings.append(f"{s.name}: {s.inner.latency_us()} us are more than its {s.inner.max_latency_ms} ms")
                    for x in (x for step in found for x in (step if isinstance(step, list) else [step])):
                        put(replace(x, name=f"{s.name}/{x.name}", cascade=s.inner.cascade if x.cascade is None else x.cascade))
                    continue
                s.check(rate, self.cascade, self.allow_bandpass)
            except (DesignError, ValueError) as e:
                if s.fallback is not None:
                    s.fallback.check(rate, self.cascade, self.allow_bandpass)
                    warnings.append(f"{s.fallback.name} in place of {s.name}: {e}")
                    put(s.fallback)
                    continue
                if not self.bypass_on_error:
                    raise
                warnings.append(f"{s.name} bypassed: {e}")
                continue
            put(s)
        return steps, warnings

    def sections(self, rate: float) -> list[Section]:
        """Sections of all recursive stages: what a stream keeps state for."""
        return [x for step in self.normalised(rate)[0] if isinstance(step, list) for s in step for x in s.sections(rate, self.cascade)]

    def apply(self, samples: DataFrame, rate: float = 1000.0, watch: Callable[[str, DataFrame], DataFrame] | None = None) -> Result:
        """The pipeline over a samples table of one sampling rate; one that isn't enabled hands samples on.

        ``watch`` gets the samples that go in (as "input") and those after each step, by the names of its stages joined
        with "+", and gives them back: ``metrics.Watch`` counts them in the one run.
        """
        steps, warnings = self.normalised(rate) if self.enabled else ([], [])
        watch = watch or (lambda name, df: df)
        now, found = watch("input", samples.withColumn("x_raw", F.col("x"))), []
        for step in steps:
            was = now
            if isinstance(step, list):
                now = filters.recursive(now, [x for s in step for x in s.sections(rate, self.cascade)], rate)
            elif step.kind == "features":
                p = dict(step.params)
                found.append(features.features(now, p["size"], p["overlap"], rate, p["enabled"]))
            elif step.kind == "own":
                now = step.own(now, rate)
            else:
                now = {"moving_average": filters.moving_average, "median": filters.median_filter}[step.kind](now, dict(step.params)["size"])
            if now is not was:
                now = watch("+".join(s.name for s in (step if isinstance(step, list) else [step])), now)
        return Result(now, found, warnings, [s.name for step in steps for s in (step if isinstance(step, list) else [step])])


def pipeline(name: str) -> Pipeline:
    return Pipeline(name)


# The ready-made pipelines.
def emg_preprocessing() -> Pipeline:
    """Needs a rate above 1000 Hz: its low-pass at 500 Hz must lie below half of it."""
    return pipeline("emg_preprocessing").add("highpass", cutoff=10.0, order=4).add("lowpass", cutoff=500.0, order=4).add("notch", frequency=50.0, q=30.0)


def realtime() -> Pipeline:
    return pipeline("realtime").add("highpass", cutoff=20.0, order=2).add("notch", frequency=50.0, q=10.0).bypass()


def research() -> Pipeline:
    out = pipeline("research").add("highpass", cutoff=10.0, order=6).add("lowpass", cutoff=450.0, order=6)
    return out.add("notch", frequency=50.0, q=50.0).add("notch", frequency=60.0, q=50.0).add("features", size=1024)


def comprehensive() -> Pipeline:
    return pipeline("comprehensive").add_stages(emg_preprocessing()).add("features", size=512)


@dataclass(frozen=True)
class Entry:
    """A stage of a runtime configuration, by the name of its processor."""

    name: str
    processor: str
    kind: str
    params: tuple[tuple[str, object], ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class RuntimeConfig:
    """A pipeline as the live service stores it: ``pipeline`` turns it into stages, with the parameters given or the usual ones."""

    name: str
    entries: tuple[Entry, ...]
    enabled: bool = True
    bypass_on_error: bool = False
    max_latency_ms: float = 10.0

    def validate(self) -> None:
        if not self.name:
            raise ValueError("a pipeline needs a name")
        if self.max_latency_ms <= 0:
            raise ValueError("the latency limit must be positive")
        if not self.entries:
            raise ValueError("a pipeline needs a stage")
        for e in self.entries:
            if not e.processor or not e.name:
                raise ValueError("every stage needs a name")
            if e.kind not in ("filter", "feature_extractor"):
                raise ValueError(f"{e.name}: unknown kind {e.kind!r}")

    def enable(self, name: str, on: bool = True) -> RuntimeConfig:
        if name not in {e.name for e in self.entries}:
            raise KeyError(f"configuration {self.name} has no stage {name!r}")
        return replace(self, entries=tuple(replace(e, enabled=on) if e.name == name else e for e in self.entries))

    def pipeline(self) -> Pipeline:
        self.validate()
        out = Pipeline(self.name, (), self.bypass_on_error, self.max_latency_ms, enabled=self.enabled)
        for e in self.entries:
            if e.processor not in USUAL:
                raise ValueError(f"{e.name}: unknown processor {e.processor!r}")
            out = out.add(e.processor, e.name, **{**USUAL[e.processor], **dict(e.params)}).enable(e.name, e.enabled)
        return out


# Parameters of processors that a runtime configuration doesn't give, and the ready-made configurations.
USUAL = {"highpass": {"cutoff": 20.0}, "lowpass": {"cutoff": 450.0}, "notch": {"frequency": 50.0, "q": 30.0}, "features": {"size": 256}}


def default_emg() -> RuntimeConfig:
    filters_ = [Entry(f"{n} Filter", n.lower(), "filter") for n in ("Highpass", "Lowpass", "Notch")]
    return RuntimeConfig("Default EMG", (*filters_, Entry("Feature Extractor", "features", "feature_extractor")))


def realtime_emg() -> RuntimeConfig:
    entries = tuple(Entry(f"{n} Filter", n.lower(), "filter") for n in ("Highpass", "Notch"))
    return RuntimeConfig("Real-time EMG", entries, bypass_on_error=True, max_latency_ms=5.0)


@dataclass(frozen=True)
class ServiceSpec:
    """What a user of the live service chooses; ``pipeline_for`` turns it into stages."""

    kind: str = "standard"
    filters: bool = True
    features: bool = False
    highpass: float = 20.0
    lowpass: float = 450.0
    notch: float = 50.0
    size: int = 256
    overlap: float = 0.5


def pipeline_for(s: ServiceSpec) -> Pipeline:
    """bypass has no stage, realtime never any features; research only takes the low-pass from the user."""
    out = pipeline(s.kind)
    if s.kind not in ("bypass", "realtime", "standard", "research"):
        raise ValueError(f"unknown kind of pipeline {s.kind!r}")
    if s.kind in ("bypass", "realtime"):
        out = out.bypass()
    if s.filters and s.kind == "realtime":
        out = out.add("highpass", cutoff=s.highpass, order=2).add("notch", frequency=s.notch, q=10.0)
    if s.filters and s.kind == "standard":
        out = out.add("highpass", cutoff=s.highpass, order=4).add("lowpass", cutoff=s.lowpass, order=4).add("notch", frequency=s.notch, q=30.0)
    if s.filters and s.kind == "research":
        out = out.add("highpass", cutoff=10.0, order=6).add(
            "lowpass", cutoff=s.lowpass, order=6
        ).add("notch", frequency=50.0, q=50.0).add("notch", frequency=60.0, q=50.0)
    if s.features and s.kind in ("standard", "research"):
        out = out.add("features", size=s.size if s.kind == "standard" else 512, overlap=s.overlap)
    return out
