"""What processing took, and whether it kept to its limits: timers of steps, measured stages of a pipeline, summaries."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from sparkwave.operators.reshape import signal_quality
from sparkwave.plans.profiles import Constraints
from sparkwave.plans.spec import Pipeline, Stage


@dataclass
class Metrics:
    """Of one step. Qualities lie between 0 and 1."""

    processing_time_us: int = 0
    memory_bytes: int = 0
    input_quality: float = 1.0
    output_quality: float = 1.0
    success: bool = True
    error: str | None = None

    def meets(self, limits: Constraints) -> bool:
        return limits.met_by(self.processing_time_us, self.memory_bytes, success=self.success)


class Timer:
    """``with Timer() as t: …``: t.metrics has the time taken; an exception makes it a failure and goes on."""

    def __init__(self):
        self.metrics = Metrics()

    def __enter__(self) -> Timer:
        self.began = time.perf_counter()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.metrics.processing_time_us = int((time.perf_counter() - self.began) * 1e6)
        if error is not None:
            self.metrics.success, self.metrics.error = False, str(error) or kind.__name__

    def memory(self, n: int) -> None:
        """What the step has taken, as its maker knows or has measured it; Spark doesn't tell it of one step."""
        self.metrics.memory_bytes = max(0, int(n))

    def quality(self, before: float | None = None, after: float | None = None) -> None:
        """Scores outside 0 to 1 are taken to the nearer end."""
        clamp = lambda v: min(1.0, max(0.0, v))
        if before is not None:
            self.metrics.input_quality = clamp(before)
        if after is not None:
            self.metrics.output_quality = clamp(after)


@dataclass(frozen=True)
class Performance:
    total_us: int
    mean_us: int
    success_rate: float
    steps: int


def summary(metrics: Iterable[Metrics]) -> Performance:
    """Of nothing: no time, all successful."""
    seen = list(metrics)
    total = sum(m.processing_time_us for m in seen)
    return Performance(total, total // len(seen) if seen else 0, sum(m.success for m in seen) / len(seen) if seen else 1.0, len(seen))


def quality(samples: DataFrame) -> float:
    """Share of all samples that are numbers; 1 without a sample."""
    row = signal_quality(samples).selectExpr("sum(n * quality) / sum(n) as q").head()
    return 1.0 if row.q is None else float(row.q)


def measured(pipeline: Pipeline, samples: DataFrame, rate: float = 1000.0, qualities: bool = False) -> dict[str, Metrics]:
    """Runs each enabled stage over ``samples`` and times it: a stage's time is what the plan up to it takes beyond the plan before.

    For tuning: Spark fuses stages, so the pipeline as a whole is faster than the sum. A stage that fails is a failure
    in its metrics and is left out of what follows.
    """

    def run(stages: tuple[Stage, ...]) -> DataFrame:
        result = Pipeline(pipeline.name, stages, False, pipeline.max_latency_ms, pipeline.cascade, pipeline.allow_bandpass).apply(samples, rate)
        out = result.features[-1] if stages and stages[-1].kind == "features" else result.samples
        out.write.format("noop").mode("overwrite").save()
        return result.samples

    with Timer() as scan:
        run(())
    before, kept, found = scan.metrics.processing_time_us, (), {}
    score = quality(samples) if qualities else 1.0
    for stage in (s for s in pipeline.stages if s.enabled):
        timer, now = Timer(), None
        try:
            with timer:
                now = run((*kept, stage))
        except Exception:  # noqa: BLE001  it is in the stage's metrics
            found[stage.name] = timer.metrics
            continue
        whole = timer.metrics.processing_time_us
        timer.metrics.processing_time_us = max(0, whole - before)
        timer.quality(score, quality(now) if qualities else None)
        found[stage.name] = timer.metrics
        if stage.kind != "features":
            before, kept, score = whole, (*kept, stage), timer.metrics.output_quality
    return found


class Watch:
    """Counts rows and numbers after every step of a pipeline in the one run of its plan, whatever action that is.

    ``result = pipeline.apply(samples, rate, watch := Watch())``; after an action on ``result.samples``, ``watch.metrics()``
    has the qualities before and after each step, and ``watch.rows`` its rows. Steps are fused by Spark, so there is
    no time of one step: ``took`` is the time from the plan to the first call of ``metrics``.
    """

    def __init__(self):
        self.seen: dict[str, Observation] = {}
        self.began, self.took, self.rows = time.perf_counter(), 0.0, {}

    def __call__(self, name: str, samples: DataFrame) -> DataFrame:
        if samples.isStreaming:
            return samples.observe(f"{name}", *_counts())
        self.seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        return samples.observe(self.seen[name], *_counts())

    def metrics(self) -> dict[str, Metrics]:
        """By step, once an action has run; waits for it otherwise."""
        found = {name: seen.get for name, seen in self.seen.items()}
        self.took = self.took or time.perf_counter() - self.began
        self.rows = {name: f["rows"] for name, f in found.items()}
        score = {name: f["numbers"] / f["rows"] if f["rows"] else 1.0 for name, f in found.items()}
        names = list(found)
        return {name: Metrics(0, 0, score[before], score[name]) for before, name in zip(names, names[1:])}


def _counts() -> list:
    number = F.coalesce(F.abs("x") < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce("x", F.lit(0.0)))
    return [F.count(F.lit(1)).alias("rows"), F.count(F.when(number, 1)).alias("numbers")]


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` progress reports of every query: ``spark.streams.addListener(progress)``."""

    def __init__(self, most: int = 10_000):
        self.most, self.reports = most, {}

    def onQueryStarted(self, event) -> None:
        self.reports.setdefault(str(event.id), deque(maxlen=self.most))

    def onQueryProgress(self, event) -> None:
        self.reports.setdefault(str(event.progress.id), deque(maxlen=self.most)).append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query_id) -> list[dict]:
        return list(self.reports.get(str(query_id), ()))

    def slow_batches(self, query_id, limit_ms: float) -> list[str]:
        """Advice, not an error: micro-batches that took more than twice the limit, however long ago."""
        return [f"batch {p['batchId']} took {p['batchDuration']} ms, more than twice {limit_ms} ms" for p in self.of(query_id) if p["batchDuration"] > 2 * limit_ms]

    def quality(self, query_id, name: str) -> float:
        """Share of the samples that ``Watch`` has counted under ``name`` in a stream that are numbers; 1 without any."""
        found = [p["observedMetrics"][name] for p in self.of(query_id) if name in (p.get("observedMetrics") or {})]
        rows = sum(f["rows"] for f in found)
        return sum(f["numbers"] for f in found) / rows if rows else 1.0
