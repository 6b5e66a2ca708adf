"""Live signals with Structured Streaming: a source, filters that keep state by channel, windows, and control.

A stream through these gives what the batch operators give for the whole signal: chunks in order are the signal.
Nothing is lost when a consumer is slow; the source waits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkwave.operators import features
from sparkwave.operators.design import Section
from sparkwave.operators.filters import Cascade, carried, median_filter, moving_average
from sparkwave.plans.spec import Pipeline
from sparkwave.session import importable
from sparkwave.sources.emg import Emg
from sparkwave.sources.samples import KEY, indexed
from sparkwave.streaming.fanout import Folder

OUT = "signal_id string, channel int, idx long, t double, x_raw double, x double"


def emg_stream(spark: SparkSession, emg: Emg, chunks_per_second: int = 10, chunk_seconds: float = 0.1, signal_id: str = "emg") -> DataFrame:
    """A stream of samples: each tick of the rate source brings one chunk. t comes from idx, so it doesn't drift."""
    n = max(1, round(chunk_seconds * emg.rate))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", chunks_per_second).load()
    return emg.fill(ticks.select(F.explode(F.sequence(F.col("value") * n, F.col("value") * n + (n - 1))).alias("idx")), signal_id)


def stream_cascade(stream: DataFrame, sections: list[Section], order: list[str], rate: float = 1000.0) -> DataFrame:
    """Filters a stream of (signal_id, channel, x, ``order`` columns): each channel keeps the cascade's state and its sample count.

    Within a micro-batch samples are sorted by ``order``; across micro-batches the source's order holds. idx is counted
    here. A channel that appears later starts from rest. Null samples count as 0, NaN and infinity as in
    ``filters.recursive``. One task has a channel's rows of a micro-batch: for live signals. ``BlockSink`` spreads them.
    """
    importable(stream.sparkSession)
    system = Cascade(sections) if sections else None
    kept = ["signal_id", "channel", *order, F.coalesce("x", F.lit(0.0)).alias("x"), F.col("x").isNull().alias("_null")]  # pandas can't tell null from NaN

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        seen, s = (state.get[0], np.array(state.get[1], float)) if state.exists else (0, np.zeros(system.size if system else 0))
        x, null = rows["x"].to_numpy(float), rows["_null"].to_numpy(bool)
        y = x.copy()
        for at in range(0, len(x) if system else 0, system.length if system else 1):
            part = x[at : at + system.length]
            out, after = system.run(part[None, :], np.array([len(part)]), s[None, :])
            y[at : at + len(part)], s = out[0], after[0]
        idx = seen + np.arange(len(x))
        state.update((int(seen + len(x)), s.tolist()))
        yield pd.DataFrame({"signal_id": key[0], "channel": key[1], "idx": idx, "t": idx / rate, "x_raw": x, "x": y, "_null": null})

    done = stream.select(*kept).groupBy("signal_id", "channel").applyInPandasWithState(
        run, OUT + ", _null boolean", "seen long, s array<double>", "append", GroupStateTimeout.NoTimeout
    )
    value = lambda c: F.coalesce(c, F.lit(float("nan")))  # noqa: E731  NaN comes back as null
    raw = F.when(~F.col("_null"), value("x_raw"))
    return done.select("signal_id", "channel", "idx", "t", raw.alias("x_raw"), (value("x") if sections else raw).alias("x"))


class BlockSink:
    """For foreachBatch: filters micro-batches of any size as a block scan and writes them; no task has a whole channel.

    ``out``, in shared storage, gets a folder of rows (OUT) for each micro-batch, and each channel's sample count and
    cascade state after it, of the last two micro-batches. One that is run again starts from the same states and replaces its folder.
    Columns, sorting and idx are as in ``stream_cascade``; ``bucket`` is a column that rises with ``order``.
    """

    def __init__(self, sections: list[Section], order: list[str], bucket: Column, out: str, rate: float = 1000.0):
        self.sections, self.order, self.bucket, self.out, self.rate = sections, order, bucket, out.rstrip("/"), rate

    def rows(self, spark: SparkSession) -> DataFrame:
        """What has been written; empty if nothing was read."""
        return spark.read.schema(OUT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.out}/rows")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        states = "signal_id string, channel int, seen long, state array<double>"
        was = spark.read.schema(states).parquet(f"{self.out}/states/{number - 1}") if number else spark.createDataFrame([], states)
        placed = indexed(batch, KEY, self.order, self.bucket).select(
            "signal_id", "channel", "idx", (F.col("idx") / F.lit(self.rate)).alias("t"), F.col("x").cast("double").alias("x")
        )
        raw = placed.withColumn("x_raw", F.col("x"))
        done = carried(raw, self.sections, self.rate, was) if self.sections else raw.withColumn("state", F.array().cast("array<double>"))
        before = was.select(*KEY, F.col("seen").alias("_seen"))
        idx = F.coalesce("_seen", F.lit(0)) + F.col("idx")
        done = done.join(before, KEY, "left").select(
            "signal_id", "channel", idx.cast("long").alias("idx"), (idx / F.lit(self.rate)).alias("t"), "x_raw", "x", "state"
        )
        done.write.mode("overwrite").parquet(f"{self.out}/rows/{number}")
        written = spark.read.schema(OUT + ", state array<double>").parquet(f"{self.out}/rows/{number}")
        ends = written.where("state is not null").groupBy(*KEY).agg((F.max("idx") + 1).alias("seen"), F.max_by("state", "idx").alias("state"))
        both = ends.unionByName(was.join(ends.select(*KEY), KEY, "left_anti").select(*ends.columns))
        both.write.mode("overwrite").parquet(f"{self.out}/states/{number}")
        _forget(spark, f"{self.out}/states", number - 1)


def _forget(spark: SparkSession, path: str, least: int) -> None:
    """Deletes the folders of micro-batches before number ``least``: none of them comes again."""
    folder = Folder(spark, path)
    for name in folder.names():
        if name.isdigit() and int(name) < least:
            folder.delete(name)


class PipelineSink:
    """For foreachBatch: a whole pipeline over micro-batches of any size, with what each stage must remember of a channel.

    Recursive filters keep their state, moving averages and medians the samples they look back at, feature stages the
    samples of windows that aren't full yet: the written rows and features are those of the batch pipeline. Under
    ``out``, in shared storage, each micro-batch has a folder of its own in ``rows`` (OUT and success) and, for each
    feature stage, in ``features-0``, …; one that is run again starts from the same memory and replaces them.

    A micro-batch that fails is written raw with success false if the pipeline allows bypass, and raises otherwise.
    While ``bypass`` is set, rows are written raw and nothing is remembered. Columns and idx are as in ``BlockSink``.
    A user's own stage gets a micro-batch's samples only: one that looks back differs from batch where a micro-batch begins.
    Working folders are deleted once a micro-batch is written; what is remembered is kept for the last two.
    """

    def __init__(self, pipeline: Pipeline, order: list[str], bucket: Column, out: str, rate: float = 1000.0, bypass: bool = False):
        self.pipeline, self.order, self.bucket, self.out, self.rate, self.bypass = pipeline, order, bucket, out.rstrip("/"), rate, bypass
        self.steps, self.warnings = pipeline.normalised(rate) if pipeline.enabled else ([], [])
        self.errors: list[str] = []

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._all(spark, "rows", OUT + ", success boolean")

    def features(self, spark: SparkSession, stage: int = 0) -> DataFrame:
        """Rows of the feature stage number ``stage``."""
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.out}/features-{stage}")

    def _all(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.out}/{name}")

    def _saved(self, df: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.out}/{name}/{number}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _memory(self, spark: SparkSession, name: str, number: int, schema: str) -> DataFrame:
        """What was remembered before micro-batch ``number``."""
        return spark.read.schema(schema).parquet(f"{self.out}/{name}/{number - 1}") if number else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        was = self._memory(spark, "seen", number, "signal_id string, channel int, seen long")
        placed = indexed(batch, KEY, self.order, self.bucket).select(*KEY, "idx", F.col("x").cast("double").alias("x"))
        before = was.withColumnRenamed("seen", "_seen")
        idx = (F.coalesce("_seen", F.lit(0)) + F.col("idx")).cast("long")
        placed = placed.join(before, KEY, "left").select(*KEY, idx.alias("idx"), (idx / F.lit(self.rate)).alias("t"), F.col("x").alias("x_raw"), "x")
        placed = self._saved(placed, "placed", number)
        now = placed.groupBy(*KEY).agg((F.max("idx") + 1).alias("seen"))
        seen = self._saved(now.unionByName(was.join(now, KEY, "left_anti")), "seen", number)
        done, found = placed, []
        if not self.bypass:
            try:
                for i, step in enumerate(self.steps):
                    done = self._step(i, step, done, was, seen, number, found)
                for i, rows in enumerate(found):  # all steps have gone well
                    self._saved(rows, f"features-{i}", number)
                self._saved(done.select(*KEY, "idx", "t", "x_raw", "x").withColumn("success", F.lit(True)), "rows", number)
                self._tidy(spark, number)
                return
            except Exception as e:
                for i in range(len(found)):
                    Folder(spark, f"{self.out}/features-{i}").delete(str(number))
                self.errors.append(f"batch {number}: {e}")
                if not self.pipeline.bypass_on_error:
                    raise
        for i, step in enumerate(self.steps):  # what was remembered stays
            if not isinstance(step, list) and step.kind == "own":
                continue
            self._saved(self._memory(spark, f"memory-{i}", number, STATE if isinstance(step, list) else TAIL), f"memory-{i}", number)
        self._saved(placed.withColumn("success", F.lit(self.bypass)), "rows", number)
        self._tidy(spark, number)

    def _tidy(self, spark: SparkSession, number: int) -> None:
        for i in range(len(self.steps)):
            Folder(spark, f"{self.out}/step-{i}").delete()
            _forget(spark, f"{self.out}/memory-{i}", number - 1)
        Folder(spark, f"{self.out}/placed").delete()
        _forget(spark, f"{self.out}/seen", number - 1)

    def _step(self, i: int, step, samples: DataFrame, was: DataFrame, seen: DataFrame, number: int, features_: list[DataFrame]) -> DataFrame:
        spark, memory = samples.sparkSession, f"memory-{i}"
        if isinstance(step, list):
            start = self._memory(spark, memory, number, STATE)
            sections = [x for s in step for x in s.sections(self.rate, self.pipeline.cascade)]
            done = self._saved(carried(samples, sections, self.rate, start), f"step-{i}", number)
            ends = done.where("state is not null").groupBy(*KEY).agg(F.max_by("state", "idx").alias("state"))
            self._saved(ends.unionByName(start.join(ends.select(*KEY), KEY, "left_anti")), memory, number)
            return done.drop("state")
        if step.kind == "own":
            return step.own(samples, self.rate)
        size = dict(step.params)["size"]
        tail = self._memory(spark, memory, number, TAIL)
        both = self._saved(
            samples.withColumn("_new", F.lit(True)).unionByName(tail.withColumn("_new", F.lit(False)), allowMissingColumns=True),
            f"step-{i}",
            number
        )
        end = seen.withColumnRenamed("seen", "_end")
        self._saved(both.join(end, KEY).where(F.col("idx") > F.col("_end") - size).select(*KEY, "idx", "x"), memory, number)
        if step.kind == "features":
            p = dict(step.params)
            before = was.withColumnRenamed("seen", "_seen")
            found = features.features(both.select(*KEY, "idx", "x"), p["size"], p["overlap"], self.rate, p["enabled"])
            found = found.join(before, KEY, "left").where(F.col("end_sample") > F.coalesce("_seen", F.lit(0))).drop("_seen")
            features_.append(found)
            return samples
        return {"moving_average": moving_average, "median": median_filter}[step.kind](both, size).where("_new").drop("_new")


#: What is remembered of a channel: a cascade's state, or its last samples.
STATE, TAIL = "signal_id string, channel int, state array<double>", "signal_id string, channel int, idx long, x double"


def stream_pipeline(stream: DataFrame, pipeline: Pipeline, order: list[str], rate: float = 1000.0) -> DataFrame:
    """The recursive filters of a pipeline over a stream, as one cascade. ``PipelineSink`` takes any pipeline."""
    others = [s.name for s in pipeline.stages if s.enabled and s.kind in ("moving_average", "median", "own")]
    if others:
        raise ValueError(f"{others} aren't recursive filters; use a PipelineSink")
    return stream_cascade(stream, pipeline.sections(rate), order, rate)


def chunk_metrics(processed: DataFrame, turns: int = 100) -> DataFrame:
    """Of each signal: chunks, samples, rate of chunks without a null or non-finite output."""
    good = F.coalesce(F.abs("x") < F.lit(float("inf")), F.lit(False)) & ~F.isnan("x")
    per = processed.groupBy("signal_id", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg(F.count("*").alias("n"), F.min(good).alias("ok"))
    return per.groupBy("signal_id").agg(F.count("*").alias("chunks"), F.sum("n").alias("samples"), F.avg(F.col("ok").cast("double")).alias("success_rate"))


class Breaker:
    """Wraps a stage: after more than ``most`` failures in a row the input passes unchanged; a success resets the count."""

    def __init__(self, stage: Callable[[DataFrame], DataFrame], most: int = 3):
        self.stage, self.most, self.failures = stage, most, 0

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.failures > self.most:
            return df
        try:
            out = self.stage(df)
        except Exception:
            self.failures += 1
            if self.failures > self.most:
                return df
            raise
        self.failures = 0
        return out


@dataclass
class Live:
    """Controls one streaming query. ``make`` builds the stream from a specification, ``checkpoint`` is in shared storage.

    pause keeps the checkpoint, so resume goes on with the filters' state. stop, and a new specification, begin
    from zero state under a new checkpoint.
    """

    make: Callable[[object], DataFrame]
    spec: object
    sink: Callable[[DataFrame, int], None]
    checkpoint: str
    trigger: dict = field(default_factory=lambda: {"processingTime": "1 second"})
    version: int = 0
    query: StreamingQuery | None = None

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def start(self) -> StreamingQuery:
        if not self.running:
            writer = self.make(self.spec).writeStream.foreachBatch(self.sink).option("checkpointLocation", f"{self.checkpoint}/v{self.version}")
            self.query = writer.trigger(**self.trigger).start()
        return self.query

    resume = start

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()

    def stop(self) -> None:
        self.pause()
        self.version += 1

    def update(self, spec: object) -> None:
        """Takes effect at once: a running query starts anew."""
        was = self.running
        self.stop()
        self.spec = spec
        if was:
            self.start()

    def stats(self) -> dict:
        """Batches, input rows and rows a second of the query so far, from its progress reports."""
        seen = list(self.query.recentProgress) if self.query is not None else []
        rows = sum(p["numInputRows"] for p in seen)
        return {"running": self.running, "batches": len(seen), "rows": rows, "rows_per_second": seen[-1]["processedRowsPerSecond"] if seen else 0.0}

    def slow_batches(self, limit_ms: float) -> list[str]:
        """Advice, not an error: micro-batches that took more than twice the limit."""
        seen = list(self.query.recentProgress) if self.query is not None else []
        return [f"batch {p['batchId']} took {p['batchDuration']} ms, more than twice {limit_ms} ms" for p in seen if p["batchDuration"] > 2 * limit_ms]


class Fleet:
    """Controls several queries by name: one source to several sinks, or several signals."""

    def __init__(self, **queries: Live):
        self.queries = dict(queries)

    def __getitem__(self, name: str) -> Live:
        return self.queries[name]

    def add(self, name: str, query: Live) -> None:
        if name in self.queries:
            raise ValueError(f"there is a query {name!r} already")
        self.queries[name] = query

    def start(self, *names: str) -> None:
        for n in names or self.queries:
            self.queries[n].start()

    def pause(self, *names: str) -> None:
        for n in names or self.queries:
            self.queries[n].pause()

    def stop(self, *names: str) -> None:
        for n in names or self.queries:
            self.queries[n].stop()

    def wait(self) -> None:
        """Until every running query has ended."""
        for q in self.queries.values():
            if q.query is not None:
                q.query.awaitTermination()

    def stats(self) -> dict[str, dict]:
        return {n: q.stats() for n, q in self.queries.items()}
