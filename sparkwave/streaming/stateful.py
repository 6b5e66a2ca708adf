"""Live channels in Spark's state store: filters and sliding windows remember what they need, and forget silent channels.

Each channel's sample count, filter states and last samples are value and list state of a stateful processor: no
folders, no broadcasts, and a million channels are spread over all tasks of a micro-batch. A channel that is silent for longer
than ``silence`` starts again from rest, however its rows fall into micro-batches; a timer frees its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwave.operators import sliding
from sparkwave.operators.filters import Cascade
from sparkwave.plans.spec import Pipeline
from sparkwave.session import importable

OUT = "signal_id string, channel int, since timestamp, idx long, t double, x_raw double, x double, is_null boolean, is_nan boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What ``initial`` has of a channel: samples so far, time of the last one, states of the recursive filters one after the other.
INITIAL = "signal_id string, channel int, seen long, last timestamp, since timestamp, states array<double>"


class Memory:
    """What is remembered of one channel, outside the store."""

    def __init__(self, steps: list):
        self.seen, self.since = 0, None
        self.of = [np.zeros(s.size) if isinstance(s, Cascade) else (np.empty(0), np.empty(0, bool)) for s in steps]


class Channels(StatefulProcessor):
    """``plan``: lists of sections, or (kind, size) of windows; ``silence`` in milliseconds, or None for ever."""

    def __init__(self, plan: list, order: list[str], rate: float, time: str | None, silence: int | None):
        self.plan, self.order, self.rate, self.time, self.silence = plan, order, rate, time, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = [Cascade(s) if isinstance(s, list) else s for s in self.plan]  # matrices are made where they are used
        self.place = handle.getValueState("place", "seen long, last long, since long, states array<double>")
        self.tails = handle.getListState("tails", "step int, x double, there boolean")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            last, since = (ms(v) for v in (row.last, row.since))
            self.place.update((int(row.seen), last, since, [float(v) for v in row.states]))
            if self.silence is not None:
                self.handle.registerTimer(last + self.silence)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(self.order)
        x, null = table["x"].to_numpy(float), table["is_null"].to_numpy(bool)
        at = table["at_ms"].to_numpy(np.int64) if self.time else np.zeros(len(x), np.int64)
        memory, last = self.remembered()
        gaps = np.diff(at, prepend=at[0] if last is None else last)
        cuts = [0, *(np.flatnonzero(gaps > self.silence).tolist() if self.silence is not None else []), len(x)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if begin or memory.since is None or self.silence is not None and gaps[0] > self.silence:
                memory = Memory(self.steps)
                memory.since = int(at[begin])
            y, there = self.through(memory, x[begin:end], ~null[begin:end])
            idx = memory.seen + np.arange(end - begin)
            memory.seen += end - begin
            since = pd.Timestamp(memory.since, unit="ms") if self.time else pd.NaT
            yield pd.DataFrame(
                {"signal_id": key[0], "channel": key[1], "since": pd.Series([since] * len(idx), dtype="datetime64[ns]"), "idx": idx, "t": idx / self.rate, "x_raw": x[begin:end], "x": y}
            ).assign(is_null=null[begin:end], is_nan=there & np.isnan(y))
        self.keep(memory, int(at[-1]))

    def remembered(self) -> tuple[Memory, int | None]:
        memory = Memory(self.steps)
        if not self.place.exists():
            return memory, None
        memory.seen, last, memory.since, states = self.place.get()
        states = np.array([np.nan if v is None else v for v in states], float)
        held: dict[int, list] = {}
        for step, v, there in self.tails.get():
            held.setdefault(step, []).append((np.nan if v is None else v, there))
        for i, step in enumerate(self.steps):
            if isinstance(step, Cascade):
                memory.of[i], states = states[: step.size], states[step.size :]
            elif i in held:
                memory.of[i] = np.array([v for v, _ in held[i]]), np.array([t for _, t in held[i]])
        return memory, last

    def keep(self, memory: Memory, last: int) -> None:
        states = [float(v) for s, m in zip(self.steps, memory.of) if isinstance(s, Cascade) for v in m]
        self.place.update((int(memory.seen), last, int(memory.since), states))
        tails = [(i, float(v), bool(t)) for i, (s, m) in enumerate(zip(self.steps, memory.of)) if not isinstance(s, Cascade) for v, t in zip(*m)]
        if tails:
            self.tails.put(tails)
        if self.silence is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(last + self.silence)

    def through(self, memory: Memory, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The samples after all steps, and which of them exist."""
        x = np.where(there, x, np.nan)
        for i, step in enumerate(self.steps):
            if isinstance(step, Cascade):
                x, y, s = np.where(there, x, 0.0), np.empty(len(x)), memory.of[i]
                for a in range(0, len(x), step.length):
                    part = x[a : a + step.length]
                    out, after = step.run(part[None, :], np.array([len(part)]), s[None, :])
                    y[a : a + len(part)], s = out[0], after[0]
                x, there, memory.of[i] = y, np.ones(len(y), bool), s
                continue
            kind, size = step
            before, real = memory.of[i]
            line, held = np.append(before, x), np.append(real, there)
            values, some = getattr(sliding, kind)(np.arange(len(line)), line, held, size)
            memory.of[i] = line[len(line) - min(len(line), size - 1) :], held[len(line) - min(len(line), size - 1) :]
            x, there = np.where(some, values, np.nan)[len(before) :], some[len(before) :]
        return x, there

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.tails.clear()
        yield from ()


def ms(v) -> int:
    return 0 if v is None or pd.isna(v) else int(pd.Timestamp(v).value // 1_000_000)


def stream_channels(
    stream: DataFrame,
    pipeline: Pipeline,
    order: list[str],
    rate: float = 1000.0,
    time: str | None = None,
    silence: float | None = None,
    late: str = "0 seconds",
    initial: DataFrame | None = None,
) -> DataFrame:
    """A pipeline's filters over a stream of (signal_id, channel, x, ``order`` columns): signal_id, channel, since, idx, t, x_raw, x.

    Across micro-batches the source's order holds, within one rows are sorted by ``order``. Recursive filters, moving
    averages and medians may follow each other in any order; other stages raise ValueError. With ``time`` (a timestamp
    column) and ``silence`` (seconds), a channel whose next sample comes later than that starts from rest: idx counts from
    0 again and ``since`` is the time of its first sample. Rows more than ``late`` behind the newest time seen are too late: Spark drops them and
    its progress reports count them. ``initial`` (columns INITIAL) are channels to go on with; their windows begin empty. Null samples,
    NaN and infinity are as in the batch operators. One task has a channel's rows of a micro-batch.

    Spark needs the RocksDB state store for this; the session's setting is changed to it if it names the default one.
    """
    spark = importable(stream.sparkSession)
    if silence is not None and time is None:
        raise ValueError("silence is measured on a time column")
    steps = []
    for step in pipeline.normalised(rate)[0] if pipeline.enabled else []:
        if isinstance(step, list):
            steps.append([x for s in step for x in s.sections(rate, pipeline.cascade)])
        elif step.kind in ("moving_average", "median"):
            steps.append(({"moving_average": "means", "median": "medians"}[step.kind], dict(step.params)["size"]))
        else:
            raise ValueError(f"{step.name} isn't a filter of samples")
    if not spark.conf.get(STORE).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKSDB)
    # Names of its own: a leading underscore gets lost on the way.
    rows = stream.withColumn("is_null", F.col("x").isNull()).withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(0.0)))
    columns = list(dict.fromkeys(["signal_id", "channel", *order, "x", "is_null"]))
    if time:
        rows = rows.withColumn("at_ms", F.unix_millis(F.col(time).cast("timestamp"))).withWatermark(time, late)
        columns += [c for c in (time, "at_ms") if c not in columns]
    start = {}
    if initial is not None:
        start["initialState"] = initial.select("signal_id", "channel", "seen", "last", "since", "states").groupBy("signal_id", "channel")
    done = rows.select(*columns).groupBy("signal_id", "channel").transformWithStateInPandas(
        Channels(steps, order, rate, time, None if silence is None else int(silence * 1000)), OUT, "append", "EventTime" if silence is not None else "None", **start
    )
    value = F.when(F.col("is_nan"), F.lit(float("nan"))).otherwise(F.col("x"))  # pandas can't tell null from NaN
    raw = F.when(~F.col("is_null"), F.coalesce("x_raw", F.lit(float("nan"))))
    return done.select("signal_id", "channel", "since", "idx", "t", raw.alias("x_raw"), value.alias("x"))
