"""Filters over samples tables: moving average and median by blocks with a halo, recursive filters as a block scan.

A recursive filter needs its own earlier output, but it is linear. With the cascade as a state space (the last two
inputs, and the last two outputs of every section), a block of L samples that starts from state s gives

    y = H x + Z s        and ends in state        P s + E x

with matrices that depend on the coefficients alone. So each block's E x is computed on its own; the small table of
those is folded into the state at each block's start; then each block's output follows. Blocks bound the memory of a
task, and a channel of any length is spread over all of them. The fold has two levels, the second over one row for
each ``GROUP`` blocks of a channel.

Samples count one after the other, whatever gaps idx has, so a block may hold fewer samples than its place allows; its
matrices are those of its number of samples. A matrix product would spread a NaN or an infinity over a whole block:
blocks with one, and those after it, are computed sample by sample, from where on outputs are what the recursion gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sparkwave.operators import sliding
from sparkwave.operators.blocks import by_block
from sparkwave.operators.design import Section
from sparkwave.session import importable
from sparkwave.sources.samples import COLUMNS

#: Samples of a block, and blocks of a group of the first fold.
LENGTH, GROUP = 256, 4096


def moving_average(samples: DataFrame, size: int, col: str = "x") -> DataFrame:
    """x becomes the mean of the last ``size`` samples, of as many as there are at the start; a gap in idx counts as missing samples.

    Null samples are left out, a window with a NaN has NaN. The work doesn't grow with ``size``.
    """
    _positive(size)
    return by_block(samples, size - 1, lambda idx, x, real: [sliding.means(idx, x, real, size)], [col], col)


def median_filter(samples: DataFrame, size: int, col: str = "x") -> DataFrame:
    """x becomes the median of the last ``size`` samples, of as many as there are at the start; a gap in idx counts as missing samples.

    Null samples are left out, NaN is above all others. The work doesn't grow with ``size``.
    """
    _positive(size)
    return by_block(samples, size - 1, lambda idx, x, real: [sliding.medians(idx, x, real, size)], [col], col)


def _positive(size: int) -> None:
    if size < 1:
        raise ValueError("the window must hold a sample at least")


def step(sections: list[Section], state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sample: (output, next state). State: last two inputs, then last two outputs of each section."""
    after, v = [x + np.zeros_like(state[0]), state[0]], x
    for j, (b0, b1, b2, a1, a2) in enumerate(sections):
        u1, u2, y1, y2 = state[2 * j], state[2 * j + 1], state[2 * j + 2], state[2 * j + 3]
        v = b0 * v + b1 * u1 + b2 * u2 - a1 * y1 - a2 * y2
        after += [v, y1]
    return v, np.array(after)


class Cascade:
    """The matrices of a cascade for blocks of up to ``length`` samples."""

    def __init__(self, sections: list[Section], length: int = LENGTH):
        d = 2 * len(sections) + 2
        zero, one = np.zeros(d), np.eye(d)
        basis = [step(sections, one[i], 0.0) for i in range(d)]
        self.a, self.c = np.array([s for _, s in basis]).T, np.array([y for y, _ in basis])
        direct, b = step(sections, zero, 1.0)
        self.sections, self.size, self.length = sections, d, length
        self.z, self.e = np.empty((length, d)), np.empty((d, length))
        row, col, impulse = self.c, b, np.empty(length)
        impulse[0] = direct
        for i in range(length):
            self.z[i], self.e[:, length - 1 - i] = row, col
            if i + 1 < length:
                impulse[i + 1] = row @ b
            row, col = row @ self.a, self.a @ col
        self.h = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(length)] for i in range(length)])
        self.powers: dict[int, np.ndarray] = {}

    def power(self, n: int) -> np.ndarray:
        """What ``n`` samples make of a state."""
        if n not in self.powers:
            if len(self.powers) > 4 * GROUP:
                self.powers.clear()
            self.powers[n] = np.linalg.matrix_power(self.a, n)
        return self.powers[n]

    def moved(self, state: np.ndarray, n: int, e: np.ndarray) -> np.ndarray:
        """The state ``n`` samples later, with ``e`` for what those bring; once not finite, all of it is NaN."""
        return self.power(n) @ state + e if np.isfinite(state).all() else np.full(self.size, np.nan)

    def run(self, x: np.ndarray, n: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and end states of blocks: rows of x, of which the first n samples count, from rows of states."""
        y, after = np.empty_like(x), np.empty_like(state)
        with np.errstate(invalid="ignore", over="ignore"):
            plain = ~(np.isfinite(x).all(axis=1) & np.isfinite(state).all(axis=1))
            for m in np.unique(n):
                at = np.flatnonzero((n == m) & ~plain)
                part, s = x[at, :m], state[at]
                y[at, :m] = part @ self.h[:m, :m].T + s @ self.z[:m].T
                after[at] = s @ self.power(int(m)).T + part @ self.e[:, self.length - m :].T
            if plain.any():
                at = np.flatnonzero(plain)
                s = state[at].T.copy()
                for i in range(int(n[at].max())):
                    out, s_next = step(self.sections, s, x[at, i])
                    going = i < n[at]
                    y[at[going], i] = out[going]
                    s = np.where(going, s_next, s)
                after[at] = s.T
        return y, after


def _arrays(table: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column as rows, filled up with zeros."""
    col = table.column(name)
    n, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def recursive(samples: DataFrame, sections: list[Section], rate: float) -> DataFrame:
    """x becomes the output of the cascade, every channel from rest.

    Null samples count as 0. From a NaN or infinite one on, outputs are NaN (or infinite, for a sample or two) as in the
    plain recursion; earlier ones aren't touched. Samples count in the order of idx, which may start anywhere and have
    gaps, and stays as it is. ``rate`` is the samples' rate, for which the sections were designed. Other columns stay.
    """
    return _scan(samples, sections, rate).select(*(f"`{c}`" for c in samples.columns)) if sections else samples


def carried(samples: DataFrame, sections: list[Section], rate: float, start: DataFrame) -> DataFrame:
    """``recursive`` from the states in ``start`` (signal_id, channel, state array<double>); channels that it lacks start from rest.

    With a further column ``state``: the cascade's after a block's last sample, null elsewhere. A channel's last row has one.
    """
    return _scan(samples, sections, rate, start).select(*(f"`{c}`" for c in samples.columns), "state")


def _fields(*names_types) -> StructType:
    return StructType([StructField(n, t) for n, t in names_types])


NAME, LONG, FLOATS = StringType(), LongType(), ArrayType(DoubleType())


def _scan(samples: DataFrame, sections: list[Section], rate: float, start: DataFrame | None = None) -> DataFrame:
    importable(samples.sparkSession)
    length = LENGTH
    system = Cascade(sections)
    of_channel = ("channel", samples.schema["channel"].dataType)
    key = [("signal_id", NAME), of_channel]

    # t isn't moved: it follows from idx. Further columns stay with their sample. idx leads the struct, so its order is the samples'.
    extra = [c for c in samples.columns if c not in COLUMNS]
    more = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)], F.lit(0).alias("_"))
    sample = F.struct("idx", F.coalesce("x", F.lit(0.0)).alias("x"), more.alias("more"))
    rows = samples.select("signal_id", "channel", F.expr(f"idx div {length}").alias("block"), sample.alias("s"))
    by_idx = [lambda a, b: (a["idx"] - b["idx"]).cast("int")] if "map<" in samples.select(*(f"`{c}`" for c in extra)).schema.simpleString() else []  # maps have no order
    held = rows.groupBy("signal_id", "channel", "block").agg(F.array_sort(F.collect_list("s"), *by_idx).alias("s"))
    blocks = held.select("signal_id", "channel", "block", "s.idx", "s.x", "s.more")
    kept, ending = blocks.schema["more"].dataType, start is not None

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, block = _arrays(b, "x"), b.column("block").to_numpy()
            n = np.diff(b.column("x").offsets.to_numpy())
            e = system.run(x, n, np.zeros((len(x), system.size)))[1]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("signal_id"),
                    b.column("channel"),
                    b.column("block"),
                    pa.array(block // GROUP),
                    pa.array(n, pa.int64()),
                    pa.array(list(e), pa.list_(pa.float64()))
                ],
                names=["signal_id", "channel", "block", "g", "n", "e"],
            )

    def fold(by: str, total: bool):
        """Rows of one group, by ``by``: the state before each, from rest (or from where the channel starts) at the group's start.

        ``total``: also the samples before each, and in the last row the group's samples and the state after it.
        """

        def run(pdf):
            pdf = pdf.sort_values(by)
            s, seen, before, places = np.zeros(system.size), 0, [], []
            if "state" in pdf and pdf["state"].iloc[0] is not None:
                s = np.array(pdf["state"].iloc[0], float)
            for e, n in zip(pdf["e"], pdf["n"]):
                before.append(s)
                places.append(seen)
                s, seen = system.moved(s, n, np.asarray(e, float)), seen + n
            out = pdf[["signal_id", "channel", by]].assign(s=before)
            if total:
                out["g"], out["n"], out["all"], out["e"] = pdf["g"], places, seen, [None] * (len(pdf) - 1) + [s]
            return out

        return run

    small = _fields(*key, ("block", LONG), ("g", LONG), ("n", LONG), ("e", FLOATS))
    folded = _fields(*key, ("block", LONG), ("s", FLOATS), ("g", LONG), ("n", LONG), ("all", LONG), ("e", FLOATS))
    first = blocks.select(
        "signal_id", "channel", "block", "x"
    ).mapInArrow(ends, small).groupBy("signal_id", "channel", "g").applyInPandas(fold("block", True), folded)
    groups = first.where("e is not null").select("signal_id", "channel", "g", F.col("all").alias("n"), "e")
    if ending:
        groups = groups.join(start.select("signal_id", "channel", "state"), ["signal_id", "channel"], "left")
    second = groups.groupBy("signal_id", "channel").applyInPandas(fold("g", False), _fields(*key, ("g", LONG), ("s", FLOATS)))
    states = first.select(
        "signal_id", "channel", "block", "g", "s", F.col("n").alias("seen")
    ).join(second.withColumnRenamed("s", "gs"), ["signal_id", "channel", "g"])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, s, gs, seen = _arrays(b, "x"), _arrays(b, "s"), _arrays(b, "gs"), b.column("seen").to_numpy()
            started, finite = gs.any(axis=1), np.isfinite(gs).all(axis=1)
            s[started & ~finite] = np.where((seen == 0)[:, None], gs, np.nan)[started & ~finite]
            for k in np.unique(seen[started & finite]):
                at = started & finite & (seen == k)
                s[at] += gs[at] @ system.power(int(k)).T
            n = np.diff(b.column("x").offsets.to_numpy())
            y, after = system.run(x, n, s)
            columns = [*(b.column(c) for c in ("signal_id", "channel", "idx", "more")), pa.array([v[:m] for v, m in zip(y, n)], pa.list_(pa.float64()))]
            if ending:
                columns.append(pa.array(list(after), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=["signal_id", "channel", "idx", "more", "y", "state"][: len(columns)])

    done = blocks.join(states, ["signal_id", "channel", "block"]).select("signal_id", "channel", "idx", "x", "more", "s", "gs", "seen")
    filtered = done.mapInArrow(outputs, _fields(*key, ("idx", ArrayType(LONG)), ("more", kept), ("y", FLOATS), *([("state", FLOATS)] if ending else [])))
    each = filtered.select(
        "signal_id",
        "channel",
        *([F.size("y").alias("_n"), "state"] if ending else []),
        F.posexplode(F.arrays_zip("idx", "y", "more")).alias("_at", "v")
    )
    state = [F.when(F.col("_at") == F.col("_n") - 1, F.col("state")).alias("state")] if ending else []
    others = [F.col(f"v.more.c{i}").alias(c) for i, c in enumerate(extra)]
    return each.select("signal_id", "channel", F.col("v.idx").alias("idx"), (F.col("v.idx") / F.lit(rate)).alias("t"), F.col("v.y").alias("x"), *others, *state)
