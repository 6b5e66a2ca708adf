"""Sliding windows of a fixed number of samples.

Window k of a channel covers idx k * hop to k * hop + size - 1; a partial one at the end is left out. Samples are dealt
out once, by runs of ``RUN`` windows, with what a run's last windows need of the next; the aggregation by window then
finds its rows in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256
KEY = ["signal_id", "channel", "_run", "k"]


def hop_of(size: int, overlap: float) -> int:
    """Samples from one window's start to the next one's; a negative overlap counts as none."""
    if size < 1:
        raise ValueError("a window must hold a sample at least")
    if overlap >= 1:
        raise ValueError("windows must advance: the overlap must be below 1")
    return min(size, max(1, int(size * (1 - overlap))))


def runs(samples: DataFrame, size: int, hop: int) -> DataFrame:
    """``samples`` with _run: a row for each run of windows that holds it. Only the samples' rows are moved here."""
    first, last = f"greatest(0, (idx - {size} + {hop}) div {hop})", f"idx div {hop}"
    # idx - size + hop may be negative for the first window's rows: div then rounds towards 0, which greatest() also gives.
    dealt = samples.withColumn("_run", F.explode(F.sequence(F.expr(f"({first}) div {RUN}"), F.expr(f"({last}) div {RUN}"))))
    return dealt.withColumns({"_first": F.greatest(F.expr(first), F.col("_run") * RUN), "_last": F.least(F.expr(last), F.col("_run") * RUN + RUN - 1)})


def members(rows: DataFrame, hop: int) -> DataFrame:
    """A row for each window that holds the sample, with k and at, the sample's place in the window."""
    each = rows.where("_first <= _last").withColumn("k", F.explode(F.sequence("_first", "_last")))
    return each.withColumn("at", F.col("idx") - F.col("k") * hop).drop("_first", "_last")


def ordered(col: str = "x") -> Column:
    """The window's samples in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("idx", col))), lambda s: s[col])


def sliding(samples: DataFrame, size: int, overlap: float = 0.5) -> DataFrame:
    """signal_id, channel, k, start_sample, n, x: full windows as arrays."""
    hop = hop_of(size, overlap)
    by_run = runs(samples.select("signal_id", "channel", "idx", "x"), size, hop).repartition("signal_id", "channel", "_run")
    held = members(by_run, hop).groupBy(*KEY).agg(F.count("*").alias("n"), ordered().alias("x")).where(F.col("n") == size)
    return held.select("signal_id", "channel", "k", (F.col("k") * hop).alias("start_sample"), "n", "x")
