"""Samples tables: one row per sample of a channel, from event logs, interleaved chunks or arrays.

``signal_id, channel, idx, t, x``: idx counts a channel's samples from 0 without gaps, t = idx / rate. No operator
needs a whole channel in one task: order-dependent steps work on runs of idx (``operators.blocks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["signal_id", "channel", "idx", "t", "x"]
KEY = ["signal_id", "channel"]


def indexed(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``df`` with idx, a row's place from 0 among the rows of its keys.

    ``bucket`` must rise with ``order``. Rows are numbered within a bucket and shifted by the sizes of the key's
    earlier buckets, so a key that holds a third of all rows is numbered by as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(*keys, "_bucket", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.withColumn("_at", at).join(before, [*keys, "_bucket"]).select(*df.columns, (F.col("_before") + F.col("_at") - 1).alias("idx"))


def seconds(df: DataFrame, col: str) -> Column:
    """Whole seconds of a timestamp column. One without a zone is read off its own fields: the session's zone has no say."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.unix_date(F.to_date(col)).cast("long") * 86_400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
    return F.col(col).cast("long")


def _of_channels(events: DataFrame, channels: int, signal_id: str) -> DataFrame:
    return events.where("user_id is not null and ts is not null").select(
        F.lit(signal_id).alias("signal_id"), F.pmod("user_id", F.lit(channels)).cast("int").alias("channel"), "ts", "event_id", F.col("value").cast("double").alias("x")
    )


def bucket_length(rows: DataFrame, most_rows: int = 1_000_000, longest: int = 6 * 3600) -> int:
    """Seconds that hold about ``most_rows`` rows of the densest channel; one small aggregation of times."""
    per = rows.groupBy(*KEY).agg(F.count("*").alias("n"), (F.max(seconds(rows, "ts")) - F.min(seconds(rows, "ts")) + 1).alias("s"))
    densest = per.agg(F.max(F.col("n") / F.col("s"))).head()[0]
    return longest if not densest else int(max(1, min(longest, most_rows / densest)))


def last_idx(events: DataFrame, channels: int = 16, signal_id: str = "events") -> DataFrame:
    """signal_id, channel, last: the last idx that ``from_events`` gives each channel, without numbering."""
    return _of_channels(events, channels, signal_id).groupBy(*KEY).agg((F.count("*") - 1).alias("last"))


def from_events(events: DataFrame, channels: int = 16, rate: float = 1000.0, bucket_seconds: int | None = None, signal_id: str = "events") -> DataFrame:
    """Samples of an event log: channel = user_id modulo ``channels``, in order of (ts, event_id), x = value.

    Rows without user or time belong to no channel and are left out; a null value stays a null sample. Rows are
    numbered in buckets of ``bucket_seconds``, by default as long as the densest channel's rows allow.
    """
    rows = _of_channels(events, channels, signal_id)
    bucket_seconds = bucket_seconds or bucket_length(rows)
    placed = indexed(rows, KEY, ["ts", "event_id"], F.floor(seconds(rows, "ts") / bucket_seconds))
    return placed.select("signal_id", "channel", "idx", (F.col("idx") / F.lit(rate)).alias("t"), "x")


def from_chunks(chunks: DataFrame, rate: float = 1000.0) -> DataFrame:
    """De-interleaves chunks (signal_id, chunk_seq, channel_count, data): data holds the channels' samples turn by turn.

    All chunks of a signal have the same length; samples beyond the last full turn are left out.
    """
    turns = F.expr("size(data) div channel_count")
    each = chunks.select("signal_id", "chunk_seq", "channel_count", turns.alias("_turns"), F.posexplode("data").alias("_at", "x"))
    idx = F.col("chunk_seq") * F.col("_turns") + F.expr("_at div channel_count")
    return each.where("_at < _turns * channel_count").select(
        "signal_id", F.expr("_at % channel_count").cast("int").alias("channel"), idx.cast("long").alias("idx"), (idx / F.lit(rate)).alias("t"), F.col("x").cast("double").alias("x")
    )


def to_chunks(samples: DataFrame, turns: int) -> DataFrame:
    """Interleaves samples again, ``turns`` samples of every channel in a chunk: signal_id, chunk_seq, channel_count, data."""
    held = samples.groupBy("signal_id", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "channel", "x"))).alias("_held"), F.max("channel").alias("_last")
    )
    return held.select("signal_id", "chunk_seq", (F.col("_last") + 1).alias("channel_count"), F.transform("_held", lambda s: s["x"]).alias("data"))


def from_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Ready-made windows (signal_id, channel, k, start_sample, n, x), one for each row with an array."""
    x = F.col(array_col).cast("array<double>")
    return df.where(F.col(array_col).isNotNull()).select(
        F.lit(id_col).alias("signal_id"), F.lit(0).alias("channel"), F.col(id_col).cast("long").alias("k"), F.lit(0).cast("long").alias("start_sample"), F.size(x).cast("long").alias("n"), x.alias("x")
    )
