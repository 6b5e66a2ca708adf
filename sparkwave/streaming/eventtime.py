"""Event time: sessions and tumbling windows of event streams, repeats within the watermark, late rows; raw and processed streams paired.

All of these are the same expressions for tables and for streams. In a stream a result comes out when the watermark (the
newest time seen less ``late``) has passed what could still change it; rows behind the watermark are dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def instant(df: DataFrame, col: str) -> Column:
    """A timestamp column as a point in time. One without a zone is read off its own fields, as UTC: the session's zone has no say."""
    if dict(df.dtypes)[col] != "timestamp_ntz":
        return F.col(col)
    second = F.extract(F.lit("SECOND"), F.col(col)).cast("decimal(8,6)")
    whole = F.unix_date(F.to_date(col)).cast("long") * 86_400 + F.hour(col) * 3600 + F.minute(col) * 60
    return F.timestamp_micros((whole * 1_000_000 + (second * 1_000_000).cast("long")).cast("long"))


def once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """``events`` without repeats of ``keys``; a stream remembers keys until the watermark has passed their time by ``late``."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _figures(col: str) -> list[Column]:
    x = F.col(col)
    return [F.count("*").alias("n"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.min(x).alias("min_value"), F.max(x).alias("max_value")]


def _within(rows: DataFrame, window: Column, keys: list[str], time: str, late: str, col: str) -> DataFrame:
    dated = rows.where(F.col(time).isNotNull())
    if rows.isStreaming:
        dated = dated.withWatermark(time, late)
    found = dated.groupBy(*keys, window.alias("w")).agg(*_figures(col))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (*keys, "w")])


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str = "0 seconds", col: str = "value") -> DataFrame:
    """keys, start, end, n, mean, rms, min_value, max_value of each session: events of a key with less than ``gap`` between neighbours.

    ``end`` is the last event's time plus the gap. Events without a time are left out, null values count in n only.
    Partial sessions are merged before the shuffle.
    """
    return _within(events, F.session_window(time, gap), keys, time, late, col)


def tumbling(events: DataFrame, keys: list[str], time: str, length: str, late: str = "0 seconds", col: str = "value") -> DataFrame:
    """keys, start, end, n, mean, rms, min_value, max_value of each window of ``length`` with events."""
    return _within(events, F.window(time, length), keys, time, late, col)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, by the query's recent progress reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def paired_streams(raw: DataFrame, processed: DataFrame, time: str = "ts", within: str = "10 seconds", late: str = "0 seconds") -> DataFrame:
    """Raw and processed samples side by side: signal_id, channel, idx, ``time``, x_raw, x, success.

    Both have signal_id, channel, idx, ``time`` and x. A processed sample belongs to the raw one of its channel and idx if it comes
    at most ``within`` after it. A raw sample whose processed one is lost, or too late, comes out once that is certain, with x null and
    success false. Streams remember samples of the last ``within`` and ``late`` only.
    """
    keys = ["signal_id", "channel", "idx"]
    a = raw.select(*keys, time, F.col("x").alias("x_raw"))
    b = processed.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col(time).alias("p_time"), F.col("x"))
    if raw.isStreaming:
        a, b = a.withWatermark(time, late), b.withWatermark("p_time", late)
    same = [F.col(k) == F.col(f"p_{k}") for k in keys]
    near = F.col("p_time").between(F.col(time), F.col(time) + F.expr(f"interval {within}"))
    both = a.join(b, [*same, near], "leftOuter")
    return both.select(*keys, time, "x_raw", "x", F.col("p_time").isNotNull().alias("success"))
