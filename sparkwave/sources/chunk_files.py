"""Chunks of signals as files: written and read back by signal and range of chunks, whole or as a stream.

A store of chunks is a folder of Parquet with one folder for each signal and run of ``RUN`` chunks, so any path that
Spark reads will do, a writer that fails leaves nothing behind that is read, and a slice of a signal opens only its own
folders. Data is interleaved: the channels' samples turn by turn, as chunks come from a device.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.sources import samples as tables

#: Chunks of one folder.
RUN = 1024
SCHEMA = "chunk_seq long, channel_count int, data array<double>, signal_id string, run long"


def write(samples: DataFrame, path: str, turns: int = 100, run: int = RUN, mode: str = "append") -> None:
    """Writes samples as chunks of ``turns`` samples of every channel, of which there must be as many in all chunks.

    One shuffle: chunks are put together where their folder is written. A null sample is null in the data.
    """
    rows = samples.withColumn("run", F.expr(f"idx div {int(turns) * int(run)}"))
    held = rows.groupBy("signal_id", "run", F.expr(f"idx div {int(turns)}").alias("chunk_seq")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "channel", "x"))).alias("_held"), F.max("channel").alias("_last")
    )
    chunks = held.select("chunk_seq", (F.col("_last") + 1).alias("channel_count"), F.transform("_held", lambda s: s["x"]).alias("data"), "signal_id", "run")
    chunks.repartition("signal_id", "run").sortWithinPartitions("signal_id", "run", "chunk_seq").write.mode(mode).partitionBy("signal_id", "run").parquet(path)


def read(spark: SparkSession, path: str, signals: list[str] | None = None, first: int | None = None, last: int | None = None, run: int = RUN) -> DataFrame:
    """signal_id, chunk_seq, channel_count, data: all chunks, or those of some signals, from number ``first`` to ``last``; other folders aren't opened."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    if signals is not None:
        chunks = chunks.where(F.col("signal_id").isin(signals))
    if first is not None:
        chunks = chunks.where((F.col("run") >= first // run) & (F.col("chunk_seq") >= first))
    if last is not None:
        chunks = chunks.where((F.col("run") <= last // run) & (F.col("chunk_seq") <= last))
    return chunks.select("signal_id", "chunk_seq", "channel_count", "data")


def read_samples(spark: SparkSession, path: str, rate: float = 1000.0, **which) -> DataFrame:
    """The samples of ``read``'s chunks. The last chunk may be shorter, so places go by the longest one of a signal."""
    chunks = read(spark, path, **which)
    turns = read(spark, path, which.get("signals"), run=which.get("run", RUN)).groupBy("signal_id").agg(F.max(F.expr("size(data) div channel_count")).alias("_most"))
    each = chunks.join(turns, "signal_id").select("signal_id", "chunk_seq", "channel_count", "_most", F.posexplode("data").alias("_at", "x"))
    idx = (F.col("chunk_seq") * F.col("_most") + F.expr("_at div channel_count")).cast("long")
    return each.select("signal_id", F.expr("_at % channel_count").cast("int").alias("channel"), idx.alias("idx"), (idx / F.lit(rate)).alias("t"), "x").select(*tables.COLUMNS)


def stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """``read`` as a stream of at most so many files a micro-batch; files that come later are read when they come."""
    chunks = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    return chunks.select("signal_id", "chunk_seq", "channel_count", "data")
