"""Chunk files: what was written comes back, slices open their own folders only, streams read all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.sources import chunk_files
from test_signals import table


@pytest.fixture
def store(spark, tmp_path):
    rng = np.random.default_rng(1)
    s = table(spark, rng.normal(0, 1, 1000)).unionByName(table(spark, rng.normal(0, 1, 1000), 1))
    s = s.withColumn("signal_id", F.lit("a")).unionByName(s.withColumn("signal_id", F.lit("b/c d")).where("idx < 250")).withColumn("x", F.when(F.col("idx") != 77, F.col("x")))
    chunk_files.write(s, str(tmp_path / "store"), turns=10, run=16)
    return s, str(tmp_path / "store")


def rows(df):
    return sorted(map(tuple, df.select("signal_id", "channel", "idx", "t", "x").collect()), key=str)


def test_samples_come_back(spark, store):
    s, path = store
    assert rows(chunk_files.read_samples(spark, path, run=16)) == rows(s)
    part = chunk_files.read_samples(spark, path, signals=["b/c d"], first=3, last=18, run=16)
    assert rows(part) == rows(s.where("signal_id = 'b/c d' and idx between 30 and 189"))


def test_slices_open_their_folders_only(spark, store):
    _, path = store
    part = chunk_files.read(spark, path, signals=["a"], first=20, last=40, run=16)
    assert [r.chunk_seq for r in part.orderBy("chunk_seq").collect()] == list(range(20, 41))
    assert len(part.select(F.input_file_name().alias("f")).distinct().collect()) == 2
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in scan or "PartitionFilters: [isnotnull(signal_id" in scan


def test_streams_read_all_and_what_comes_later(spark, store, tmp_path):
    s, path = store
    seen = []

    def run():
        q = chunk_files.stream(spark, path, 2).writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sum(seen) == 125 and len(seen) >= 4
    chunk_files.write(s.where("signal_id = 'a'").withColumn("signal_id", F.lit("new")), path, turns=10, run=16)
    run()
    assert sum(seen) == 225


def test_an_empty_table_writes_nothing(spark, store, tmp_path):
    s, path = store
    chunk_files.write(s.limit(0), path, turns=10, run=16)
    assert chunk_files.read(spark, path).count() == 125
