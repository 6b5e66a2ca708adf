"""Channels in the state store against the batch filters: many micro-batches, restarts, silence, initial states, many channels."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave.operators import filters
from sparkwave.plans import spec
from sparkwave.streaming import stateful
from test_signals import SCHEMA, table

ROWS = "signal_id string, channel int, at long, ts timestamp, x double"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
PIPELINE = spec.pipeline("p").add("highpass", cutoff=20.0).add("moving_average", size=7).add("notch", frequency=50.0).add("median", size=5)


def write(spark, path, parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame([("s", c, a, T0 + datetime.timedelta(milliseconds=a), x) for c, a, x in rows], ROWS).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, checkpoint, **options):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)
    done = stateful.stream_channels(stream, options.pop("pipeline", PIPELINE), ["at"], **options)
    q = done.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(stateful.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was[0])
    spark.conf.set(stateful.STORE, was[1])


def expected(spark, x, pipeline=PIPELINE):
    s = table(spark, [0.0] * len(x)).drop("x").join(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "idx long, x double"), "idx").select("signal_id", "channel", "idx", "t", "x")
    return {r.idx: (r.x_raw, r.x) for r in pipeline.apply(s, 1000.0).samples.collect()}


def same(a, b):
    return (a is None) == (b is None) and (a is None or np.isnan(a) and np.isnan(b) or a == b or abs(a - b) < 1e-9)


def test_equals_batch_over_micro_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = [None if i == 40 else float(v) for i, v in enumerate(rng.normal(50, 9, 330))]
    path, out = str(tmp_path / "in"), []
    write(spark, path, [[(0, i, x[i]) for i in range(a, b)] for a, b in ((0, 3), (3, 100), (100, 290))])
    run(spark, path, out, str(tmp_path / "c"))
    write(spark, path, [[(0, i, x[i]) for i in range(290, 330)], [(1, i, x[i]) for i in range(330)]])
    run(spark, path, out, str(tmp_path / "c"))  # goes on from the checkpoint
    want = expected(spark, x)
    for channel in (0, 1):
        got = {r.idx: r for r in out if r.channel == channel}
        assert len(got) == 330 and all(same(got[i].x, want[i][1]) and same(got[i].x_raw, want[i][0]) and got[i].since is None for i in got)


def test_samples_that_are_no_numbers(spark, tmp_path):
    x = [float("nan") if i == 20 else float("inf") if i == 30 else None if i < 3 else float(i % 7) for i in range(60)]
    p = spec.pipeline("p").add("moving_average", size=4)
    path, out = str(tmp_path / "in"), []
    write(spark, path, [[(0, i, x[i]) for i in range(a, b)] for a, b in ((0, 21), (21, 22), (22, 60))])
    run(spark, path, out, str(tmp_path / "c"), pipeline=p)
    want = expected(spark, x, p)
    assert len(out) == 60 and all(same(r.x, want[r.idx][1]) and same(r.x_raw, want[r.idx][0]) for r in out)
    with pytest.raises(ValueError):
        stateful.stream_channels(spark.readStream.schema(ROWS).parquet(path), spec.pipeline("p").add("features", size=8), ["at"])


def test_silent_channels_start_from_rest_and_are_forgotten(spark, tmp_path):
    """Channel 0 pauses for longer than allowed, within a micro-batch and between two; channel 1 ends early."""
    rng = np.random.default_rng(2)
    a, b, c = ([float(v) for v in rng.normal(50, 9, n)] for n in (50, 30, 40))
    rows = [(0, i, v) for i, v in enumerate(a)] + [(0, 5000 + i, v) for i, v in enumerate(b)]
    path, out = str(tmp_path / "in"), []
    write(spark, path, [rows[:20] + [(1, i, v) for i, v in enumerate(c)], rows[20:60], rows[60:], [(0, 20_000 + i, v) for i, v in enumerate(c)], [(0, 30_000, 1.0)]])
    q = run(spark, path, out, str(tmp_path / "c"), time="ts", silence=1.0)
    assert len(out) == 161
    for channel, since, x in ((0, 0, a), (0, 5000, b), (0, 20_000, c), (1, 0, c)):
        want = expected(spark, x)
        got = {r.idx: r.x for r in out if r.channel == channel and r.since.replace(tzinfo=datetime.timezone.utc) == T0 + datetime.timedelta(milliseconds=since)}
        assert got.keys() == want.keys() and all(same(got[i], want[i][1]) for i in got)
    rows_held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows_held) > rows_held[-1]  # what channel 1 held has gone


def test_goes_on_from_an_initial_state(spark, tmp_path):
    x = [float(v) for v in np.random.default_rng(3).normal(50, 9, 200)]
    p = spec.pipeline("p").add("highpass", cutoff=20.0)
    half = filters.carried(table(spark, x[:120]), p.sections(1000.0), 1000.0, spark.createDataFrame([], "signal_id string, channel int, state array<double>"))
    states = half.where("state is not null").orderBy(F.desc("idx")).limit(1).select("signal_id", "channel", (F.col("idx") + 1).alias("seen"), F.lit(T0).alias("last"), F.lit(T0).alias("since"), F.col("state").alias("states"))
    initial = spark.createDataFrame(states.collect(), stateful.INITIAL)
    path, out = str(tmp_path / "in"), []
    write(spark, path, [[(0, i, x[i]) for i in range(120, 150)], [(0, i, x[i]) for i in range(150, 200)]])
    run(spark, path, out, str(tmp_path / "c"), pipeline=p, initial=initial)
    want = expected(spark, x, p)
    assert sorted(r.idx for r in out) == list(range(120, 200)) and all(same(r.x, want[r.idx][1]) for r in out)


def test_many_channels_are_spread_over_all_tasks(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(20_000).select(F.lit("s").alias("signal_id"), F.col("id").cast("int").alias("channel"), F.lit(0).cast("long").alias("at"), F.lit(T0).alias("ts"), F.rand(1).alias("x")).repartition(1).write.parquet(path)
    stream = spark.readStream.schema(ROWS).parquet(path)
    done = stateful.stream_channels(stream, spec.pipeline("p").add("highpass", cutoff=20.0), ["at"]).withColumn("part", F.spark_partition_id())
    parts = []
    done.writeStream.foreachBatch(lambda df, n: parts.extend(df.groupBy("part").count().collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(parts) == 2 and all(9000 < r["count"] < 11_000 for r in parts)
