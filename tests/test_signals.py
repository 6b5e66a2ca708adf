"""Samples tables, slices, source and statistics: the shapes and values of the fixtures, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from sparkwave import queries
from sparkwave.functions.patterns import PRESETS, Pattern, mean_activation
from sparkwave.operators import reshape
from sparkwave.sources import samples as sources
from sparkwave.sources.emg import Emg, Noise

SCHEMA = "signal_id string, channel int, idx bigint, t double, x double"


def table(spark, values, channel=0, rate=1000.0):
    return spark.createDataFrame([("s", channel, i, i / rate, float(v)) for i, v in enumerate(values)], SCHEMA)


def test_deinterleave_two_channels(spark):
    chunks = spark.createDataFrame([("s", 0, 2, [float(i) for i in range(2000)])], "signal_id string, chunk_seq long, channel_count int, data array<double>")
    rows = sources.from_chunks(chunks)
    for c in (0, 1):
        got = [r.x for r in rows.where(F.col("channel") == c).orderBy("idx").collect()]
        assert got == [2 * i + c for i in range(1000)]
    back = sources.to_chunks(rows, 500).orderBy("chunk_seq").collect()
    assert [v for r in back for v in r.data] == list(range(2000)) and back[0].channel_count == 2


def test_an_incomplete_turn_is_left_out(spark):
    chunks = spark.createDataFrame([("s", 0, 2, [1.0, 2.0, 3.0])], "signal_id string, chunk_seq long, channel_count int, data array<double>")
    assert sources.from_chunks(chunks).count() == 2


def test_events_are_numbered_across_buckets(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    one, many = (sources.from_events(events, bucket_seconds=s).orderBy("channel", "idx").collect() for s in (10**9, 600))
    assert one == many
    for c in {r.channel for r in one}:
        assert [r.idx for r in one if r.channel == c] == list(range(sum(r.channel == c for r in one)))


def test_slice_is_half_open_and_rebased(spark):
    s = table(spark, range(1000))
    got = reshape.time_slice(s, 0.05, 0.35).orderBy("idx").collect()
    assert len(got) == 300 and got[0].idx == 0 and got[0].x == 50 and got[-1].x == 349
    for bad in [(-1, 0.5), (0.5, 0.5), (0.6, 0.5)]:
        with pytest.raises(ValueError):
            reshape.time_slice(s, *bad)
    with pytest.raises(ValueError):
        reshape.time_slice(s, 0, 2, duration=1.0)
    with pytest.raises(IndexError):
        reshape.channel(s, 1, 1)


def test_statistics_of_a_sine(spark):
    r = reshape.channel_stats(table(spark, [math.sin(2 * math.pi * i / 64) for i in range(256)])).collect()[0]
    assert abs(r["mean"]) < 1e-12 and abs(r.rms - math.sqrt(0.5)) < 1e-12 and abs(r.peak_to_peak - 2) < 1e-12


def test_tails_and_clamp(spark):
    s = table(spark, range(1000))
    assert sorted(r.idx for r in reshape.plot_tail(s, 3).collect()) == [997, 998, 999]
    assert reshape.latest_chunk(s, 300).count() == 100
    assert reshape.buffer_tail(s, 2, 300).count() == 400
    assert reshape.recent(s, 0.1).count() == 101
    assert reshape.clamp(s).agg(F.max("x")).head()[0] == 5


def test_empty_tables(spark):
    s = spark.createDataFrame([], SCHEMA)
    assert reshape.channel_stats(s).count() == reshape.recent(s).count() == reshape.chunk_stats(s).count() == 0


def test_source_shape_range_and_reproducibility(spark):
    for p in (Pattern.of("constant", level=0.5), Pattern.of("sinusoidal", frequency=1.0, amplitude=0.3, baseline=0.2), Pattern.of("realistic", base_level=0.6, tremor_frequency=8.0, tremor_amplitude=0.05)):
        emg = Emg(channels=4, pattern=p, seed=3)
        rows = emg.samples(spark, 0.5)
        stats = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.stddev("x")).head()
        assert stats[0] == 2000 and stats[1] >= -5 and stats[2] <= 5 and stats[3] > 0
        assert sorted(rows.collect()) == sorted(emg.samples(spark, 0.5).repartition(7).collect())
        assert sorted(rows.where("idx >= 250").collect()) == sorted(emg.samples(spark, 0.25, start=0.25).collect())
        assert sorted(rows.collect()) != sorted(emg.with_(seed=4).samples(spark, 0.5).collect())


def test_noise_has_its_moments(spark):
    emg = Emg(pattern=Pattern.of("constant", level=0.0), noise=Noise(0.5, 0.0, 0.0, 0.0), powerline=None)
    mean, std = emg.samples(spark, 20.0).agg(F.avg("x"), F.stddev("x")).head()
    assert abs(mean) < 0.02 and abs(std - 0.5) < 0.02


def test_source_limits():
    for bad in ({"rate": 499.0}, {"rate": 4001.0}, {"channels": 0}, {"channels": 17}, {"noise": Noise(-1.0)}):
        with pytest.raises(ValueError):
            Emg(**bad)
    with pytest.raises(ValueError):
        Pattern.of("unknown")
    with pytest.raises(ValueError):
        Pattern.of("ramp", slope=1.0)


def test_patterns_survive_json_and_have_descriptions(spark):
    for p in PRESETS.values():
        assert Pattern.from_json(p.to_json()) == p and p.description
    assert len(PRESETS) == 11
    assert abs(spark.range(1).select(mean_activation(PRESETS["Rest"], 1.0)).head()[0] - 0.1) < 1e-12


def test_metadata_counts_samples(spark):
    r = Emg(channels=2).metadata(spark, 0.251).head()
    assert r.expected_samples == 502 and r.channel_count == 2


def test_violations(spark):
    good = table(spark, range(5))
    gap = table(spark, range(5), channel=1).where("idx <> 2")
    twice = table(spark, range(3), channel=2).union(table(spark, range(3), channel=2).where("idx = 0"))
    outside = table(spark, range(3), channel=16)
    got = reshape.violations(good.union(gap).union(twice).union(outside)).collect()
    assert sorted(r.channel for r in got) == [1, 2, 16]
    assert reshape.lengths(good.union(gap)).head()[1:] == (2, 9, 5, 0.005)


def test_chunks_are_placed_in_time_across_runs(spark):
    chunks = spark.createDataFrame([("s", i, 0.5 + i % 3) for i in range(50)], "signal_id string, chunk_seq long, duration double")
    got = reshape.rebased(chunks, run=7).orderBy("chunk_seq").collect()
    assert [r.start_time for r in got] == [sum(0.5 + j % 3 for j in range(i)) for i in range(50)]


def test_numbering_ignores_the_sessions_zone(spark):
    """02:30 doesn't exist in New York on 10 March 2024; rows without a zone keep their order all the same."""
    rows = [(i, f"2024-03-10 0{1 + i // 4}:{15 * (i % 4):02d}:00", 7, float(i)) for i in range(16)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sources.from_events(events, bucket_seconds=1800).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.x for r in got] == [float(i) for i in range(16)] and [r.idx for r in got] == list(range(16))


def test_start_times_of_all_chunks(spark, tmp_path):
    """Channel 0 ends in the first chunk, channel 1 in the third: all three chunks have a start time."""
    users = [0] * 40 + [1] * 230
    rows = [(i, u, i, 1.0) for i, u in enumerate(users)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.chunk_start_times(spark, str(tmp_path)).orderBy("chunk_seq").collect()
    assert [(r.chunk_seq, r.duration, r.start_time) for r in got] == [(0, 0.1, 0.0), (1, 0.1, 0.1), (2, 0.03, 0.2)]
