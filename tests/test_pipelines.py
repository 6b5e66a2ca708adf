"""Pipelines, profiles, and streams against batch."""

import json
import math
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwave import queries
from sparkwave.operators import design, filters
from sparkwave.operators.design import DesignError
from sparkwave.plans import metrics, profiles, spec
from sparkwave.streaming import live
from tests_support import recursion, values

from test_signals import SCHEMA, table

X = np.sin(np.arange(1000) * 0.1) + 2


def test_builder_names_and_kinds():
    p = spec.pipeline("p").add("highpass", cutoff=20.0).add("highpass", cutoff=30.0).add("features", size=128)
    assert p.names() == ["highpass", "highpass_2", "features"] and p.kinds() == ["filter", "filter", "feature_extractor"]
    assert p.latency_us() == 10 + 10 + 128_000 and not p.meets_latency()
    assert p.update("highpass_2", cutoff=40.0).stage("highpass_2").params[0] == ("cutoff", 40.0)
    with pytest.raises(KeyError):
        p.stage("lowpass")
    with pytest.raises(ValueError):
        spec.pipeline("p").add("echo")


def test_neighbours_are_one_cascade(spark):
    p = spec.pipeline("p").add("highpass", cutoff=20.0).add("notch", frequency=50.0).add("moving_average", size=3).add("lowpass", cutoff=100.0)
    steps, _ = p.normalised(1000.0)
    assert [len(s) if isinstance(s, list) else s.kind for s in steps] == [2, "moving_average", 1]
    r = p.apply(table(spark, X))
    y = recursion(spec.pipeline("a").add("highpass", cutoff=20.0).add("notch", frequency=50.0).sections(1000.0), X)
    y = [np.mean(y[max(0, i - 2) : i + 1]) for i in range(len(y))]
    assert np.allclose(values(r.samples), recursion(spec.pipeline("b").add("lowpass", cutoff=100.0).sections(1000.0), y), atol=1e-9)
    assert [v.x_raw for v in r.samples.orderBy("idx").collect()] == X.tolist()


def test_export_and_restore():
    import json

    p = spec.research().enable("lowpass", False)
    assert spec.Pipeline.restore(json.loads(json.dumps(p.export()))) == p


def test_bypass_on_error(spark):
    p = spec.pipeline("p").add("highpass", cutoff=10_000.0)
    with pytest.raises(DesignError):
        p.apply(table(spark, [1.0] * 100))
    r = p.bypass().apply(table(spark, [1.0] * 100))
    assert values(r.samples) == [1.0] * 100 and len(r.warnings) == 1 and r.stages == []


def test_disabled_stages_are_not_planned(spark):
    p = spec.pipeline("p").add("highpass", cutoff=10_000.0).enable("highpass", False)
    assert values(p.apply(table(spark, [1.0])).samples) == [1.0]


def test_presets():
    assert [len(p.stages) for p in (spec.realtime(), spec.research(), spec.comprehensive(), spec.emg_preprocessing())] == [2, 5, 4, 3]
    with pytest.raises(DesignError):  # 500 Hz isn't below half of 1000 Hz
        spec.emg_preprocessing().normalised(1000.0)
    assert len(spec.emg_preprocessing().normalised(2000.0)[0]) == 1
    assert spec.realtime().bypass_on_error and not spec.research().bypass_on_error


def test_band_pass_must_be_allowed():
    p = spec.pipeline("p").add("bandpass", low=20.0, high=450.0)
    with pytest.raises(DesignError):
        p.normalised(1000.0)
    from dataclasses import replace

    assert len(replace(p, allow_bandpass=True).sections(1000.0)) == 2


def test_validation_and_order():
    for bad in (spec.Pipeline(""), spec.Pipeline("p"), spec.Pipeline("p", max_latency_ms=-1)):
        with pytest.raises(ValueError):
            bad.validate()
    p = spec.pipeline("p").add("features", size=8).add("notch", frequency=50.0)
    assert p.by_kind().names() == ["notch", "features"]


def test_service_pipelines():
    of = lambda **k: spec.pipeline_for(spec.ServiceSpec(**k)).names()
    assert of(kind="bypass") == [] and of(kind="realtime", features=True) == ["highpass", "notch"] and of(filters=False) == []
    assert of(kind="standard", features=True) == ["highpass", "lowpass", "notch", "features"]
    research = spec.pipeline_for(spec.ServiceSpec(kind="research", highpass=33.0, size=64, features=True))
    assert dict(research.stage("highpass").params)["cutoff"] == 10.0 and dict(research.stage("features").params)["size"] == 512
    with pytest.raises(ValueError):
        of(kind="other")


def test_feature_stages_return_features(spark):
    r = spec.pipeline("p").add("highpass", cutoff=20.0, order=4).add("features", size=128).apply(table(spark, X))
    assert r.features[0].count() == (1000 - 128) // 64 + 1


def test_profiles_are_valid_and_survive_json():
    for name in profiles.PROFILES:
        p = profiles.for_profile(name)
        p.validate()
        assert profiles.Profile.from_json(p.to_json()) == p
    assert [round(profiles.for_profile(n).latency(n), 3) for n in ("realtime", "research", "clinical")] == [0.6, 2.112, 1.256]
    assert profiles.realtime().latency("other") is None
    with pytest.raises(DesignError):
        profiles.clinical().to_pipeline("clinical").normalised(1000.0)
    assert profiles.realtime().to_pipeline("realtime").names() == ["rt_highpass", "rt_notch", "rt_smooth"]


def test_profiles_that_are_wrong():
    p = profiles.realtime()
    p.max_latency_ms = -1
    q = profiles.realtime()
    q.buffer_size = 0
    for bad in (p, q, profiles.realtime().chain("x", []), profiles.realtime().chain("x", ["nothing"])):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(KeyError):
        profiles.realtime().update("nothing", order=2)
    assert not profiles.realtime().enable_processor("rt_notch", False).to_pipeline("realtime").stage("rt_notch").enabled


def test_coercion_and_constraints():
    assert profiles.as_int(3.14) == 3 and profiles.as_float(42) == 42.0 and profiles.as_bool(True) is True
    assert profiles.as_float(True) is None and profiles.as_bool(1) is None and profiles.as_int("4", 7) == 7
    c = profiles.Constraints(rates=(500, 4000))
    assert c.met_by(10_000, 1 << 20) and not c.met_by(10_001, 0) and not c.met_by(1, 1, success=False) and not c.met_by(1, 1, rate=100.0)


def test_breaker():
    def fail(df):
        raise RuntimeError

    b = live.Breaker(fail, most=2)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            b("x")
    assert b("x") == "x" == b("x")
    ok = live.Breaker(lambda d: d + "!", most=2)
    ok.failures = 2
    assert ok("x") == "x!" and ok.failures == 0


def test_stream_in_chunks_equals_batch(spark, tmp_path):
    x = np.random.default_rng(5).normal(0, 1, 900)
    for i in range(3):  # three files, one a micro-batch
        table(spark, x).where(f"idx div 300 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, sections = [], spec.realtime().sections(1000.0)
    q = live.stream_cascade(stream, sections, ["idx"]).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(out, key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(900)) and np.allclose([r.x for r in got], recursion(sections, x), atol=1e-9)


def test_blocks_of_a_stream_equal_batch(spark, tmp_path, monkeypatch):
    """Micro-batches that end within blocks, several groups of blocks, and a channel that comes and goes."""
    monkeypatch.setattr(filters, "GROUP", 2)
    x = np.random.default_rng(6).normal(0, 1, 3000)
    cuts = [(0, 700), (700, 701), (701, 3000)]
    for i, (a, b) in enumerate(cuts):
        rows = table(spark, x).unionByName(table(spark, x[:1500], 1)) if i != 1 else table(spark, x)
        rows.where(f"idx >= {a} and idx < {b}").drop("t").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("signal_id string, channel int, idx bigint, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sections = spec.realtime().sections(1000.0)
    sink = live.BlockSink(sections, ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    stream.withColumnRenamed("idx", "at").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out" / "rows").iterdir()) == ["0", "1", "2"]
    got = sink.rows(spark).orderBy("channel", "idx").collect()
    for c, want in ((0, x), (1, np.delete(x[:1500], 700))):
        rows = [r for r in got if r.channel == c]
        assert [r.idx for r in rows] == list(range(len(want))) and [r.x_raw for r in rows] == want.tolist()
        assert np.allclose([r.x for r in rows], recursion(sections, want), atol=1e-9) and rows[5].t == 0.005
    sink(spark.read.parquet(str(tmp_path / "in" / "2")).withColumnRenamed("idx", "at"), 2)  # again
    assert sink.rows(spark).count() == len(got)


def test_a_table_of_part_files_is_streamed_whole(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(queries.stream_filter_equals_batch(spark, d).collect()) for d in (str(tmp_path), sf))
    assert len(got) > 0 and got == want


def test_control(spark, tmp_path):
    table(spark, X).write.parquet(str(tmp_path / "in"))
    seen = []
    make = lambda p: live.stream_pipeline(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), p, ["idx"])
    control = live.Live(make, spec.realtime(), lambda df, n: seen.append(df.count()), str(tmp_path / "c"), {"availableNow": True})
    control.start().awaitTermination()
    assert sum(seen) == 1000 and control.stats()["rows"] == 1000 and not control.running
    assert control.slow_batches(0.0) and control.slow_batches(1e9) == []
    control.resume().awaitTermination()  # nothing new
    assert sum(seen) == 1000
    control.update(spec.research().enable("features", False))
    control.start().awaitTermination()  # a new version begins from the start
    assert sum(seen) == 2000 and control.version == 1
    with pytest.raises(ValueError):
        live.stream_pipeline(None, spec.pipeline("p").add("moving_average", size=3), ["idx"])


def test_live_source(spark):
    from sparkwave.sources.emg import Emg

    s = live.emg_stream(spark, Emg(channels=2))
    assert s.isStreaming and s.columns == ["signal_id", "channel", "idx", "t", "x"]


def test_own_stages(spark):
    from pyspark.sql import functions as F

    def never_below(rate):
        if rate < 900:
            raise DesignError("too slow")

    p = spec.pipeline("own").add_stage("twice", lambda s, rate: s.withColumn("x", 2 * F.col("x")), never_below, 300).add_stage("twice", lambda s, rate: s.withColumn("x", F.col("x") + rate))
    assert p.names() == ["twice", "twice_2"] and p.latency_us() == 1300 and p.kinds() == ["filter", "filter"]
    got = p.apply(table(spark, [1.0, 2.0])).samples.orderBy("idx").collect()
    assert [(r.x_raw, r.x) for r in got] == [(1.0, 1002.0), (2.0, 1004.0)]
    with pytest.raises(DesignError):
        p.apply(table(spark, [1.0]), 500.0)
    assert p.bypass().apply(table(spark, [1.0]), 500.0).stages == ["twice_2"]
    again = spec.Pipeline.restore(p.export(), {s.name: s.own for s in p.stages})
    assert again == p and again.apply(table(spark, [1.0])).samples.head().x == 1002.0
    with pytest.raises(DesignError):
        spec.Pipeline.restore(p.export()).apply(table(spark, [1.0]))
    nested = spec.pipeline("outer").add("highpass", cutoff=20.0).add_stages(p)
    assert nested.names() == ["highpass", "twice", "twice_2"]


def test_roles_of_own_stages():
    same = lambda s, rate: s
    p = spec.pipeline("p").add_stage("post", same, role="post_processor").add("features", size=64).add_stage("look", same, role="analyzer").add("notch", frequency=50.0)
    assert p.kinds() == ["post_processor", "feature_extractor", "analyzer", "filter"] and p.by_kind().names() == ["notch", "features", "look", "post"]
    assert spec.Pipeline.restore(json.loads(json.dumps(p.export()))).kinds() == p.kinds()
    with pytest.raises(ValueError):
        p.add_stage("odd", same, role="echo")


def test_runtime_configuration(spark):
    c = spec.default_emg()
    c.validate()
    assert c.enabled and not c.bypass_on_error and c.max_latency_ms == 10.0 and len(c.entries) == 4
    assert c.pipeline().names() == ["Highpass Filter", "Lowpass Filter", "Notch Filter", "Feature Extractor"]
    assert c.pipeline().apply(table(spark, X)).features[0].count() > 0
    r = spec.realtime_emg()
    assert r.bypass_on_error and r.max_latency_ms == 5.0 and [e.processor for e in r.entries] == ["highpass", "notch"]
    from dataclasses import replace

    for bad in (replace(c, name=""), replace(c, max_latency_ms=-1.0), replace(c, entries=()), replace(c, entries=(spec.Entry("", "highpass", "filter"),)), replace(c, entries=(spec.Entry("a", "highpass", "thing"),))):
        with pytest.raises(ValueError):
            bad.validate()
    assert not r.enable("Notch Filter", False).pipeline().stage("Notch Filter").enabled
    off = replace(r, enabled=False).pipeline().apply(table(spark, [1.0, 2.0]))
    assert off.stages == [] and [v.x for v in off.samples.orderBy("idx").collect()] == [1.0, 2.0]


def test_metrics(spark):
    from sparkwave.plans import metrics

    with metrics.Timer() as t:
        t.quality(1.7, -0.2)
    m = t.metrics
    assert m.success and m.processing_time_us >= 0 and (m.input_quality, m.output_quality) == (1.0, 0.0) and m.meets(profiles.Constraints())
    with pytest.raises(RuntimeError):
        with metrics.Timer() as t:
            raise RuntimeError("broken")
    assert not t.metrics.success and t.metrics.error == "broken" and not t.metrics.meets(profiles.Constraints())
    slow = metrics.Metrics(processing_time_us=20_000)
    assert not slow.meets(profiles.Constraints())
    s = metrics.summary([m, t.metrics, slow])
    assert s.steps == 3 and s.total_us >= 20_000 and abs(s.success_rate - 2 / 3) < 1e-9
    assert metrics.summary([]) == metrics.Performance(0, 0, 1.0, 0)
    p = spec.pipeline("p").add("highpass", cutoff=20.0).add("lowpass", cutoff=900.0).add("features", size=128)
    got = metrics.measured(p, table(spark, [*X[:500], math.nan]), qualities=True)
    assert list(got) == ["highpass", "lowpass", "features"] and [v.success for v in got.values()] == [True, False, True]
    assert abs(got["highpass"].input_quality - 500 / 501) < 1e-9


def three_batches(spark, path, x, cuts=((0, 700), (700, 701), (701, 3000))):
    for i, (a, b) in enumerate(cuts):
        rows = table(spark, x).unionByName(table(spark, x[:1500], 1)) if i != 1 else table(spark, x)
        rows.where(f"idx >= {a} and idx < {b}").drop("t").coalesce(1).write.parquet(str(path / "in" / f"{i}"))
    stream = spark.readStream.schema("signal_id string, channel int, idx bigint, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path / "in"))
    return stream.withColumnRenamed("idx", "at")


def run(stream, sink, path):
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start().awaitTermination()


def test_a_pipeline_in_micro_batches_equals_batch(spark, tmp_path):
    x = np.random.default_rng(7).normal(0, 1, 3000)
    p = spec.pipeline("all").add("highpass", cutoff=20.0).add("moving_average", size=5).add_stage("twice", lambda s, rate: s.withColumn("x", 2 * F.col("x"))).add("median", size=7)
    p = p.add("notch", frequency=50.0).add("features", size=64, enabled=["mean", "zero_crossings", "peak_frequency"])
    stream = three_batches(spark, tmp_path, x)
    sink = live.PipelineSink(p, ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    run(stream, sink, tmp_path)
    got = sink.rows(spark).orderBy("channel", "idx").collect()
    whole = table(spark, x).unionByName(table(spark, np.delete(x[:1500], 700), 1))
    want = p.apply(whole)
    for a, b in zip(got, want.samples.orderBy("channel", "idx").collect(), strict=True):
        assert a.success and (a.channel, a.idx, a.x_raw) == (b.channel, b.idx, b.x_raw) and abs(a.x - b.x) < 1e-9
    key = lambda rows: sorted((r.channel, r.k, r.zero_crossings, round(r.mean, 8), r.peak_frequency) for r in rows)
    assert key(sink.features(spark).collect()) == key(want.features[0].collect())
    sink(spark.read.parquet(str(tmp_path / "in" / "2")).withColumnRenamed("idx", "at"), 2)  # again
    assert sink.rows(spark).count() == len(got) and sink.features(spark).count() == want.features[0].count()


def test_a_failing_micro_batch_is_written_raw(spark, tmp_path):
    def fails(s, rate):
        if s.count() == 1:
            raise RuntimeError("no")
        return s.withColumn("x", F.col("x") + 1)

    x = np.random.default_rng(8).normal(0, 1, 3000)
    p = spec.pipeline("p").add("moving_average", size=3).add_stage("fails", fails)
    sink = live.PipelineSink(p.bypass(), ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    stream = three_batches(spark, tmp_path, x)
    run(stream, sink, tmp_path)
    got = sink.rows(spark).where("channel = 0").orderBy("idx").collect()
    assert len(got) == 3000 and [r.idx for r in got if not r.success] == [700] and got[700].x == x[700] and got[699].x != x[699]
    assert abs(got[703].x - x[701:704].mean() - 1) < 1e-9 and sink.errors == ["batch 1: no"]
    strict = live.PipelineSink(p, ["at"], F.expr("at div 100"), str(tmp_path / "strict"))
    with pytest.raises(RuntimeError):
        strict(spark.read.parquet(str(tmp_path / "in" / "1")).withColumnRenamed("idx", "at"), 0)
    off = live.PipelineSink(p, ["at"], F.expr("at div 100"), str(tmp_path / "off"), bypass=True)
    off(spark.read.parquet(str(tmp_path / "in" / "0")).withColumnRenamed("idx", "at"), 0)
    off.bypass = False
    off(spark.read.parquet(str(tmp_path / "in" / "2")).withColumnRenamed("idx", "at"), 1)
    rows = off.rows(spark).where("channel = 0").orderBy("idx").collect()
    assert all(r.success for r in rows) and rows[3].x == x[3] and abs(rows[710].x - x[709:712].mean() - 1) < 1e-9


def test_working_folders_go(spark, tmp_path):
    """After ten micro-batches there are rows, features, and what the last two remember."""
    x = np.random.default_rng(10).normal(0, 1, 1000)
    p = spec.pipeline("p").add("highpass", cutoff=20.0).add("moving_average", size=5).add("features", size=64, enabled=["mean"])
    sink = live.PipelineSink(p, ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    blocks = live.BlockSink(spec.realtime().sections(1000.0), ["at"], F.expr("at div 100"), str(tmp_path / "blocks"))
    s = table(spark, x).withColumnRenamed("idx", "at").persist()
    for n in range(10):
        for each in (sink, blocks):
            each(s.where(f"at div 100 = {n}"), n)
    left = {str(f.relative_to(tmp_path)) for f in tmp_path.glob("*/*/*") if f.is_dir()}
    both = {f"out/{d}/{n}" for d in ("seen", "memory-0", "memory-1", "memory-2") for n in (8, 9)} | {f"blocks/states/{n}" for n in (8, 9)}
    assert left == both | {f"{d}/{n}" for d in ("out/rows", "out/features-0", "blocks/rows") for n in range(10)}
    want = p.apply(table(spark, x)).samples.orderBy("idx").collect()
    assert all(abs(a.x - b.x) < 1e-9 for a, b in zip(sink.rows(spark).orderBy("idx").collect(), want, strict=True))


def test_features_of_a_failed_batch_are_not_written(spark, tmp_path):
    def fails(s, rate):
        raise RuntimeError("no")

    p = spec.pipeline("p").add("features", size=8, enabled=["mean"]).add_stage("fails", fails)
    sink = live.PipelineSink(p.bypass(), ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    sink(table(spark, range(50)).withColumnRenamed("idx", "at"), 0)
    assert sink.rows(spark).where("not success").count() == 50 and not (tmp_path / "out" / "features-0").exists()


def test_several_queries(spark, tmp_path):
    table(spark, X).write.parquet(str(tmp_path / "in"))
    seen = {"a": 0, "b": 0}

    def sink(name):
        def write(df, n):
            seen[name] += df.count()

        return write

    make = lambda p: live.stream_pipeline(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), p, ["idx"])
    fleet = live.Fleet(a=live.Live(make, spec.realtime(), sink("a"), str(tmp_path / "ca"), {"availableNow": True}))
    fleet.add("b", live.Live(make, spec.research().enable("features", False), sink("b"), str(tmp_path / "cb"), {"availableNow": True}))
    with pytest.raises(ValueError):
        fleet.add("b", fleet["a"])
    fleet.start()
    fleet.wait()
    assert seen == {"a": 1000, "b": 1000} and {n: s["rows"] for n, s in fleet.stats().items()} == seen
    fleet.stop("a")
    assert fleet["a"].version == 1 and fleet["b"].version == 0


def test_stream_of_nulls_and_non_numbers_equals_batch(spark, tmp_path):
    x = np.random.default_rng(9).normal(0, 1, 900).tolist()
    x[100], x[500] = None, math.nan
    rows = spark.createDataFrame([("s", 0, i, i / 1000.0, v) for i, v in enumerate(x)], SCHEMA)
    for i in range(3):
        rows.where(f"idx div 300 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sections = spec.realtime().sections(1000.0)
    out = []
    live.stream_cascade(stream, sections, ["idx"]).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    sink = live.BlockSink(sections, ["at"], F.expr("at div 100"), str(tmp_path / "out"))
    stream.withColumnRenamed("idx", "at").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    want = recursion(sections, [0.0 if v is None else v for v in x])
    batch = filters.recursive(rows, sections, 1000.0).orderBy("idx").collect()
    for got in (sorted(out, key=lambda r: r.idx), sink.rows(spark).orderBy("idx").collect(), batch):
        assert np.allclose([r.x for r in got], want, atol=1e-9, equal_nan=True)
    raw = [r.x_raw for r in sorted(out, key=lambda r: r.idx)]
    assert raw[100] is None and math.isnan(raw[500]) and raw[:100] == x[:100]


def test_metrics_of_one_run(spark):
    x = np.random.default_rng(11).normal(50, 9, 700).tolist()
    x[300], x[200] = math.nan, None
    rows = spark.createDataFrame([("s", 0, i, i / 1000.0, v) for i, v in enumerate(x)], SCHEMA)
    p = spec.pipeline("p").add("moving_average", size=3).add("highpass", cutoff=20.0).add("notch", frequency=50.0).add("features", size=64, enabled=["mean"]).add("median", size=5)
    watch = metrics.Watch()
    result = p.apply(rows, 1000.0, watch)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one run", "")
    result.samples.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got, want = watch.metrics(), metrics.measured(p, rows, 1000.0, qualities=True)
    assert list(got) == ["moving_average", "highpass+notch", "median"] and set(watch.rows.values()) == {700}
    assert got["moving_average"].input_quality == want["moving_average"].input_quality == 698 / 700
    for mine, theirs in (("moving_average", "moving_average"), ("highpass+notch", "notch"), ("median", "median")):
        assert abs(got[mine].output_quality - want[theirs].output_quality) < 1e-12
    assert len(jobs.getJobIdsForGroup("one run")) > 0 and watch.took > 0
    with metrics.Timer() as t:
        t.memory(5)
    assert t.metrics.memory_bytes == 5


def test_metrics_of_a_stream_by_a_listener(spark, tmp_path):
    x = [math.nan if i % 10 == 0 else float(i) for i in range(1000)]
    for n in range(4):
        table(spark, x[n * 250 : n * 250 + 250]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress, watch = metrics.Progress(), metrics.Watch()
    spark.streams.addListener(progress)
    try:
        stream = watch("input", spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if len([p for p in progress.of(q.id) if p["numInputRows"]]) == 4:
                break
            time.sleep(0.1)
        assert sum(p["numInputRows"] for p in progress.of(q.id)) == 1000
        assert progress.quality(q.id, "input") == 0.9 and progress.quality(q.id, "other") == 1.0
        assert len(progress.slow_batches(q.id, 0.001)) >= 4 and progress.slow_batches(q.id, 1e9) == []
    finally:
        spark.streams.removeListener(progress)


def test_pipelines_in_pipelines_keep_their_own_rules(spark):
    x = np.random.default_rng(12).normal(50, 9, 400)
    s = table(spark, x)
    lenient = spec.pipeline("in").add("lowpass", cutoff=900.0).add("highpass", cutoff=20.0, order=4).bypass()
    lenient = replace(lenient, cascade=True, max_latency_ms=0.001)
    outer = spec.pipeline("out").add("notch", frequency=50.0).add_pipeline(lenient).add("features", size=64, enabled=["mean"])
    result = outer.apply(s)
    assert result.stages == ["notch", "in/highpass", "features"] and result.warnings[0].startswith("in/lowpass bypassed") and "more than its" in result.warnings[1]
    sections = design.notch(50.0, 1000.0) + design.highpass(20.0, 1000.0, 4, cascade=True)
    assert np.allclose(values(result.samples), recursion(sections, x), atol=1e-9)
    strict = outer.add_pipeline(lenient.bypass(False), "strict")
    with pytest.raises(design.DesignError):
        strict.apply(s)
    assert strict.bypass().apply(s).stages == result.stages and outer.kinds() == ["filter", "filter", "feature_extractor"]
    assert spec.Pipeline.restore(json.loads(json.dumps(strict.export()))) == strict
    assert spec.pipeline("o").add_pipeline(replace(lenient, enabled=False)).apply(s).stages == []
    with pytest.raises(ValueError):
        spec.pipeline("o").add_pipeline(spec.pipeline("empty")).validate()


def test_fallback_stages_run_in_place(spark):
    x = np.random.default_rng(13).normal(50, 9, 200)
    p = spec.pipeline("p").add("lowpass", cutoff=600.0).with_fallback("lowpass", "moving_average", size=4)
    result = p.apply(table(spark, x))
    assert result.stages == ["lowpass_fallback"] and "in place of lowpass" in result.warnings[0]
    assert np.allclose(values(result.samples), [x[max(0, i - 3) : i + 1].mean() for i in range(200)])
    assert spec.Pipeline.restore(json.loads(json.dumps(p.export()))) == p and p.apply(table(spark, x), 2000.0).stages == ["lowpass"]
    profile = profiles.Profile("f", on_error="fallback").add("low", "lowpass", cutoff=600.0).add("smooth", "moving_average", size=4).add("bad", "notch", frequency=-1.0).chain("c", ["low", "bad"])
    profile.fallbacks["low"] = "smooth"
    back = profiles.Profile.from_json(profile.to_json())
    assert back.to_pipeline("c").apply(table(spark, x)).stages == ["low_fallback"]


@pytest.mark.parametrize("make", [lambda: design.notch(0.0, 1000.0), lambda: design.notch(500.0, 1000.0), lambda: design.notch(50.0, 1000.0, 0.0), lambda: design.lowpass(0.0, 1000.0), lambda: design.highpass(-5.0, 1000.0)])
def test_frequencies_that_cannot_be(make):
    with pytest.raises(design.DesignError):
        make()
