"""The query catalogue over the driver's tables: events as 16-channel samples, embeddings as ready-made windows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwave.functions import complexity, spectrum
from sparkwave.functions.patterns import PRESETS, mean_activation
from sparkwave.operators import analytic, design, features, filters, reshape, windows
from sparkwave.plans import profiles, spec
from sparkwave.sources import chunk_files
from sparkwave.sources import samples as sources
from sparkwave.sources.emg import Emg, Noise
from sparkwave.streaming import eventtime, live, stateful
from sparkwave.streaming.fanout import Folder

RATE = 1000.0
SIZE, OVERLAP = 64, 0.5


def r(col: str | Column, digits: int = 4) -> Column:
    """Rounded, without a negative zero: to be compared by value."""
    return F.round(col, digits) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), rate=RATE)


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.last_idx(spark.read.parquet(f"{sf_dir}/events.parquet"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.lit("embeddings").alias("signal_id"),
        F.col("vec_id").alias("chunk_seq"),
        F.lit(4).alias("channel_count"),
        F.col("embedding").alias("data")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def rounded(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Without signal_id, doubles rounded to 4 digits or as ``digits`` says."""
    return df.drop("signal_id").select(*[r(c, (digits or {}).get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in df.drop("signal_id").dtypes])


#: Large figures are rounded to fewer digits: sums in another order differ in their last ones.
LARGE = {"total_power": 0, "energy": 2, "low": 0, "mid": 0, "high": 0}
#: Means of samples with two decimals end at these digits; fewer would leave ties to the last bit.
EXACT = {"mean": 8, "mav": 8, "power": 10}


def bands(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "band_powers"], *[F.col("band_powers")[name].alias(name.lower()) for name, *_ in spectrum.EMG_BANDS])


def filtered(samples: DataFrame, sections) -> DataFrame:
    return rounded(filters.recursive(samples, sections, RATE).select("channel", "idx", F.col("x").alias("y")))


def deinterleave(spark, d):
    return rounded(sources.from_chunks(chunks(spark, d), RATE).drop("t"))


def reinterleave(spark, d):
    back = sources.to_chunks(sources.from_chunks(chunks(spark, d), RATE), 16)
    weighted = F.aggregate(F.transform("data", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rounded(
        back.select(
            "chunk_seq",
            "channel_count",
            F.size("data").cast("long").alias("n"),
            F.col("data")[5].alias("sixth"),
            weighted.alias("weighted")
        )
    )


def channel_stats(spark, d):
    return rounded(reshape.channel_stats(events(spark, d)))


def time_slice(spark, d):
    return rounded(reshape.time_slice(events(spark, d), 0.1, 0.35, RATE))


def time_vector(spark, d):
    return rounded(reshape.time_vector(events(spark, d), RATE))


def recent_window(spark, d):
    return rounded(reshape.recent(events(spark, d), last=last(spark, d)).select("channel", "idx", "x"))


def plot_columns(spark, d):
    return rounded(reshape.by_time(events(spark, d), 16).drop("t"))


def moving_average(size):
    return lambda spark, d: rounded(filters.moving_average(events(spark, d), size).select("channel", "idx", F.col("x").alias("y")), {"y": 6})


def moving_average_1000(spark, d):
    """Of roots of samples: means of many samples with two decimals would end in ties at any digit."""
    roots = events(spark, d).withColumn("x", F.sqrt(F.abs("x")))
    return rounded(filters.moving_average(roots, 1000).select("channel", "idx", F.col("x").alias("y")), {"y": 6})


def median_filter(size):
    return lambda spark, d: rounded(filters.median_filter(events(spark, d), size).select("channel", "idx", F.col("x").alias("y")))


SECTIONS = {
    "highpass_20": design.highpass(20.0, RATE),
    "highpass_10": design.highpass(10.0, RATE),
    "lowpass_450": design.lowpass(450.0, RATE),
    "lowpass_100_cascade_4": design.lowpass(100.0, RATE, 4, cascade=True),
    "notch_50_q10": design.notch(50.0, RATE, 10.0),
    "notch_50_q30": design.notch(50.0, RATE, 30.0),
    "notch_60_q50": design.notch(60.0, RATE, 50.0),
    "bandpass_20_450": design.bandpass(20.0, 450.0, RATE),
}
PIPELINES = {
    "pipeline_realtime": spec.realtime(),
    "pipeline_standard": spec.pipeline_for(spec.ServiceSpec("standard")),
    "pipeline_research": spec.pipeline_for(spec.ServiceSpec("research")),
    "pipeline_profile_realtime": profiles.realtime().to_pipeline("realtime"),
    # A pipeline as a stage of another: its high-pass is a true cascade, its low-pass can't run at this rate and is left out.
    "pipeline_nested": spec.pipeline("nested").add("notch", frequency=50.0).add_pipeline(
        replace(spec.pipeline("inner").add("lowpass", cutoff=900.0).add("highpass", cutoff=20.0, order=4).bypass(), cascade=True)
    ),
    "pipeline_fallback": spec.pipeline("fallback").add("lowpass", cutoff=600.0).with_fallback("lowpass", "moving_average", size=4),
}


def run_pipeline(pipeline: spec.Pipeline):
    return lambda spark, d: rounded(pipeline.apply(events(spark, d), RATE).samples.select("channel", "idx", "x_raw", F.col("x").alias("y")))


def raw_vs_processed(spark, d):
    raw = events(spark, d)
    return rounded(reshape.paired(raw, filters.recursive(raw, SECTIONS["highpass_20"], RATE)).drop("t"))


def emg_features(spark, d):
    """The flagship: events, high-pass and notch as one cascade, windows of 64 samples, all features."""
    result = spec.realtime().add("features", size=SIZE, overlap=OVERLAP).apply(events(spark, d), RATE)
    return rounded(bands(result.features[0]), LARGE)


def sliding_windows_64(spark, d):
    w = windows.sliding(events(spark, d), SIZE, OVERLAP)
    return rounded(
        w.select(
            "channel",
            "k",
            "start_sample",
            "n",
            F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("sum"),
            F.col("x")[0].alias("first"),
            F.col("x")[SIZE - 1].alias("last")
        )
    )


def time_features(spark, d):
    return rounded(features.features(events(spark, d), SIZE, OVERLAP, RATE, features.TIME), EXACT)


def stat_features(spark, d):
    return rounded(features.features(events(spark, d), SIZE, OVERLAP, RATE, features.STATISTICS), EXACT)


def complexity_features(spark, d):
    return rounded(features.features(events(spark, d), SIZE, OVERLAP, RATE, complexity.NAMES).select("channel", "k", *complexity.NAMES), dict.fromkeys(complexity.NAMES, 6))


def instantaneous_frequency(spark, d):
    return rounded(analytic.instantaneous(events(spark, d), RATE).select("channel", "idx", "amplitude", "frequency"))


def spectrum_64(spark, d):
    p = spectrum.power_spectrum(vectors(spark, d))
    return rounded(p.select("k", F.posexplode("p").alias("bin", "p")).select("k", "bin", (F.col("bin") * RATE / SIZE).alias("freq"), "p"))


def spectral_features(spark, d):
    names = [*spectrum.FEATURES, "spectral_edge_95"]
    return rounded(features.window_spectra(vectors(spark, d), RATE, names).select("k", *names))


def band_powers(spark, d):
    return rounded(bands(features.features(events(spark, d), SIZE, OVERLAP, RATE, ["band_powers"])).select("channel", "k", "low", "mid", "high"), LARGE)


def bands_out_of_range(spark, d):
    """A band that reaches to half the rate, and one beyond."""
    found = features.features(events(spark, d), SIZE, OVERLAP, RATE, ["band_powers"], [("Top", 450.0, 600.0), ("Beyond", 600.0, 700.0)])
    return rounded(found.select("channel", "k", *[F.col("band_powers")[n].alias(n.lower()) for n in ("Top", "Beyond")]), {"top": 0})


def feature_summary(spark, d):
    return rounded(features.summary(features.features(events(spark, d), SIZE, OVERLAP, RATE, features.SUMMARY)), LARGE | EXACT)


def pattern_presets(spark, d):
    rows = [
        spark.range(1).select(
            F.lit(n).alias("name"),
            F.lit(p.kind).alias("kind"),
            F.lit(p.description).alias("description"),
            mean_activation(p, 10.0).alias("mean_activation")
        ) for n,
        p in PRESETS.items()
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return rounded(out)


def activation_patterns(spark, d):
    t = spark.range(200).select((F.col("id") / 10.0 + 0.05).alias("t"))
    return rounded(
        t.select(
            "t",
            F.explode(
                F.array(*[F.struct(F.lit(n).alias("name"), p.at(F.col("t")).alias("activation")) for n, p in PRESETS.items()])
            ).alias("s")
        ).select("t", "s.name", "s.activation")
    )


CLEAN = Emg(channels=4, pattern=PRESETS["Fast Contraction"], noise=Noise.off(), powerline=None, recruitment=0.0)


def simulate_clean(spark, d):
    return rounded(CLEAN.samples(spark, 2.0))


def simulate_powerline(spark, d):
    return rounded(CLEAN.with_(powerline=50.0).samples(spark, 2.0))


def simulate_noisy(spark, d):
    return Emg(channels=4, pattern=PRESETS["Natural Movement"], seed=7).samples(spark, 2.0)


def simulate_metadata(spark, d):
    return CLEAN.metadata(spark, 2.0).withColumn("activation_level", r("activation_level"))


def chunk_stats(spark, d):
    return rounded(reshape.chunk_stats(events(spark, d)), EXACT)


def buffer_stats(spark, d):
    return rounded(reshape.buffer_stats(events(spark, d), 100, RATE))


def chunk_start_times(spark, d):
    """Of every chunk of the signal, whichever channels reach it."""
    return rounded(reshape.rebased(reshape.chunk_durations(events(spark, d), 100, RATE)))


def processing_stats(spark, d):
    return rounded(live.chunk_metrics(spec.realtime().apply(events(spark, d), RATE).samples))


def signal_lengths(spark, d):
    return rounded(reshape.lengths(events(spark, d), RATE))


def sample_violations(spark, d):
    """Events that aren't numbered yet break the rules; their channels are listed."""
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = e.select(
        F.lit("events").alias("signal_id"),
        F.pmod("user_id", F.lit(20)).cast("int").alias("channel"),
        F.col("event_id").alias("idx"),
        F.col("value").alias("x")
    )
    return reshape.violations(raw).drop("signal_id")


def latest_chunk(spark, d):
    return rounded(reshape.latest_chunk(events(spark, d), last=last(spark, d)).select("channel", "idx", "x"))


def buffer_tail(spark, d):
    return rounded(reshape.buffer_tail(events(spark, d), last=last(spark, d)).select("channel", "idx", "x"))


def plot_tail(spark, d):
    return rounded(reshape.plot_tail(events(spark, d), last=last(spark, d)).select("channel", "idx", "x"))


def config_latency(spark, d):
    known = [p() for n, p in profiles.PROFILES.items() if n != "custom"]
    return rounded(profiles.latencies(*profiles.tables(spark, known)))


def config_unknown_processors(spark, d):
    broken = profiles.realtime().chain("broken", ["rt_highpass", "missing"])
    return profiles.unknown_processors(*profiles.tables(spark, [broken, profiles.research()]))


def in_order(rows: DataFrame, ts: str, path: str, parts: int = 3, most_rows: int = 1_000_000, most_files: int = 64) -> int:
    """Writes ``rows`` as successive runs of time, each as so many files, which is returned: for streams that read a run at a time.

    There are ``parts`` runs at least, and so many that one has at most ``most_files`` files of about ``most_rows`` rows.
    """
    at = sources.seconds(rows, ts)
    count = rows.count()
    parts = max(parts, -(-count // (most_files * most_rows)))
    edges = rows.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)])).head()[0]
    files = max(1, -(-count // (parts * most_rows)))
    bounds = [None, *(edges or []), None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows if low is None else rows.where(at > low)
        (part if high is None else part.where(at <= high)).repartition(files).write.mode("append").parquet(path)
    return files


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share; it goes when the driver exits."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="sparkwave-")
    out = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            Folder(spark, out).delete()
        except Exception:  # noqa: BLE001  the session may have ended
            pass

    atexit.register(clear)
    return out


def dated_events(spark: SparkSession, d: str) -> DataFrame:
    """user_id, ts (a point in time), event_id, value of the events that have a user and a time."""
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id is not null and ts is not null")
    return e.select("user_id", eventtime.instant(e, "ts").alias("ts"), "event_id", "value")


def live_events(rows: DataFrame, path: str, closing: bool = False) -> DataFrame:
    """``rows`` written in runs of time, and read as a stream of as many micro-batches; ``closing``: a last row a year later, whose numbers are -1, ends all windows."""
    spark = rows.sparkSession
    files = in_order(rows, "ts", path)
    if closing:
        end = rows.agg((F.max("ts") + F.expr("interval 1 year")).alias("ts")).where("ts is not null")
        end.select(*[F.col("ts") if c == "ts" else F.lit(-1).cast(t).alias(c) for c, t in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def written(stream: DataFrame, out: str) -> DataFrame:
    """Runs a stream to its end into Parquet; what has been written. Input and checkpoint are deleted."""
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for name in ("checkpoint", "in", "in-2"):
        Folder(stream.sparkSession, out).delete(name)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def as_samples(stream: DataFrame) -> DataFrame:
    return stream.select(F.lit("events").alias("signal_id"), F.pmod("user_id", F.lit(16)).cast("int").alias("channel"), "ts", "event_id", F.col("value").alias("x"))


def streamed(spark: SparkSession, d: str, sink_of) -> DataFrame:
    """The events as a stream of several micro-batches into ``sink_of(order, bucket, out)``; the rows it has written."""
    out = folder(spark)
    rows = as_samples(live_events(dated_events(spark, d), f"{out}/in"))
    sink = sink_of(["ts", "event_id"], F.floor(sources.seconds(rows, "ts") / 3600), out)
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for name in Folder(spark, out).names():
        if name != "rows":
            Folder(spark, out).delete(name)
    return rounded(sink.rows(spark).select("channel", "idx", "x_raw", F.col("x").alias("y")))


def stream_state_equals_batch(spark, d):
    """The same pipeline with what it remembers in Spark's state store."""
    out = folder(spark)
    rows = as_samples(live_events(dated_events(spark, d), f"{out}/in"))
    done = stateful.stream_channels(rows, PIPELINES["pipeline_profile_realtime"], ["ts", "event_id"], RATE)
    return rounded(written(done, out).select("channel", "idx", "x_raw", F.col("x").alias("y")))


def _events_by_time(spark, d, of, size):
    out = folder(spark)
    found = of(live_events(dated_events(spark, d), f"{out}/in", closing=True), ["user_id"], "ts", size, late="10 minutes")
    done = written(found, out).where("user_id >= 0")
    return rounded(done.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "mean", "rms", "min_value", "max_value"))


def session_features(spark, d):
    """Sessions of users, closed by half an hour without an event, from a stream."""
    return _events_by_time(spark, d, eventtime.sessions, "30 minutes")


def tumbling_features(spark, d):
    return _events_by_time(spark, d, eventtime.tumbling, "6 hours")


def paired_streams(spark, d):
    """Raw samples beside clamped ones, which come a second later; every seventh is lost."""
    out, e = folder(spark), dated_events(spark, d)
    done = e.where("event_id % 7 <> 3").select("user_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), "event_id", F.greatest(F.lit(20.0), F.least(F.lit(60.0), "value")).alias("value"))
    raw, processed = (
        as_samples(live_events(rows, f"{out}/{name}", closing=True)).withColumnRenamed("event_id", "idx") for rows, name in ((e, "in"), (done, "in-2"))
    )
    both = written(eventtime.paired_streams(raw, processed, within="10 seconds", late="1 minute"), out).where("idx >= 0")
    return rounded(both.select("channel", "idx", "x_raw", "x", "success"))


def chunk_file_slice(spark, d):
    """Chunks of 25 turns of four channels of embeddings, written by signal and run, of which a slice is read back."""
    out = folder(spark)
    whole = sources.from_chunks(chunks(spark, d), RATE)
    chunk_files.write(whole, f"{out}/chunks", turns=25, run=8)
    return rounded(chunk_files.read_samples(spark, f"{out}/chunks", RATE, signals=["embeddings"], first=5, last=20, run=8))


def stream_filter_equals_batch(spark, d):
    return streamed(spark, d, lambda order, bucket, out: live.BlockSink(spec.realtime().sections(RATE), order, bucket, out, RATE))


def stream_pipeline_equals_batch(spark, d):
    """Filters and a moving average, which remembers samples from one micro-batch to the next."""
    return streamed(spark, d, lambda order, bucket, out: live.PipelineSink(PIPELINES["pipeline_profile_realtime"], order, bucket, out, RATE))


def highpass_with_gaps(spark, d):
    """Channels that begin late and lack every seventh sample: idx stays, samples count one after the other."""
    s = events(spark, d).where("idx >= 40 and idx % 7 <> 3")
    return filtered(s, SECTIONS["highpass_20"])


def one_channel(spark, d):
    return rounded(reshape.channel(events(spark, d), 3, 16).select("channel", "idx", "x"))


def clamped(spark, d):
    return rounded(reshape.clamp(events(spark, d), 20.0, 60.0).select("channel", "idx", "x"))


def windows_of_one(spark, d):
    """The smallest windows there are: one sample each, whose statistics have their values for fewer than two samples."""
    return rounded(features.features(events(spark, d), 1, 0.0, RATE, ["mean", "variance", "zero_crossings", "waveform_length", *features.STATISTICS]))


def signal_quality(spark, d):
    """Of the real-time pipeline's output; a channel with a sample that is no number has a lower score."""
    s = events(spark, d).withColumn("x", F.when((F.col("channel") == 2) & (F.col("idx") == 30), F.lit(float("nan"))).otherwise(F.col("x")))
    return rounded(reshape.signal_quality(spec.realtime().apply(s, RATE).samples))


def expected_samples(spark, d):
    """Embeddings as chunks that announce 16 samples of 4 channels; every tenth announces one more."""
    c = chunks(spark, d).withColumns({"sampling_rate": F.lit(RATE), "duration": F.when(F.col("chunk_seq") % 10 == 0, 0.017).otherwise(0.016)})
    return reshape.expected_samples(c).drop("signal_id")


def pipeline_with_own_stage(spark, d):
    """A user's stage between filters: rectification."""
    p = spec.pipeline("envelope").add("highpass", cutoff=20.0).add_stage(
        "rectify", lambda s, rate: s.withColumn("x", F.abs("x"))
    ).add("moving_average", size=10)
    return rounded(p.apply(events(spark, d), RATE).samples.select("channel", "idx", "x_raw", F.col("x").alias("y")))


def queries() -> dict:
    plain = [
        emg_features, deinterleave, reinterleave, channel_stats, time_slice, time_vector, recent_window, plot_columns, raw_vs_processed, sliding_windows_64, time_features,
        stat_features, complexity_features, instantaneous_frequency, spectrum_64, spectral_features, band_powers, bands_out_of_range, feature_summary, pattern_presets, activation_patterns, simulate_clean, simulate_powerline, simulate_noisy, simulate_metadata,
        chunk_stats, buffer_stats, chunk_start_times, processing_stats, signal_lengths, sample_violations, latest_chunk, buffer_tail, plot_tail, config_latency, config_unknown_processors, stream_filter_equals_batch,
        stream_pipeline_equals_batch, stream_state_equals_batch, session_features, tumbling_features, paired_streams, chunk_file_slice, highpass_with_gaps, one_channel, clamped, windows_of_one, signal_quality, expected_samples, pipeline_with_own_stage,
    ]
    out = {f.__name__: f for f in plain}
    out |= {f"moving_average_{n}": moving_average(n) for n in (3, 10)} | {"moving_average_1000": moving_average_1000} | {f"median_filter_{n}": median_filter(n) for n in (5, 101)}
    out |= {n: (lambda spark, d, s=s: filtered(events(spark, d), s)) for n, s in SECTIONS.items()}
    return out | {n: run_pipeline(p) for n, p in PIPELINES.items()}
