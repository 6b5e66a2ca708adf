"""Sessions, windows, repeats, late rows and pairs of streams against the same over tables; one stream to several sinks."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkwave.streaming import eventtime, fanout

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "user_id long, event_id long, ts timestamp, value double"


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def parts(spark, path, batches, schema=EVENTS):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read(spark, path, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, path, out):
    q = df.writeStream.foreachBatch(lambda x, n: out.extend(map(tuple, x.collect()))).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


BATCHES = [
    [(1, 1, at(0), 1.0), (1, 2, at(5), 3.0), (2, 3, at(2), None)],
    [(1, 4, at(12), 5.0), (2, 5, at(40), 7.0), (1, 2, at(5), 3.0)],
    [(1, 6, at(36), 2.0), (1, 8, None, 1.0)],  # 36 is within the allowed lateness
    [(2, 7, at(1), 9.0)],  # 1 isn't
    [(3, 9, at(1000), 0.0)],
]


@pytest.mark.parametrize("of, size", [(eventtime.sessions, "10 seconds"), (eventtime.tumbling, "20 seconds")])
def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path, of, size):
    path, out = str(tmp_path / "in"), []
    parts(spark, path, BATCHES)
    q = run(of(read(spark, path), ["user_id"], "ts", size, late="10 seconds"), str(tmp_path / "c"), out)
    table = spark.createDataFrame([r for b in BATCHES for r in b if r[1] != 7], EVENTS)
    want = [tuple(r) for r in of(table, ["user_id"], "ts", size).where("user_id < 3").collect()]
    assert sorted(out, key=str) == sorted(want, key=str) and len(out) == 4
    assert eventtime.late_rows(q) == 1


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    parts(spark, path, BATCHES)
    run(eventtime.once(read(spark, path).where("ts is not null"), ["event_id"], "ts", "1 hour"), str(tmp_path / "c"), out)
    assert sorted(r[1] for r in out) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert eventtime.once(spark.createDataFrame(BATCHES[0] * 2, EVENTS), ["event_id"], "ts", "0 seconds").count() == 3


SAMPLES = "signal_id string, channel int, idx long, ts timestamp, x double"


def test_pairs_of_streams(spark, tmp_path):
    """Chunk 2 is lost, chunk 3's processed samples come too late, chunk 4's before the raw ones."""
    raw = [[("s", 0, c * 5 + i, at(c * 5 + i), float(i)) for i in range(5)] for c in range(6)] + [[("s", 1, 999, at(10_000), 0.0)]]
    done = [[(*r[:3], r[3] + datetime.timedelta(seconds=60 if c == 3 else 1), r[4] * 2) for r in chunk] if c != 2 else [("s", 9, 0, at(11), 0.0)] for c, chunk in enumerate(raw[:6])] + [[("s", 9, 1, at(10_000), 0.0)]]
    a, b, out = str(tmp_path / "a"), str(tmp_path / "b"), []
    parts(spark, a, [*raw[:4], raw[5], raw[4], raw[6]], SAMPLES)
    parts(spark, b, done, SAMPLES)
    options = {"within": "10 seconds", "late": "2 minutes"}
    run(eventtime.paired_streams(read(spark, a, SAMPLES), read(spark, b, SAMPLES), **options), str(tmp_path / "c"), out)
    tables = [spark.createDataFrame([r for p in x for r in p], SAMPLES) for x in (raw, done)]
    want = [tuple(r) for r in eventtime.paired_streams(*tables, **options).where("channel = 0").collect()]
    assert sorted(out) == sorted(want, key=str) or sorted(map(str, out)) == sorted(map(str, want))
    lost = [r for r in out if not r[-1]]
    assert len(out) == 30 and sorted(r[2] for r in lost) == list(range(10, 20)) and all(r[5] is None for r in lost)


def test_zones_have_no_say(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:15.25' as ts")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(F.unix_micros(eventtime.instant(df, "ts"))).head()[0] == 1_711_852_215_250_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_one_read_for_several_sinks(spark, tmp_path):
    path, got, broken = str(tmp_path / "in"), {"raw": [], "sums": []}, [True]
    parts(spark, path, BATCHES)

    def raw(df, n):
        got["raw"].append((n, df.count()))

    def sums(df, n):
        if n == 1 and broken:
            broken.clear()
            raise OSError("disk full")
        got["sums"].append((n, df.agg(F.sum("value")).head()[0]))

    fan = fanout.FanOut(str(tmp_path / "marks"), raw=raw, sums=sums)
    start = lambda: read(spark, path).writeStream.foreachBatch(fan).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    first = start()
    with pytest.raises(Exception):
        first.awaitTermination()
    assert got == {"raw": [(0, 3), (1, 3)], "sums": [(0, 4.0)]} and "disk full" in fan.errors[0]
    q = start()
    q.awaitTermination()
    assert got == {"raw": [(0, 3), (1, 3), (2, 2), (3, 1), (4, 1)], "sums": [(0, 4.0), (1, 15.0), (2, 3.0), (3, 9.0), (4, 0.0)]}
    reports = [p for p in [*first.recentProgress, *q.recentProgress] if p["numInputRows"]]
    assert all(len(p["sources"]) == 1 for p in reports) and sum(p["numInputRows"] for p in q.recentProgress) == 7  # not once a sink
    assert fan.taken(spark, "raw") == fan.taken(spark, "sums") == 4 and fanout.Folder(spark, str(tmp_path / "marks" / "raw")).names() == ["4"]
    fan.remove("raw")
    with pytest.raises(ValueError):
        fan.add("sums", sums)
