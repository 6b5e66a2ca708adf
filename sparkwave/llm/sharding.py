"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters records uniformly into buckets that fit in memory: a seeded hash of the id picks the shard (the one
with the highest hash wins, so one more shard only takes rows), a seeded hash of the record picks a bucket of that
shard. Buckets are numbered densely and dealt to tasks in runs of neighbours, so tasks are of equal size; a task sorts
its records by bucket (that sort may spill) and holds one bucket at a time. Pass 2 shuffles each bucket (``shuffle``
is a Fisher-Yates shuffle) and writes it. A row's slot is its place in its bucket after the rows of the shard's earlier
buckets, whose sizes are read back from the written table.

The law is ``key``: doc_id and the number of shards decide alone. Buckets, and the order before the shuffle, follow
from records and the seed, so slots don't depend on how the input is partitioned. Only equal records that would
overfill a bucket are spread by their place in the input; they can't be told apart anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Scratch


def shards_of(key, shards: int, seed: int) -> tuple:
    """Rendezvous hashing: the shard whose seeded hash with the key is the highest, and the one with one more shard. A null key hashes like any other value."""
    hashed = lambda s: F.xxhash64(F.lit(seed), s, F.coalesce(key.cast("string"), F.lit("null")))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(hashed(s).alias("h"), s.alias("s"))))
    return best["s"], F.when(hashed(F.lit(shards)) >= best["h"], F.lit(shards)).otherwise(best["s"])


def dealing(spark: SparkSession, tasks: int) -> DataFrame:
    """(_task, _deal): for each task a number that hash partitioning over ``tasks`` sends to it. One small row a task."""
    tried = spark.range(40 * tasks + 400).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("_task"))
    return tried.groupBy("_task").agg(F.min("v").alias("_deal"))


def shuffled_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 20240229,
    bucket_bytes: int = 8 << 20,
    most_tasks: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_buckets: int = 100_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Rows of ``docs`` with shard, slot and grown_shard, read from the written shards.

    Columns of ``docs`` stay, but for earlier columns of those three names. ``size`` of a record is the UTF-8 bytes of
    its text (null: none) plus 1; the number of buckets follows from their sum over ``bucket_bytes``, which is to be a
    small part of a task's memory; at most ``most_tasks`` tasks share the buckets. Null ids are one key; ties and
    repeated rows keep a slot each; an empty table gives an empty result. A record longer than a bucket makes that
    bucket as long. Tables of at most ``broadcast_buckets`` rows (of buckets, of repeated records) are sent to all
    executors; longer ones are joined.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession)
    docs = docs.drop("shard", "slot", "grown_shard")
    names = [f"`{c}`" for c in docs.columns]
    key, size = F.col(f"`{id_col}`"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long") + 1
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]  # what can be hashed
    record = F.xxhash64(F.lit(seed + 1), *plain)
    side = lambda df, n: F.broadcast(df) if n <= broadcast_buckets else df

    copies = docs.groupBy(record.alias("_hash")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    hot = scratch.save(copies.where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes // 8)).select("_hash"), "repeated")
    total, n_hot = docs.agg(F.sum(size)).head()[0] or 0, hot.count()
    per_shard = max(1, -(-total // (bucket_bytes * shards)))
    buckets = per_shard * shards
    tasks = min(buckets, most_tasks)

    shard, grown = shards_of(key, shards, seed)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("_record"), shard.alias("_shard"), grown.alias("_grown"), record.alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    spread = F.lit(0).cast("long")  # _place is taken before any shuffle: a task that runs again gives the same
    if n_hot:
        rows = rows.join(side(hot.withColumn("_hot", F.lit(True)), n_hot), "_hash", "left")
        spread = F.when(F.col("_hot"), F.col("_place")).otherwise(0)
    rows = rows.withColumn("_spread", spread)
    number = F.col("_shard") * F.lit(per_shard).cast("long") + F.pmod(F.xxhash64(F.lit(seed + 2), "_hash", "_spread"), F.lit(per_shard))
    rows = rows.withColumn("_number", number).withColumn("_task", F.expr(f"cast(_number * {tasks} div {buckets} as int)"))
    dealt = rows.join(F.broadcast(dealing(spark, tasks)), "_task").select(
        "_deal", "_shard", "_number", "_hash", "_spread", F.struct("_record", "_grown").alias("_row")
    )
    ordered = dealt.repartition(tasks, "_deal").sortWithinPartitions("_deal", "_shard", "_number", "_hash", "_spread")
    path, by_sort = scratch.path("shards"), "spark.sql.execution.replaceHashWithSortAgg"
    was = spark.conf.get(by_sort)
    spark.conf.set(by_sort, "true")  # one bucket in memory at a time
    try:
        (
            ordered.groupBy("_deal", "_shard", "_number")
            .agg(F.collect_list("_row").alias("_held"))
            .select("_shard", "_number", F.posexplode(F.shuffle("_held", F.lit(seed))).alias("_at", "_row"))
            .select("_shard", "_number", "_at", "_row._grown", "_row._record")
            .write.parquet(path)
        )
    finally:
        spark.conf.set(by_sort, was)
    fields = [
        StructField("_shard", IntegerType()),
        StructField("_number", LongType()),
        StructField("_at", IntegerType()),
        StructField("_grown", IntegerType()),
        StructField("_record", docs.schema)
    ]
    written = spark.read.schema(StructType(fields)).parquet(path)
    counts = written.groupBy("_shard", "_number").count()
    before = counts.select("_number", (F.sum("count").over(Window.partitionBy("_shard").orderBy("_number")) - F.col("count")).alias("_before"))
    placed = written.join(side(before, buckets), "_number")
    return placed.select(
        *[F.col(f"_record.{c}") for c in names],
        F.col("_shard").alias("shard"),
        (F.col("_before") + F.col("_at")).cast("long").alias("slot"),
        F.col("_grown").alias("grown_shard")
    )
