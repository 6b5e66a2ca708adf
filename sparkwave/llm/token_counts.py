"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, n_tokens). Content is normalised first (runs of ASCII white
space become one space and the ends are trimmed, which no count depends on). Documents join the cache on both digests;
of each distinct digest that misses, one row's text is encoded, and the new counts are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, map_rows
from .token_ids import text_ids, version, vocabulary

CACHE = "content_digest string, n_tokens long, tokenizer_digest string"
CACHE_COLUMNS = ["content_digest", "n_tokens", "tokenizer_digest"]


def content_digest(text) -> F.Column:
    """Hex SHA-256 of the normalised text; null is empty."""
    # The six ASCII white-space characters.
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")), 256)


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    vocab: str | None = None,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_misses: int = 500_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, content_digest.

    Null texts are empty: 0 bytes, 0 tokens; long ones are encoded whole. Null ids and repeated rows give a row each; an
    empty table gives an empty result. Extra columns are left out. ``cache_path`` is a Parquet folder in shared storage,
    divided by tokenizer; it is made if it isn't there. At most ``broadcast_misses`` ids of texts to encode (160 bytes
    each with their digests) are sent to all executors, which saves shuffling texts; beyond, texts are joined.
    """
    spark = docs.sparkSession
    vocab, scratch = vocab or vocabulary(), scratch or Scratch(spark)
    tokenizer = version(vocab)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    digests = scratch.save(source.select("doc_id", n_bytes, content_digest(F.col("text")).alias("content_digest")), "digests")
    cache = lambda: spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == tokenizer)
    append = lambda df: df.write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    append(spark.createDataFrame([], CACHE))  # so that it can be read
    # The row that stands for a digest; what is in the cache already is left out. An id on several rows doesn't tell which.
    missing = scratch.save(digests.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id")).join(cache(), "content_digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        several = scratch.save(digests.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "several")
        n_several = several.count()
        side = lambda df, n: F.broadcast(df) if n <= broadcast_misses else df.hint("shuffle_hash")
        same_id = lambda df: F.col("t.doc_id").eqNullSafe(df["doc_id"])
        t = source.alias("t")
        if n_several:
            vague = side(several, n_several)
            clear = missing.join(vague, missing.doc_id.eqNullSafe(vague.doc_id), "left_anti")
            again = t.join(vague, same_id(vague), "left_semi").withColumn("content_digest", content_digest(F.col("text")))
            unclear = missing.join(vague, missing.doc_id.eqNullSafe(vague.doc_id), "left_semi")
            picked = again.join(side(unclear, n), "content_digest", "left_semi").select("text", "content_digest")
            texts = t.join(side(clear, n), "doc_id").select("text", "content_digest").unionByName(picked)
        else:
            texts = t.join(side(missing, n), "doc_id").select("text", "content_digest")

        def make():
            ids_of = text_ids(vocab).ids

            def run(rows):
                counts = BoundedMemo()  # repeated rows of a partition are encoded once
                for text, d in rows:
                    if d not in counts:
                        counts[d] = len(ids_of(text)) // 4
                        yield d, counts[d], tokenizer

            return run

        found = map_rows(texts, "content_digest string, n_tokens long, tokenizer_digest string", make)
        append(found.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens")).select(*CACHE_COLUMNS))
    # Appends of a job that was run twice may repeat a digest: its count is the same.
    known = cache().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = lookup(scratch, digests, known, "content_digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest")


class BoundedMemo(dict):
    """Forgets all when it is full: a digest then is counted again."""

    def __setitem__(self, key, value):
        if len(self) >= 200_000:
            self.clear()
        super().__setitem__(key, value)
