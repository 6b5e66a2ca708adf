"""Source divergence audit: how the terms of each source differ from those of other sources and of its language.

Spark deals counts out in shards by hash of language and term. In each shard DuckDB adds them up, keeps terms of enough
documents, and later gives partial sums for pairs of sources and each source's leading terms; Spark merges sums and
rankings. Shards hold all counts of their terms, so only totals of sources and languages have to travel between steps.

A pair's sum runs over all kept terms, but most terms are in few sources. With f0 for "neither has it", f(A and B have it)
is written as its difference from what A alone and B alone would give; so shards only join sources that share a term,
and the rest follows from how often each source has a term n times. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Bytes of text that are cut into terms at a time, and counts that a task holds before it hands them on.
CUT, HELD = 8 << 20, 2_000_000
#: A letter, or part of a character beyond ASCII; capital letters and what they become.
TERM_BYTE = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SCALE = 1_000_000_000


def database() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory, and no files of its own."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})


def terms(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(text's place, term) of every term of the texts, in order."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = TERM_BYTE[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    place = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    values = LOWER[data[inside]]
    return place, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(values))


def count_terms(cut: int = CUT, most: int = HELD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n, docs of a task's documents."""
        con = database()
        con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)").fetchall()

        def add(rows: list[tuple]) -> int:
            place, term = terms([t for _, _, t in rows])
            names = {"place": pa.array(range(len(rows)), pa.int64()), "lang": pa.array([r[0] for r in rows], pa.string()), "source": pa.array([r[1] for r in rows], pa.string())}
            con.register("names", pa.table(names))
            con.register("each", pa.table({"place": place, "term": term}))
            return con.execute(
                "INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM (SELECT place, term, count(*) AS n FROM each GROUP BY ALL) JOIN names USING (place) GROUP BY lang, source, term"
            ).fetchall()[0][0]

        def handed() -> Iterator[pa.RecordBatch]:
            found = con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY lang, source, term").to_arrow_table()
            con.execute("DELETE FROM held").fetchall()
            yield from found.to_batches(max_chunksize=20_000)

        rows, size, held = [], 0, 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                rows.append(row)
                size += len(row[2])
                if size >= cut:
                    held += add(rows)
                    rows, size = [], 0
                    if held > most:
                        yield from handed()
                        held = 0
        if rows:
            add(rows)
        yield from handed()

    return run


def kept_terms(least_docs: int):
    def run(key, table):
        """Counts of a shard's terms in enough documents of their language: a row for each source, and one without a source for the language."""
        con = database()
        con.register("counted", table)
        return con.sql(
            f"""
            WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM counted GROUP BY ALL),
                 t AS (SELECT lang, term, sum(n)::BIGINT AS n FROM s GROUP BY ALL HAVING sum(docs) >= {least_docs})
            SELECT {key[0].as_py()}::INT AS shard, lang, source, term, n FROM (SELECT lang, s.source, term, s.n FROM s JOIN t USING (lang, term) UNION ALL SELECT lang, NULL, term, n FROM t)"""
        ).to_arrow_table()

    return run


def partial_sums(top: int):
    def run(key, kept, totals):
        """Of a shard: part 'pair' for sources that share terms (their sum beyond what each alone gives), and the leading terms of each source."""
        con = database()
        con.register("kept", kept)
        con.register("totals", totals)
        return con.sql(
            f"""
            WITH g AS (SELECT lang, source, total, 1 + {SCALE} // total AS p0 FROM totals),
                 k AS MATERIALIZED (
                   SELECT kept.lang, kept.source, term, p0, (1 + {SCALE}::HUGEINT * (n + 1) // total)::BIGINT AS p
                   FROM kept JOIN g ON kept.lang = g.lang AND kept.source IS NOT DISTINCT FROM g.source),
                 together AS (
                   SELECT a.lang, a.source, b.source AS item,
                          sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p + (a.p0 - b.p0) * (a.p0 - b.p0) // b.p0) AS value
                   FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
                 lead AS (
                   SELECT a.lang, a.source, a.term AS item, (a.p - q.p) * (a.p - q.p) // q.p AS value
                   FROM k a JOIN k q ON a.lang = q.lang AND a.term = q.term AND a.source IS NOT NULL AND q.source IS NULL WHERE a.p > q.p
                   QUALIFY row_number() OVER (PARTITION BY a.lang, a.source ORDER BY value DESC, item) <= {top})
            SELECT lang, source, 'pair' AS part, item, value::DECIMAL(38, 0) AS value FROM together UNION ALL SELECT lang, source, 'term', item, value::DECIMAL(38, 0) FROM lead"""
        ).to_arrow_table()

    return run


def share(n: Column | str) -> Column:
    """p of a term with ``n`` occurrences, from the column total."""
    return F.expr(f"1L + (CAST({n} + 1 AS DECIMAL(28, 0)) * {SCALE}) div total")


def divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", shard_bytes: int = 8 << 20, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part, item, value (long), rank (int): every other source of the language, and each source's leading ``top`` terms.

    Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII; those in at least ``least_docs``
    documents of a language count. p = 1 + floor(10^9 (n + 1) / (N + V)) with N a source's (or language's) occurrences of
    kept terms and V their number; f = floor((p - q)^2 / q). Part ``pair``: f summed over all V terms, q the other
    source's. Part ``term``: terms that the source has, with p above the language's q. Ranks go by value downwards, then
    item in UTF-8 order. Null texts, languages and sources are empty ones; repeated rows count each; a source without
    terms has its pairs, a language with one source none. An empty table gives an empty result; other columns are left
    out. A shard stands for about ``shard_bytes`` of text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    prepare(spark)
    given = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = docs.select(*given)
    sizes = rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    groups = scratch.save(sizes, "groups")
    total = groups.agg(F.sum("bytes")).head()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    counts = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(count_terms(), "lang string, source string, term string, n long, docs long")
    sharded = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = scratch.save(sharded.groupBy("shard").applyInArrow(kept_terms(least_docs), "shard int, lang string, source string, term string, n long"), "kept")

    # N of each source and language, V of each language: null for a language as a whole, as in kept.
    number = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    of_lang = number.where("source is null").select("lang", F.col("n").alias("all_n"), F.col("terms").alias("v"))
    of_source = groups.join(number.where("source is not null"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    of_source = of_source.select("lang", "source", (zero("n") + zero("v")).alias("total"), zero("v").alias("v"))
    whole = of_lang.select("lang", F.lit(None).cast("string").alias("source"), (F.col("all_n") + F.col("v")).alias("total"), "v")
    totals = scratch.save(of_source.unionByName(whole), "totals")
    sources = totals.where("source is not null")

    everywhere = totals.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "lang", "source", "total")
    parts = scratch.save(
        kept.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(partial_sums(top), "lang string, source string, part string, item string, value decimal(38,0)"), "parts"
    )

    # Pairs: what each alone gives, from how many terms a source has n times, and what neither has.
    often = kept.where("source is not null").groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    often = often.join(sources, ["lang", "source"]).select("lang", "source", "times", share("n").alias("p"), share("0").alias("p0"))
    safe = sources.withColumn("total", F.greatest("total", F.lit(1)))
    one, two = safe.select("lang", "source", share("0").alias("p0"), "v"), safe.select("lang", F.col("source").alias("item"), share("0").alias("q0"))
    value = lambda times, f: (F.expr(times).cast("decimal(38,0)") * F.expr(f)).cast("decimal(38,0)").alias("value")
    neither = one.join(two, "lang").where("source <> item").select("lang", "source", "item", value("v", divergence("p0", "q0")))
    mine = often.join(two, "lang").where("source <> item").select("lang", "source", "item", value("times", f"{divergence('p', 'q0')} - {divergence('p0', 'q0')}"))
    theirs = often.select("lang", F.col("source").alias("item"), "times", F.col("p").alias("q"), F.col("p0").alias("q0")).join(one, "lang").where("source <> item")
    theirs = theirs.select("lang", "source", "item", value("times", f"{divergence('p0', 'q')} - {divergence('p0', 'q0')}"))
    shared = parts.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = neither.unionByName(mine).unionByName(theirs).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(parts.where("part = 'term'"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.withColumn("rank", place).where(f"part = 'pair' or rank <= {int(top)}")
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
