"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that hold it over the host's pages; lines
above ``ratio`` that are on at least two pages are boilerplate of that host and are dropped from its pages.

A page holds each line once for counting, so the counts of all hosts sum to at most the lines of their pages: a host
has at most (mean lines a page) / ratio boilerplate lines. That bounded set is joined to the pages by host; texts are
never exploded and regrouped. A page's own boilerplate is the intersection of two hash sets; the few pages with many
different boilerplate lines are cut by a Python set, so the work grows with a page's lines and not with their square.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import Scratch, fresh, prepare

#: Different boilerplate lines of a page up to which they are looked up one by one.
FEW = 16
#: Pages of a host that one task gets where pages are joined by host, and hosts with more at most.
HOST_PAGES, HOT_HOSTS = 50_000, 10_000


def bare(line):
    """A line without the white space around it."""
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def line_key(line):
    """128 bits that stand for a bare line: two seeded hashes of it."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def boilerplate(pages: DataFrame, ratio: float, least_pages: int, host_col: str, text_col: str) -> DataFrame:
    """host, line (a, b): lines on more than ``ratio`` of a host's pages."""
    page = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), bare), lambda x: x != "")
    each = page.select("host", F.explode(F.transform(F.array_distinct(lines), line_key)).alias("line"))  # distinct as strings: structs have no hash set
    on = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    total = page.groupBy("host").agg(F.count("*").alias("pages"))
    return on.alias("o").join(
        total.alias("t"), F.col("o.host").eqNullSafe(F.col("t.host"))
    ).where(F.col("n") > F.lit(ratio) * F.col("pages")).select("o.host", "line")


def drop_boilerplate(
    pages: DataFrame,
    ratio: float = 0.1,
    least_pages: int = 2,
    host_col: str = "source",
    text_col: str = "text",
    broadcast_lines: int = 200_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text, and n_lines, n_dropped (long).

    Lines are split at \\n, in texts of any length, and compared without surrounding white space; blank lines are never
    counted or dropped. A line on one page only is never boilerplate, so the only page of a host keeps its lines. Every row
    stays, also if no line is left (empty text). A null host is a host of its own; a null text has no lines and stays
    null. Repeated rows count as pages each. An empty table gives an empty result. Other columns pass through; earlier
    columns named n_lines or n_dropped are replaced. At most ``broadcast_lines`` lines are sent to all executors; more are joined.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    prepare(pages.sparkSession)
    pages = pages.drop("n_lines", "n_dropped")
    found = scratch.save(boilerplate(pages, ratio, least_pages, host_col, text_col), "boilerplate")
    host, bad, part, lines, keys, hit, cut = fresh(pages, "_host", "_bad", "_part", "_lines", "_keys", "_hit", "_cut")
    of_host, text_ = F.col(f"`{host_col}`"), F.col(f"`{text_col}`")
    by_host = found.groupBy("host").agg(F.collect_set(one_key("line")).alias(bad)).select(F.col("host").alias(host), bad)
    if found.limit(broadcast_lines + 1).count() <= broadcast_lines:
        joined = pages.join(F.broadcast(by_host), of_host.eqNullSafe(F.col(host)), "left")
    else:
        joined = spread(pages, by_host, of_host, text_, host, part)
    split = F.split(text_, "\n", -1)
    joined = joined.withColumn(lines, F.when(text_.isNotNull(), split))
    bare_key = lambda x: F.when(bare(x) != "", one_key(line_key(bare(x))))
    joined = joined.withColumn(keys, F.when(F.col(bad).isNotNull(), F.transform(lines, bare_key)))
    joined = joined.withColumn(hit, F.array_intersect(keys, bad))
    many = F.size(hit) > FEW
    joined = joined.withColumn(cut, _without(*[F.when(many, F.col(c)) for c in (lines, keys, hit)]))
    kept = F.filter(F.arrays_zip(F.col(lines).alias("line"), F.col(keys).alias("key")), lambda x: x["key"].isNull() | ~F.array_contains(F.col(hit), x["key"]))["line"]
    kept = F.when(many, F.col(cut)).when(F.size(hit) > 0, kept)
    joined = joined.withColumn(cut, kept)
    n = F.when(text_.isNotNull(), F.size(lines)).otherwise(0)
    left = F.when(F.col(cut).isNull(), n).otherwise(F.size(cut))
    text = F.when(F.col(cut).isNull(), text_).otherwise(F.array_join(cut, "\n"))
    return joined.select(
        *[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in pages.columns], n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped")
    )


def one_key(line):
    """A line's key as one string."""
    line = F.col(line) if isinstance(line, str) else line
    return F.concat_ws(":", line["a"].cast("string"), line["b"].cast("string"))


@F.pandas_udf(ArrayType(StringType()))
def _without(lines: pd.Series, keys: pd.Series, hit: pd.Series) -> pd.Series:
    def one(row):
        if row[0] is None:
            return None
        gone = set(row[2])
        return [x for x, k in zip(row[0], row[1]) if k not in gone]

    return pd.Series([one(row) for row in zip(lines, keys, hit)], dtype=object)


def spread(pages: DataFrame, by_host: DataFrame, of_host, text, host: str, part: str) -> DataFrame:
    """``pages`` left-joined to ``by_host``; a host with many pages is dealt out by their texts, its lines go along to each part."""
    key, parts, copy = fresh(pages, "_h", "_parts", "_copy")
    counts = pages.groupBy(of_host.alias(key)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    size = max(HOST_PAGES, total // HOT_HOSTS)
    hot = F.broadcast(counts.where(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias(parts)))  # HOT_HOSTS rows at most
    dealt = pages.join(hot, of_host.eqNullSafe(F.col(key)), "left")
    dealt = dealt.withColumn(part, F.coalesce(F.pmod(F.xxhash64(text), F.col(parts)), F.lit(0)).cast("int")).drop(key, parts)
    copies = by_host.join(hot, F.col(host).eqNullSafe(F.col(key)), "left")
    copies = copies.select(*by_host.columns, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1)).alias(copy))
    return dealt.join(copies, of_host.eqNullSafe(F.col(host)) & (F.col(part) == F.col(copy)), "left").drop(copy)
