"""Runs of samples: order-dependent steps without a whole channel in one task.

A channel may hold a third of all rows. It is cut into blocks of ``length`` samples; a row also goes to the next block
if rows there look back at it, and to the one before if rows there look ahead. Window functions, or numpy over
Arrow tables, then work on one block, whose size is bounded. A window reaches back over idx, not over rows: where idx
has gaps it holds fewer samples, in any block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkwave.session import importable

BLOCK = 32_768


def with_halo(samples: DataFrame, before: int, length: int = BLOCK, after: int = 0) -> DataFrame:
    """``samples`` with _block: each row in its own block, and in those that hold a row at most ``before`` after it or ``after`` before it."""
    first, last = F.expr(f"(idx - {after}) div {length}") if after else F.expr(f"idx div {length}"), F.expr(f"(idx + {before}) div {length}")
    # A block beyond the channel's end only gets rows to look back at; rolling() drops those.
    return samples.withColumn("_block", F.explode(F.sequence(first, last)))


def in_block() -> Window:
    return Window.partitionBy("signal_id", "channel", "_block").orderBy("idx")


def rolling(samples: DataFrame, before: int, out: dict[str, Column], length: int = BLOCK) -> DataFrame:
    """``samples`` with the columns ``out``, window expressions over ``in_block()`` that look back over ``before`` of idx at most."""
    length = max(length, before + 1)
    computed = with_halo(samples, before, length).withColumns(out)
    return computed.where(F.expr(f"idx div {length}") == F.col("_block")).drop("_block")


def by_block(samples: DataFrame, before: int, make: Callable, new: list[str], col: str = "x", length: int = BLOCK, after: int = 0) -> DataFrame:
    """``samples`` with the double columns ``new`` (which may replace some), by numpy over blocks; one shuffle.

    ``make(idx, x, real)`` gets a block's rows and their halo in order of idx, x with NaN where ``real`` is false (null),
    and gives for each of ``new`` the values and where they are not null. Other columns pass through.
    """
    importable(samples.sparkSession)
    length = max(length, before + after + 1)
    kept = [c for c in samples.columns if c not in new]
    names = [*samples.columns, *(n for n in new if n not in samples.columns)]
    place = {n: f"c{i}" for i, n in enumerate(names)}  # whatever characters names have
    key = [place["signal_id"], place["channel"]]
    dealt = with_halo(samples, before, length, after)
    dealt = dealt.select(*[F.col(f"`{c}`").alias(place[c]) for c in samples.columns], "_block", (F.expr(f"idx div {length}") == F.col("_block")).alias("_mine"))
    types = {f.name: f.dataType for f in samples.schema} | dict.fromkeys(new, DoubleType())
    schema = StructType([StructField(place[n], types[n]) for n in names])

    def run(table):
        idx = table.column(place["idx"]).to_numpy()
        order = np.argsort(idx, kind="stable")
        given = table.column(place[col]).combine_chunks()
        real = given.is_valid().to_numpy(zero_copy_only=False)[order]
        x = given.cast(pa.float64()).to_numpy(zero_copy_only=False)[order]
        found = make(idx[order], x, real)
        mine = table.column("_mine").to_numpy()[order].astype(bool)
        rows = table.select([place[c] for c in kept]).take(pa.array(order[mine]))
        columns = {place[n]: pa.array(values[mine], pa.float64(), mask=~some[mine]) for n, (values, some) in zip(new, found)}
        return pa.table([columns[n] if n in columns else rows.column(n) for n in schema.names], names=schema.names)

    return dealt.groupBy(*key, "_block").applyInArrow(run, schema).toDF(*names)
