"""Connected components over an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node long, root long) for every node of ``edges`` (a long, b long); root is the smallest reachable node.

    Each round points neighbours at the smallest node seen, so depth halves. A round's edges are written to the
    shared folder. Self loops, repeats, both directions and nulls are allowed (nulls and loops are left out).
    Minima are pre-aggregated before the shuffle; a hub's neighbours are joined under adaptive skew handling.
    """
    now = scratch.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        scratch.drop(now)
        was, state, now = state, _state(after), after
        if was == state:
            break
    else:
        raise RuntimeError("components: no fixed point")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b", "b").distinct().toDF("node", "root"))


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free hashes that tell whether the distinct edges are still the same; no number of edges overflows them."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(7), "a", "b"))).head())
