"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, verified by Hamming distance.

A fingerprint is cut into ``blocks`` runs of bits. Two fingerprints that differ in at most ``most_bits`` bits agree
on at least ``blocks - most_bits`` whole blocks, so they meet under one of the keys made of that many blocks. Rows
of a key are compared where they meet and only a spanning forest of the links leaves the task, never all pairs.
Equal fingerprints are one row from the start. A key that too many fingerprints share is dealt out again on the
bits it hasn't used: the pair still agrees on one of ``most_bits + 1`` runs of those, so no link is lost and the
groups shrink until they fit.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, fresh, lookup, map_rows
from .components import components

ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text, unsigned. Null and texts without a word: 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    line, k = b" ".join(found), min(words, len(found))
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    n, ones = len(found) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        to = min(n, at + 65536)
        h = np.fromiter((digest(line[a : b - 1], 42) for a, b in zip(starts[at:to], ends[at + k - 1 : to + k - 1])), np.uint64, to - at)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << j for j in range(64) if 2 * ones[j] > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``. Other columns are left out, whatever their names."""

    def make():
        def run(rows):
            for i, text in rows:
                yield i, signed(fingerprint(text, words))

        return run

    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, fp long", make)


def runs(sizes: list[int], free: int) -> list[int]:
    """Masks of consecutive runs of the bits set in ``free``."""
    bits, out, at = [j for j in range(64) if free >> j & 1], [], 0
    for n in sizes:
        out.append(sum(1 << j for j in bits[at : at + n]))
        at += n
    return [m for m in out if m]


def even(total: int, parts: int) -> list[int]:
    return [total * (i + 1) // parts - total * i // parts for i in range(parts)]


def forest(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``most_bits`` of each other: at most one for each fingerprint."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= most_bits
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _links(most_bits: int):
    def make():
        def run(rows):
            key, held = None, []
            for mask, value, fp in rows:
                if (mask, value) != key:
                    yield from close(held)
                    key, held = (mask, value), []
                held.append(fp)
            yield from close(held)

        def close(held):
            if len(held) == 2:
                a, b = held
                if ((a ^ b) & ALL).bit_count() <= most_bits:
                    yield a, b
            elif len(held) > 2:
                for a, b in forest(np.array(held, np.int64).view(np.uint64), most_bits):
                    yield signed(a), signed(b)

        return run

    return make


def links(scratch: Scratch, fps: DataFrame, most_bits: int = 4, blocks: int = 6, group_limit: int = 50_000) -> DataFrame:
    """(a, b) long: links that connect distinct fingerprints ``fps`` (fp long) exactly as all pairs within ``most_bits`` would."""
    parts = runs(even(64, blocks), ALL)
    masks = [sum(c) for c in combinations(parts, blocks - most_bits)]
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    out = None
    while True:
        keyed = keyed.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        # A group of 2^16 can't be split on: it fits.
        splits = [m for m in masks if 64 - m.bit_count() > 16]
        hot = scratch.save(
            keyed.groupBy("mask", "value").count().where(F.col("count") > group_limit).where(
                F.col("mask").isin([signed(m) for m in splits])
            ).select("mask", "value"),
            "hot"
        )
        any_hot = not hot.isEmpty()
        calm = keyed.join(hot, ["mask", "value"], "left_anti") if any_hot else keyed
        found = map_rows(calm.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp"), "a long, b long", _links(most_bits))
        out = found if out is None else out.unionByName(found)
        if not any_hot:
            return out
        finer = {m: [m | r for r in runs(even(64 - m.bit_count(), most_bits + 1), ALL ^ m)] for m in splits}
        masks = sorted({x for v in finer.values() for x in v})
        deal = fps.sparkSession.createDataFrame([(signed(m), [signed(x) for x in v]) for m, v in finer.items()], "mask long, finer array<long>")
        keyed = keyed.join(hot, ["mask", "value"], "left_semi").join(deal, "mask").select("fp", F.explode("finer").alias("mask"))
        keyed = keyed.distinct()  # two coarse keys can lead to one finer key


def placed_fingerprints(scratch: Scratch, fps: DataFrame, most_bits: int, blocks: int, group_limit: int) -> DataFrame:
    """(fp, low, root) of distinct fingerprints: the smallest id that has it, and the component's smallest fingerprint."""
    low = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = scratch.save(components(scratch, links(scratch, low.select("fp"), most_bits, blocks, group_limit)), "roots")
    return scratch.save(low.join(roots, low.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "placed")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    most_bits: int = 4,
    blocks: int = 6,
    group_limit: int = 50_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), fp (long), component_id.

    component_id is the smallest doc_id reachable over links of at most ``most_bits`` differing bits, its own
    included. Texts without words have fingerprint 0 and link like any other. Rows whose id is null take part; they
    never are the smallest unless no other row is reachable, then component_id is null. Ties and repeated rows: one
    row out for each row in. An empty table gives an empty result. Extra columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    placed = placed_fingerprints(scratch, fps, most_bits, blocks, group_limit)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    of = scratch.save(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    placed_rows = lookup(scratch, fps, of, "fp")
    return placed_rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "component_id")


def retain_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    most_bits: int = 4,
    blocks: int = 6,
    group_limit: int = 50_000,
    broadcast_ids: int = 500_000,
) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with all columns: the one with the smallest id.

    A null id only stays where the component has no other; of rows with equal id and fingerprint one stays, the one
    whose columns hash lowest. Null and empty texts are one group. An empty table gives an empty result.

    Fingerprints are computed once. Ids of rows that go are told apart from the others, and at most ``broadcast_ids``
    of them are sent to all executors, which saves shuffling texts; beyond, texts are joined.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    fp, low, best_fp = fresh(docs, "_fp", "_id", "_best")
    fps = scratch.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    placed = placed_fingerprints(scratch, fps, most_bits, blocks, group_limit)
    best = placed.groupBy("root").agg(
        F.min(F.struct(F.col("low").isNull(), "low", "fp")).alias("best")
    ).select(F.col("best.low").alias(low), F.col("best.fp").alias(best_fp))
    chosen = scratch.save(best, "chosen")
    # An id on several rows (or null) doesn't tell which row was meant; any other does.
    ids = fps.groupBy("doc_id").agg(F.count("*").alias("n")).withColumnRenamed("doc_id", low)
    several = scratch.save(ids.where((F.col("n") > 1) | F.col(low).isNull()).select(low), "several")
    gone = ids.where((F.col("n") == 1) & F.col(low).isNotNull()).join(chosen.select(low), low, "left_anti").select(low)
    gone = scratch.save(gone.unionByName(several), "gone")
    n_gone, n_several = gone.count(), several.count()
    side = lambda df, n: F.broadcast(df) if n <= broadcast_ids else df.hint("shuffle_hash")
    same = docs[f"`{id_col}`"].eqNullSafe(F.col(low))
    kept = docs.join(side(gone, n_gone), same, "left_anti")
    if not n_several:
        return kept
    at, schema = names.index(text_col), docs.schema

    def marked():
        def run(rows):
            for row in rows:
                yield (*row, signed(fingerprint(row[at], words)))

        return run

    vague = map_rows(docs.join(side(several, n_several), same, "left_semi"), StructType([*schema.fields, StructField(fp, LongType())]), marked)
    meant = vague[f"`{id_col}`"].eqNullSafe(F.col(low)) & (F.col(fp) == F.col(best_fp))
    vague = vague.join(side(chosen, chosen.count()), meant, "left_semi")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    hashed = F.xxhash64(*[f"`{f.name}`" for f in schema.fields if "map<" not in f.dataType.simpleString()])
    once = vague.groupBy(F.col(f"`{id_col}`").alias(low), fp).agg(F.min_by(row, hashed).alias(best_fp))
    return kept.unionByName(once.select(*[F.col(f"{best_fp}.c{i}").alias(c) for i, c in enumerate(names)]))
