"""Embedding near-duplicates with spherical-cap filters from structured random product codes.

Vectors are rotated at random and cut into ``blocks`` parts; each part has a codebook of ``codewords`` random unit
vectors, and every combination of one codeword per part is a filter direction. A vector is list-decoded to all
directions whose inner product exceeds the threshold, which is calibrated on random unit vectors so that a list has
``list_size`` entries on average. Several such codes are used, since one code leaves a few vectors with short lists.
The codebooks grow with the number of vectors once they must for unrelated ones to meet as rarely as ``load`` says, and
lists with them, so that recall stays. Near vectors share a filter with high probability; they are joined on filters
and verified by cosine in double precision.

Equal vectors are one class from the start, and classes close around one of them are one ball: with a radius of a
small part of the angle that links, all members of a ball link with each other. Balls are compared by their centres;
where centres and radii leave open which members link, the members are compared, in blocks. So a tight cluster of any
size costs what its few balls cost, and every count stays exact.

Only filters that several balls share are kept before vectors are moved. In a filter's group each pair counts only under
its first common filter, so counts need no list of pairs: a group hands on its members' counts and a spanning forest of
its links. Groups of more than ``group_limit`` members are dealt out in pairs of chunks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, map_rows
from .components import components


class Filters:
    """The product code number ``code`` for vectors of ``dim`` components."""

    def __init__(self, dim: int, blocks: int, codewords: int, list_size: float, code: int = 0, seed: int = 7):
        rng = np.random.default_rng([seed, code, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        self.cuts = np.array_split(np.arange(dim), max(1, min(blocks, dim // 4)))
        m = len(self.cuts)
        self.words = codewords
        self.first = code * self.words**m
        books = [rng.standard_normal((self.words, len(c))) for c in self.cuts]
        self.books = [(b / np.linalg.norm(b, axis=1, keepdims=True)).astype(np.float32) for b in books]
        trial = rng.standard_normal((64, dim))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        # Scores spread by sqrt(m / dim); the threshold is where about list_size of all directions are left.
        low, high = min(2.5 * np.sqrt(m / dim), 0.6 * np.sqrt(m)), float(np.sqrt(m))
        parts = self.halves(trial)
        for _ in range(20):
            self.least = (low + high) / 2
            lists = np.mean([len(self.over(*p)) for p in zip(*parts)])
            low, high = (self.least, high) if lists > list_size else (low, self.least)
        self.least = low

    def halves(self, unit: np.ndarray) -> list[np.ndarray]:
        """Scores of all combinations within the first and within the second half of the parts."""
        turned = unit.astype(np.float32) @ self.rotation
        scores = [turned[:, c] @ b.T for c, b in zip(self.cuts, self.books)]
        k = (len(scores) + 1) // 2
        out = []
        for group in (scores[:k], scores[k:]):
            total = np.zeros((len(unit), 1), np.float32)
            for s in group:
                total = (total[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
            out.append(total)
        return out

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the directions that exceed the threshold, ascending."""
        i, j = np.flatnonzero(a >= self.least - b.max()), np.flatnonzero(b >= self.least - a.max())
        x, y = np.nonzero(a[i][:, None] + b[j][None, :] >= self.least)
        return self.first + np.sort(i[x] * len(b) + j[y])

    def lists(self, unit: np.ndarray) -> list[np.ndarray]:
        return [self.over(*p) for at in range(0, len(unit), 64) for p in zip(*self.halves(unit[at : at + 64]))]


@lru_cache(maxsize=32)
def filters(dim: int, blocks: int, codewords: int, list_size: float, code: int) -> Filters:
    return Filters(dim, blocks, codewords, list_size, code)


def units(vectors) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(rows, at: int, most: int = 256):
    """Lists of rows whose arrays at place ``at`` have one length."""
    held: dict[int, list] = {}
    for row in rows:
        same = held.setdefault(len(row[at]), [])
        same.append(row)
        if len(same) == most:
            yield held.pop(len(row[at]))
    yield from held.values()


def _celled(codewords):
    """(id, vec) and the vector's cell: the best direction of a small code. Close vectors mostly have the same one."""

    def make():
        def run(rows):
            for same in by_length(rows, 1):
                x = units([r[1] for r in same])
                f = filters(x.shape[1], 2, codewords, 15.0, 99)
                best = [h.argmax(axis=1) for h in f.halves(x)]
                cell = best[0] * f.words ** max(1, len(f.cuts) // 2) + best[1] if len(f.cuts) > 1 else best[0]
                for row, c in zip(same, cell.tolist()):
                    yield (*row, c)

        return run

    return make


def angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _balls(most: float):
    """Rows (id, vec, n, centre's id, centre): the ball they belong to (the centre's, or their own if it is too far), and how far from it."""

    def make():
        def run(rows):
            for same in by_length(rows, 1):
                x, c = units([r[1] for r in same]), units([r[4] for r in same])
                far = angle((x * c).sum(axis=1))
                for (i, vec, n, centre, _), d in zip(same, far.tolist()):
                    yield (i, vec, n, centre, d) if i != centre and d <= most else (i, vec, n, i, 0.0)

        return run

    return make


def _decoded(codes, blocks, codewords, list_size):
    def make():
        def run(rows):
            for same in by_length(rows, 1):
                yield from decode(same)

        def decode(same):
            x = units([r[1] for r in same])
            of_code = [filters(x.shape[1], blocks, codewords, list_size, c).lists(x) for c in range(codes)]
            for row, *found in zip(same, *of_code):
                yield (*row, np.concatenate(found).tolist())

        return run

    return make


#: Angles are uncertain by less than this.
EDGE = 1e-6


def _compared(least: float):
    """Rows (dim, filter, i, j, chunk, id, n, radius, vec, list), sorted by group: counts of links and a forest of them; pairs that centres leave open."""
    limit = float(np.arccos(least))

    def make():
        def run(rows):
            key, held = None, []
            for row in rows:
                if row[:4] != key:
                    yield from group(key, held)
                    key, held = row[:4], []
                held.append(row[4:])
            yield from group(key, held)

        def group(key, held):
            if len(held) < 2:
                return
            _, this, one, two = key
            chunk = np.array([h[0] for h in held])
            ids, n, radius = [h[1] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held])
            x = units([h[4] for h in held])
            counts, label = np.zeros(len(held), np.int64), np.arange(len(held))
            pairs = []
            for at in range(0, len(held), 256):
                cosine = x[at : at + 256] @ x.T
                wide = radius[at : at + 256, None] + radius[None, :]
                if wide.any():
                    apart, plain = angle(cosine), wide == 0
                    sure = np.where(plain, cosine >= least, apart + wide <= limit - EDGE)
                    near = np.where(plain, sure, apart - wide <= limit + EDGE)
                else:
                    near = sure = cosine >= least
                a, b = np.nonzero(near)
                sure = sure[a, b]
                a += at
                ok = a < b
                if one != two:
                    ok &= chunk[a] != chunk[b]  # within a chunk another group looks
                pairs.append((a[ok], b[ok], sure[ok]))
            a, b, sure = (np.concatenate(p) for p in zip(*pairs))
            # A pair counts here if it shares no filter before this one.
            earlier = [frozenset(f for f in h[5] if f < this) for h in held] if len(a) else []
            first = np.fromiter((earlier[i].isdisjoint(earlier[j]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
            for i, j in zip(a[first & ~sure].tolist(), b[first & ~sure].tolist()):
                yield ids[i], 0, ids[j], True
            first, a, b = first[sure], a[sure], b[sure]
            np.add.at(counts, a[first], n[b[first]])
            np.add.at(counts, b[first], n[a[first]])
            label = joined(label, a, b)
            for r in range(len(held)):
                if counts[r] or label[r] != r:
                    yield ids[r], int(counts[r]), ids[label[r]], False

        return run

    return make


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable over links (a, b)."""
    while len(a):
        was = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (was == label).all():
            break
        label = label[label]
    return label


def _members_compared(least: float):
    """Rows (ball a, ids, n, vecs, ball b, ids, n, vecs): each member's count of links, and one link of the balls if there is any."""

    def make():
        def run(rows):
            for a, ids_a, n_a, x_a, b, ids_b, n_b, x_b in rows:
                near = units(x_a) @ units(x_b).T >= least
                if near.any():
                    for i, k in zip(ids_a, (near @ np.array(n_b)).tolist()):
                        if k:
                            yield i, k, None, None
                    for j, k in zip(ids_b, (near.T @ np.array(n_a)).tolist()):
                        if k:
                            yield j, k, None, None
                    yield None, None, a, b

        return run

    return make


def near_vectors(
    vectors: DataFrame,
    least: float = 0.95,
    codes: int = 4,
    blocks: int = 2,
    list_size: float = 15.0,
    load: float = 0.02,
    codewords: tuple[int, int] = (4096, 65_536),
    group_limit: int = 2000,
    ball: float = 1 / 16,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join rows whose cosine is at least ``least``, as far as filters bring them together; none is below it. Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
    lengths never link. Rows that repeat an id count as vectors of their own. component_id is the smallest vec_id
    reachable; kept says that it is the row's own. Without any id in a component it is null and kept is true. An empty
    table gives an empty result; extra columns are left out. ``ball`` is a ball's largest radius, as a part of the angle
    that links. With the largest codebooks unrelated vectors meet as rarely as ``load`` says up to 3.4 million times
    ``load`` / 0.02 balls, and in proportion more often beyond.
    """
    scratch = Scratch(vectors.sparkSession)
    vec = F.col("vec")
    usable = F.coalesce(
        (F.size(vec) > 0) & F.forall(
            vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        ) & F.exists(vec, lambda x: x != 0), F.lit(False)
    )
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # floats are exact as they are and half as long
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("vec")).withColumn("usable", usable)
    # Equal vectors are one class; zeros are unsigned so that -0.0 and 0.0 are equal.
    plain = F.transform(vec, lambda x: (x + F.lit(0.0)).cast(kind))
    grouped = rows.where("usable").select("vec_id", plain.alias("vec")).groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    named = scratch.save(grouped.select(F.monotonically_increasing_id().alias("id"), "vec", "n", "low"), "classes")

    # Balls: classes of a cell that are close to the cell's first class.
    celled = scratch.save(map_rows(named.select("id", "vec", "n"), f"id long, vec array<{kind}>, n long, cell long", _celled(1024)), "cells")
    celled = celled.withColumn("cell", F.struct(F.size("vec").alias("dim"), "cell"))
    centres = celled.groupBy("cell").agg(F.min(F.struct("id", "vec")).alias("c"), F.count("*").alias("m")).where("m > 1").select(
        "cell", F.col("c.id").alias("centre"), F.col("c.vec").alias("of")
    )
    crowded = lookup(scratch, celled, scratch.save(centres, "centres"), "cell").where("centre is not null").select("id", "vec", "n", "centre", "of")
    placed = map_rows(crowded, f"id long, vec array<{kind}>, n long, ball long, far double", _balls(float(np.arccos(least)) * ball))
    members = scratch.save(placed.where("id <> ball or far > 0"), "members")  # all but centres
    size = members.groupBy("ball").agg(F.sum("n").alias("more"), F.max("far").alias("radius"))
    alone = named.select("id", "vec", "n").join(members.select("id"), "id", "left_anti")
    balls = scratch.save(
        alone.join(size, F.col("id") == F.col("ball"), "left").select(
            "id", "vec", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius")
        ),
        "balls"
    )

    # At least so many directions that a filter holds ``load`` unrelated balls on average, as far as codebooks may grow.
    words = int(min(codewords[1], max(codewords[0], np.ceil((balls.count() * list_size / load) ** (1 / blocks)))))
    lists = list_size * (1 + np.log2(words / codewords[0]) / 6)
    decoded = scratch.save(
        map_rows(
            balls.select("id", "vec"), f"id long, vec array<{kind}>, list array<long>", _decoded(codes, blocks, words, lists)
        ).select("id", F.size("vec").alias("dim"), "list"),
        "decoded"
    )
    each = decoded.select("id", "dim", F.explode("list").alias("filter"))
    shared = scratch.save(each.groupBy("dim", "filter").agg(F.count("*").alias("m")).where("m > 1"), "filters")
    met = each.join(shared, ["dim", "filter"]).groupBy("id").agg(F.collect_list(F.struct("filter", "m")).alias("met"))
    full = met.join(balls, "id").select(
        "id",
        "n",
        "radius",
        "vec",
        F.size("vec").alias("dim"),
        F.transform("met", lambda v: v["filter"]).alias("list"),
        F.explode("met").alias("f")
    )
    full = full.withColumn("chunks", F.ceil(F.col("f.m") / group_limit).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns(
        {"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other"), "filter": F.col("f.filter")}
    )
    dealt = dealt.select(
        "dim", "filter", "i", "j", "chunk", "id", "n", "radius", "vec", "list"
    ).repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j", "id")
    found = scratch.save(map_rows(dealt, "id long, links long, to long, open boolean", _compared(least)), "links")

    # Balls that are compared member by member, in blocks.
    open_ = scratch.save(found.where("open").select(F.col("id").alias("a"), F.col("to").alias("b")), "open")
    counts = found.where("not open").groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("not open and id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))
    extra = None
    if not open_.isEmpty():
        wanted = open_.select(F.col("a").alias("ball")).unionByName(open_.select(F.col("b").alias("ball"))).distinct()
        inside = members.select("ball", "id", "n", "vec").unionByName(named.join(wanted, F.col("id") == F.col("ball")).select("ball", "id", "n", "vec"))
        inside = inside.join(wanted, "ball", "left_semi")
        # A block holds 256 members or so of one ball: large balls have more of them.
        blocks_of = members.groupBy("ball").agg(F.ceil(F.count("*") / 256).alias("parts"))
        inside = inside.join(blocks_of, "ball", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
        held = scratch.save(
            inside.groupBy("ball", "part").agg(
                F.collect_list(F.struct("id", "n", "vec")).alias("h")
            ).select("ball", "h.id", "h.n", "h.vec"),
            "blocks"
        )
        left, right = (held.select(F.col("ball").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "vec")]) for x in "ab")
        both = open_.join(left, "a").join(right, "b").select("a", "id_a", "n_a", "vec_a", "b", "id_b", "n_b", "vec_b")
        extra = scratch.save(map_rows(both, "id long, links long, a long, b long", _members_compared(least)), "members")
        edges = edges.unionByName(extra.where("a is not null").select("a", "b"))
        extra = extra.where("id is not null").groupBy("id").agg(F.sum("links").alias("extra"))

    roots = scratch.save(components(scratch, edges), "roots")
    of_ball = balls.select(F.col("id").alias("ball"), F.col("n").alias("all")).join(counts.withColumnRenamed("id", "ball"), "ball", "left").join(
        roots.withColumnRenamed("node", "ball"), "ball", "left"
    )
    of_ball = scratch.save(
        of_ball.select("ball", (F.col("all") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "ball").alias("root")),
        "counted"
    )
    classes = scratch.save(named.join(members.select("id", "ball"), "id", "left").select("id", "vec", "low", F.coalesce("ball", "id").alias("ball")), "placed")
    whole = lookup(scratch, classes, of_ball, "ball")
    if extra is not None:
        whole = whole.join(extra, "id", "left").withColumn("links", F.col("links") + F.coalesce("extra", F.lit(0)))
    whole = scratch.save(whole.select("vec", "low", "root", "links"), "whole")
    lows = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    result = scratch.save(lookup(scratch, whole, lows, "root").select("vec", F.col("links").alias("n_links"), "component_id"), "result")
    good = rows.where("usable").select("vec_id", plain.alias("vec")).join(result, "vec").select("vec_id", "n_links", "component_id")
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
