"""Suffix-array dedup: bytes that an earlier document already has are removed, the first copy stays.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. A suffix array
over all texts would be one task's work, so suffixes are dealt out first, by their content: each window of ``length``
bytes has an anchor, its k-mer of least hash, and equal windows have equal anchors. Windows next to each other mostly
share theirs and travel as one segment. An anchor that only one document has can't be part of a repeat, so hashes of
anchors go first (five bytes each), and only segments of anchors in two documents follow.

In each bucket of anchors the windows' suffixes are sorted, neighbours' common prefixes counted, and the previous and
next smaller document in suffix order give the longest previous factor, up to ``length``; where it reaches ``length``,
the window is a later copy.

Equal whole texts are one text with the smallest of their ids; the others go as a whole. K-mers that many documents of
a bounded sample share are anchors only where a window has no other: no bucket gets the surroundings of a frequent line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Texts are hashed in slabs of so many window starts; a slab's place fits in SLAB_BITS.
SLAB, SLAB_BITS = 1 << 17, 17
#: Windows that a task sorts at a time.
SORTED = 2_000_000
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]


def words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number in the order of the bytes; the last seven places are left out."""
    a = data.astype(np.uint64)
    for width in (1, 2, 4):
        b = a[:-width] << np.uint64(8 * width)
        b |= a[width:]
        a = b
    return a


def mixed(h: np.ndarray) -> np.ndarray:
    """The numbers, mixed in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(MULTIPLIERS[2])
    h ^= h >> np.uint64(29)
    return h


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on; k is 8 at least."""
    w, n = words(data), len(data) - k + 1
    h = w[:n] * np.uint64(MULTIPLIERS[0])
    for at in [*range(8, k - 8, 8), k - 8]:
        h ^= h >> np.uint64(32)
        h += w[at : at + n]
        h *= np.uint64(MULTIPLIERS[1])
    return mixed(h)


class Anchors:
    """Finds windows and their anchors in texts."""

    def __init__(self, length: int, hot: list[int]):
        self.length, self.k = length, max(8, length // 3)
        self.hot = np.array(sorted(hot), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hot >> np.uint64(48)).astype(np.int64)] = True

    def demoted(self, h: np.ndarray) -> np.ndarray:
        """True for frequent k-mers."""
        out = np.zeros(len(h), bool)
        if len(self.hot):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hot, h[at]), len(self.hot) - 1)
            out[at] = self.hot[place] == h[at]
        return out

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments of concatenated texts that end at ``ends``: first window start, last one, hash of the anchor they share."""
        found = [self._slab(data, ends, at) for at in range(0, max(0, len(data) - self.length + 1), SLAB)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        first, last, h = (np.concatenate(x) for x in zip(*found))
        return first, last, h

    def _slab(self, data, ends, at):
        part = data[at : at + SLAB + self.length - 1]
        h = kmer_hashes(part, self.k)
        bits = np.uint64(SLAB_BITS + 1)  # a place needs one bit more: a slab has the last windows' bytes too
        v = h >> bits + np.uint64(1)
        v <<= bits
        v |= np.arange(len(h), dtype=np.uint64)
        frequent_ = self.demoted(h)
        v[frequent_] |= np.uint64(1 << 63)
        span, width = self.length - self.k + 1, 1
        while 2 * width <= span:  # least of 1, 2, 4, ... k-mers from each place on
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        n = len(part) - self.length + 1
        v = np.minimum(v[:n], v[span - width : span - width + n])
        place = (v & np.uint64((1 << SLAB_BITS + 1) - 1)).astype(np.int32)
        new, fits = np.empty(n, bool), np.ones(n, bool)
        new[:1] = True
        np.not_equal(place[1:], place[:-1], out=new[1:])
        for end in (ends[np.searchsorted(ends, at, side="right") :] - at).tolist():  # windows over a text's end are none
            if end - self.length >= n:
                break
            fits[max(0, end - self.length + 1) : max(0, end)] = False
            new[max(0, end - self.length + 1) : end - self.length + 2] = True
            new[end : end + 1] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        kept = fits[first]
        return first[kept] + at, last[kept] + at, h[place[first[kept]]]


def longest_previous(keys: list[np.ndarray], doc: np.ndarray, length: int) -> np.ndarray:
    """Of each window (columns of eight bytes each in ``keys``): the longest prefix, up to ``length``, that a smaller document has.

    Suffix order, common prefixes of neighbours, then the previous and the next smaller document along that order.
    """
    n = len(doc)
    order = np.lexsort(keys[::-1])
    d = doc[order]
    lcp = np.zeros(n + 1, np.int64)  # of a suffix and the one before it; none before the first and after the last
    if n > 1:
        going, common = np.ones(n - 1, bool), np.zeros(n - 1, np.int64)
        for at, w in zip(places(length), keys):
            w = w[order]
            x = w[1:] ^ w[:-1]
            high = x >> np.uint64(32)
            used = np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp((x & np.uint64(0xFFFFFFFF)).astype(float))[1])
            common = np.where(going, at + (64 - used) // 8, common)
            going &= x == 0
        lcp[1:n] = np.minimum(common, length)
    best = np.zeros(n, np.int64)
    for direction in (-1, 1):
        to = np.arange(n) + direction
        short = lcp[:n].copy() if direction < 0 else lcp[1:].copy()
        at = np.arange(n)
        while True:
            at = at[(to[at] >= 0) & (to[at] < n) & (short[at] > 0)]
            at = at[d[to[at]] >= d[at]]
            if not len(at):
                break
            over = to[at]
            beyond = (to[over] >= 0) & (to[over] < n)
            new_short = np.where(beyond, np.minimum(short[at], short[over]), 0)
            to[at], short[at] = to[over], new_short
        ends = (to >= 0) & (to < n)
        best = np.maximum(best, np.where(ends, short, 0))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def window_keys(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The bytes of windows as columns of eight; the last column overlaps the one before."""
    w = words(data)
    return [w[starts + at] for at in places(length)]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, without those that overlap."""
    high = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] >= high[:-1]))
    return start[new], high[np.append(new[1:], len(high)) - 1]


def places(length: int) -> list[int]:
    return [*range(0, length - 8, 8), length - 8]


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def five(h: np.ndarray) -> bytes:
    """The upper five bytes of each number."""
    return np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.uint64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


class Unit:
    """The distinct texts of one unit, in the order of their keys: the same whenever it is read."""

    def __init__(self, table: pa.Table):
        held: dict[tuple, list] = {}
        for a, b, doc, text in zip(*(table.column(c).to_pylist() for c in ("a", "b", "doc", "text"))):
            row = held.setdefault((a, b), [None, None])
            row[0] = doc if row[0] is None else row[0] if doc is None else min(row[0], doc)
            row[1] = text if text is not None else row[1]
        self.keys = sorted(held)
        rows = [held[k] for k in self.keys]
        self.docs, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        sizes = [len(t) if d is not None else 0 for d, t in rows]  # a text without an id matches nothing
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.data = np.frombuffer(b"".join(t for d, t in rows if d is not None), np.uint8)
        self.id_of = np.array([d if d is not None else 0 for d in self.docs], np.int64)

    def segments(self, anchors: Anchors):
        """first, last, hash, text number of each segment."""
        first, last, h = anchors.of(self.data, self.ends)
        return first, last, h, np.searchsorted(self.ends, first, side="right")


def frequent(texts: DataFrame, length: int, sample: int, least: float, prefix: int = 16_384) -> list[int]:
    """Hashes of k-mers in over a share ``least`` of ``sample`` texts (their first bytes): only where work is done depends on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, n, k = [], 0, max(8, length // 3)
        for b in batches:
            for t in b.column("text").to_pylist():
                n += 1
                if len(t) >= length:
                    each.append(np.unique(kmer_hashes(np.frombuffer(t, np.uint8), k)))
        h, c = np.unique(np.concatenate(each) if each else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h[c > max(2, least * n)].view(np.int64))], names=["h"])

    held = texts.select(F.substring("text", 1, prefix).alias("text"), "a").orderBy("a").limit(sample)
    return [r.h % 2**64 for r in held.coalesce(1).mapInArrow(count, "h long").collect()]


def later_copies(
    docs: DataFrame,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit_bytes: int = 8 << 20,
    sample: int = 2000,
    least: float = 0.01,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_removed, n_spans (long), kept_sha256 and kept (binary, the bytes that stay).

    Texts are compared as UTF-8 bytes and read whole; null is empty. Rows with equal ids never match each other, so
    repeated rows get equal results. A row without an id keeps all its bytes and takes none from others. Texts shorter
    than ``length`` stay. An empty table gives an empty result; other columns are left out. Work is dealt in units of
    about ``unit_bytes`` of distinct texts; a unit and a bucket are what a task holds, whatever the length of the table.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    return _results(docs, _kept(docs, length, id_col, text_col, unit_bytes, sample, least, scratch, True), length, id_col, text_col, ["kept"])


def removed_figures(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = 8 << 20, sample: int = 2000, least: float = 0.01, scratch: Scratch | None = None
) -> DataFrame:
    """``later_copies`` without the bytes that stay: only digests travel."""
    scratch = scratch or Scratch(docs.sparkSession)
    return _results(docs, _kept(docs, length, id_col, text_col, unit_bytes, sample, least, scratch, False), length, id_col, text_col, [])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.cast("binary").alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _results(docs: DataFrame, found: DataFrame, length: int, id_col: str, text_col: str, more: list[str]) -> DataFrame:
    """Rows of ``docs`` with what was found for their text; copies after the first lose all."""
    rows = _texts(docs, id_col, text_col)
    whole = F.when(F.col("doc").isNull(), F.sha2("text", 256))  # keeps all, even where the first of its copies doesn't
    rows = rows.select("doc", "a", "b", F.octet_length("text").cast("long").alias("n_bytes"), whole.alias("whole"), *([F.when(F.col("doc").isNull(), F.col("text")).alias("all")] if more else []))
    later = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= length)
    none = F.sha2(F.lit("").cast("binary"), 256)
    pick = lambda gone, stays, own: F.when(F.col("doc").isNull(), stays).when(later, gone).otherwise(own)
    zero = F.lit(0).cast("long")
    return rows.join(found, ["a", "b"]).select(
        F.col("doc").cast(dict(docs.dtypes)[id_col]).alias(id_col),
        "n_bytes",
        pick(F.col("n_bytes"), zero, F.col("removed")).alias("n_removed"),
        pick(F.lit(1).cast("long"), zero, F.col("spans")).alias("n_spans"),
        pick(none, F.col("whole"), F.col("sha")).alias("kept_sha256"),
        *([pick(F.lit(b""), F.col("all"), F.col("kept")).alias("kept")] if more else []),
    )


def _kept(docs, length, id_col, text_col, unit_bytes, sample, least, scratch, with_bytes) -> DataFrame:
    """a, b, first, removed, spans, sha (and kept) of each distinct text."""
    if length < 8:
        raise ValueError("repeats of fewer than eight bytes aren't supported")
    spark = docs.sparkSession
    prepare(spark)
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    units = buckets = max(1, -(-total // unit_bytes))
    anchors = Anchors(length, frequent(texts, length, sample, least))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each text that a task has, and in the end the smallest id of those with more."""
        seen: dict[tuple, int | None] = {}
        schema = pa.schema([("unit", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("text", pa.binary())])
        again: dict[tuple, list] = {}
        for batch in batches:
            unit, a, b, doc = (batch.column(c).to_pylist() for c in ("unit", "a", "b", "doc"))
            new = []
            for i, key in enumerate(zip(a, b)):
                if key not in seen:
                    new.append(i)
                    seen[key] = doc[i]
                elif doc[i] is not None and (seen[key] is None or doc[i] < seen[key]):
                    seen[key] = doc[i]
                    again[key] = [unit[i], *key, doc[i], None]
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in schema.names], schema=schema).take(pa.array(new, pa.int64()))
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*again.values()), schema.types)], schema=schema)

    keyed = texts.withColumn("unit", F.pmod("a", F.lit(units)).cast("int")).select("unit", "a", "b", "doc", "text")
    dealt = keyed.mapInArrow(distinct, "unit int, a long, b long, doc long, text binary").repartition(units, "unit")

    def ask(key, table):
        """Hashes of a unit's anchors by bucket, each once, in order."""
        unit = Unit(table)
        h = np.unique(unit.segments(anchors)[2])
        where = bucket_of(h, buckets)
        order = np.argsort(where, kind="stable")
        h, where = h[order], where[order]
        at, n = np.unique(where, return_index=True), len(h)
        cuts = np.append(at[1], n)
        rows = [five(h[i:j]) for i, j in zip(cuts, cuts[1:])]
        return pa.table({"bucket": pa.array(at[0], pa.int32()), "unit": pa.array([key[0].as_py()] * len(rows), pa.int32()), "h": pa.array(rows, pa.binary())})

    def answer(key, table):
        """A bit for each hash of a bucket's rows: another unit has it too."""
        rows = [from_five(x) for x in table.column("h").to_pylist()]
        _, back, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        bits, at = [], 0
        for r in rows:
            bits.append(bitmap(count[back[at : at + len(r)]] > 1))
            at += len(r)
        return pa.table({"unit": table.column("unit"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def send(key, table, answers):
        """Segments whose anchor a second document has, by bucket; later copies within the unit are decided here."""
        unit = Unit(table)
        first, last, h, text = unit.segments(anchors)
        kinds, back = np.unique(h, return_inverse=True)
        where = bucket_of(kinds, buckets)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        shared = np.zeros(len(kinds), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
            at = order[cuts[b] : cuts[b + 1]]
            shared[at] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).astype(bool)
        # Within the unit: a hash that two texts have.
        low, high = np.full(len(kinds), len(unit.texts)), np.full(len(kinds), -1)
        np.minimum.at(low, back, text)
        np.maximum.at(high, back, text)
        shared |= low < high
        chosen = np.flatnonzero(shared[back])
        raw, known = unit.data.tobytes(), {}
        spans = [raw[f : t + length] for f, t in zip(first[chosen].tolist(), last[chosen].tolist())]
        docs_ = unit.id_of[text[chosen]].tolist()
        for s, d in zip(spans, docs_):
            if d < known.get(s, d + 1):
                known[s] = d
        asked = np.array([known[s] == d for s, d in zip(spans, docs_)], bool)
        done = chosen[~asked]
        out = {"bucket": [], "unit": [], "off": [], "size": [], "doc": [], "h": [], "data": [], "from": [], "to": []}
        n = key[0].as_py()

        def put(bucket, off, size, doc, h, data, start, end):
            for name, v in zip(out, (bucket, n, off, size, doc, h, data, start, end)):
                out[name].append(v)

        if len(done):
            put(n % buckets, b"", b"", b"", b"", b"", first[done].astype("<u4").tobytes(), (last[done] + length).astype("<u4").tobytes())
        pick = np.flatnonzero(asked)
        of_bucket = where[back[chosen[pick]]]
        order = pick[np.argsort(of_bucket, kind="stable")]
        at = np.unique(np.sort(of_bucket), return_index=True)
        for b, i, j in zip(at[0].tolist(), at[1].tolist(), [*at[1][1:].tolist(), len(order)]):
            rows = order[i:j]
            seg = chosen[rows]
            put(
                b,
                first[seg].astype("<u4").tobytes(),
                (last[seg] - first[seg] + length).astype("<u2").tobytes(),
                unit.id_of[text[seg]].astype("<i8").tobytes(),
                h[seg].astype("<u4").tobytes(),
                b"".join([spans[r] for r in rows.tolist()]),
                b"",
                b"",
            )
        kinds_ = {"bucket": pa.int32(), "unit": pa.int32()}
        return pa.table({name: pa.array(v, kinds_.get(name, pa.binary())) for name, v in out.items()})

    def factors(key, table):
        """Runs of windows that a smaller document has, by unit; what is decided passes through."""
        rows = table.to_pylist()
        found = {"unit": [r["unit"] for r in rows if r["from"]], "from": [r["from"] for r in rows if r["from"]], "to": [r["to"] for r in rows if r["to"]]}
        off, size, doc, h = (np.concatenate([np.frombuffer(r[c], t) for r in rows]).astype(np.int64) for c, t in (("off", "<u4"), ("size", "<u2"), ("doc", "<i8"), ("h", "<u4")))
        unit = np.repeat(np.array([r["unit"] for r in rows]), [len(r["off"]) // 4 for r in rows])
        raw = b"".join([r["data"] for r in rows])
        begin = np.cumsum(size) - size
        # Equal segments are decided as a whole: all but those of the smallest document go.
        known: dict[bytes, int] = {}
        spans = [raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
        for s, d in zip(spans, doc.tolist()):
            if d < known.get(s, d + 1):
                known[s] = d
        least = np.array([known[s] for s in spans], np.int64)
        later = np.flatnonzero(doc > least)
        starts, ends = [off[later]], [off[later] + size[later]]
        owners = [unit[later]]
        # The others can only share windows with segments that differ but have the same anchor.
        asked = np.flatnonzero(doc == least)
        _, back, count = np.unique(h[asked], return_inverse=True, return_counts=True)
        asked = asked[count[back] > 1]
        if len(asked):
            data = np.frombuffer(raw, np.uint8)
            n = size[asked] - length + 1
            seg = np.repeat(asked, n)
            step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[seg] + step
            gone, parts = np.zeros(len(at), bool), -(-len(at) // SORTED)
            part = h[seg] % parts  # equal windows stay together
            for p in range(parts):
                chosen = np.flatnonzero(part == p)
                gone[chosen] = longest_previous(window_keys(data, at[chosen], length), doc[seg[chosen]], length) >= length
            hit = np.flatnonzero(gone)
            starts.append(off[seg[hit]] + step[hit])
            ends.append(off[seg[hit]] + step[hit] + length)
            owners.append(unit[seg[hit]])
        starts, ends, owners = np.concatenate(starts), np.concatenate(ends), np.concatenate(owners)
        order = np.lexsort((starts, owners))
        starts, ends, owners = starts[order], ends[order], owners[order]
        cuts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else []
        for i, j in zip(cuts, [*cuts[1:], len(owners)]):
            low, high = merged(starts[i:j], ends[i:j])
            found["unit"].append(int(owners[i]))
            found["from"].append(low.astype("<u4").tobytes())
            found["to"].append(high.astype("<u4").tobytes())
        return pa.table({"unit": pa.array(found["unit"], pa.int32()), "from": pa.array(found["from"], pa.binary()), "to": pa.array(found["to"], pa.binary())})

    def cut(key, table, gone):
        """What is left of each text of a unit."""
        unit = Unit(table)
        start = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(x, "<u4") for x in gone.column("from").to_pylist())]).astype(np.int64)
        end = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(x, "<u4") for x in gone.column("to").to_pylist())]).astype(np.int64)
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        owner = np.searchsorted(unit.ends, start, side="right")
        new = np.flatnonzero(np.append(True, (start[1:] > end[:-1]) | (owner[1:] != owner[:-1]))) if len(start) else np.empty(0, np.int64)
        start, end, owner = start[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end, owner[new]
        out, at = [], 0
        begins = unit.ends - np.diff(unit.ends, prepend=0)
        for i, (text, doc) in enumerate(zip(unit.texts, unit.docs)):
            left, last, removed, n = [], 0, 0, 0
            while doc is not None and at < len(start) and owner[at] == i:
                f, t = int(start[at] - begins[i]), int(end[at] - begins[i])
                left.append(text[last:f])
                last, removed, n, at = t, removed + t - f, n + 1, at + 1
            kept = b"".join([*left, text[last:]])
            out.append((*unit.keys[i], doc, removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
        types = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * with_bytes
        names = ["a", "b", "first", "removed", "spans", "sha"] + ["kept"] * with_bytes
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, types))})

    asks = dealt.groupBy("unit").applyInArrow(ask, "bucket int, unit int, h binary")
    answers = asks.groupBy("bucket").applyInArrow(answer, "unit int, bucket int, bits binary")
    sent = dealt.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        send, "bucket int, unit int, off binary, size binary, doc binary, h binary, data binary, from binary, to binary"
    )
    runs = sent.groupBy("bucket").applyInArrow(factors, "unit int, from binary, to binary")
    schema = "a long, b long, first long, removed long, spans long, sha string" + ", kept binary" * with_bytes
    return dealt.groupBy("unit").cogroup(runs.groupBy("unit")).applyInArrow(cut, schema)
