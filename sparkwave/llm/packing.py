"""Best-fit packing: bounded-space online best-fit with a bitset keyed by free space.

Every task packs the pieces of its own partition, without a shuffle. A piece goes to the open bin that it fits most
tightly; bit f of the bitset says that an open bin has f tokens free, so that bin is the lowest set bit from the
piece's length on. When too many bins are open, the fullest closes first. Pieces arrive through a bounded look-ahead:
so many are read at a time and put longest first, which makes the rule best-fit decreasing within a look-ahead and
online from one to the next; open bins stay.

A partition's end leaves open bins, and many small partitions leave many. Their pieces are gathered, as few tasks as
their measured number of tokens needs, and packed again by the same rule; bins that are full but for a few tokens stay.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, map_rows
from .token_ids import text_ids, vocabulary

END = b"\0\0\0\0"


class Bins:
    """Open bins of ``size`` tokens, at most ``most`` of them; ``closed`` collects those that can take no more pieces."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.free = 0, {}  # free space -> its open bins
        self.open = self.made = 0
        self.closed: list[int] = []

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for the next piece, 1 <= length <= size."""
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            b = self._take(space)
        else:
            if self.open == self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
            b, space, self.made = self.made, self.size, self.made + 1
        if left := space - length:
            self.free.setdefault(left, []).append(b)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(b)
        return b, self.size - space

    def _take(self, space: int) -> int:
        held = self.free[space]
        b = held.pop()
        if not held:
            self.bits &= ~(1 << space)
        self.open -= 1
        return b

    def left(self, least: int) -> set[int]:
        """Open bins with more than ``least`` tokens free."""
        return {b for space, held in self.free.items() if space > least for b in held}


def fed(rows, at: int, size: int, open_bins: int, ahead: int, first: int, spare: int | None = None, ahead_bytes: int = 64 << 20):
    """Rows with (sequence, offset) added, bin by bin as they close; ``at`` is the place of the length, ``first`` the first sequence.

    At the end, rows of bins with more than ``spare`` tokens free come with None for both (None: no bin does).
    """
    bins, held, weight, inside = Bins(size, open_bins), [], 0, {}

    def closed():
        for b in bins.closed:
            yield from inside.pop(b)
        bins.closed.clear()

    def put():
        held.sort(key=lambda r: -r[at])
        for row in held:
            b, offset = bins.put(row[at])
            inside.setdefault(b, []).append((*row, first + b, offset))
            yield from closed()

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= ahead or weight >= ahead_bytes:
            yield from put()
            held, weight = [], 0
    yield from put()
    again = bins.left(spare) if spare is not None else set()
    for b, pieces in inside.items():
        yield from ((*p[:-2], None, None) for p in pieces) if b in again else pieces


def cut(rows, ids_of, size: int, keep_ids: bool):
    """(id, piece, start, length, crc32 of the ids, and the ids if they are kept) of (id, text): whole ids and a closing 0 in pieces."""
    for i, text in rows:
        ids = ids_of(text) + END
        for k, at in enumerate(range(0, len(ids), 4 * size)):
            part = ids[at : at + 4 * size]
            yield (i, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if keep_ids else ())


#: Second pass: sequences are numbered from here, and so many tokens go to one task.
SECOND, TASK_TOKENS = 1 << 62, 1 << 27


def _pass(size: int, open_bins: int, ahead: int, at: int, second: bool, pieces=lambda: lambda rows: rows):
    def make():
        from pyspark import TaskContext

        first, of = (SECOND if second else 0) + (TaskContext.get().partitionId() << 40), pieces()
        return lambda rows: fed(of(rows), at, size, open_bins, ahead, first, None if second else size // 400)

    return make


def _closed(scratch: Scratch, once: DataFrame, size: int, open_bins: int, ahead: int) -> DataFrame:
    """Packs what the first pass has left open (no sequence_id) and gives all rows."""
    once = scratch.save(once, "packed")
    open_ = once.where("sequence_id is null")
    tokens = open_.agg(F.sum("length")).head()[0] or 0
    if not tokens:
        return once
    at = once.columns.index("length")
    again = map_rows(
        open_.repartition(-(-tokens // TASK_TOKENS)),
        once.schema,
        lambda: lambda rows: _pass(size, open_bins, ahead, at, True)()(r[:-2] for r in rows)
    )
    return once.where("sequence_id is not null").unionByName(again)


def pack(parts: DataFrame, size: int = 2048, open_bins: int = 4096, ahead: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """``parts`` with sequence_id and offset (earlier ones are replaced). Needs length, 1 to ``size``.

    Nulls in other columns, ties and repeated rows are packed like any row; an empty table gives an empty result. The
    first pass is written to shared storage.
    """
    parts = parts.drop("sequence_id", "offset")
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    once = map_rows(parts, schema, _pass(size, open_bins, ahead, parts.columns.index("length"), False))
    return _closed(scratch or Scratch(parts.sparkSession), once, size, open_bins, ahead)


def pack_documents(
    docs: DataFrame,
    vocab: str | None = None,
    size: int = 2048,
    open_bins: int = 4096,
    ahead: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Documents as pieces in sequences of at most ``size`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (packed 4-byte
    little-endian) before these two if asked for. A null text is empty and makes one piece, its closing 0. Null ids,
    repeated rows and ties are packed like any other row; an empty table gives an empty result. Extra columns are left
    out. Only documents longer than a sequence are cut, however long they are. ``ahead`` pieces at most wait to be put
    longest first, and ``open_bins`` bins hold theirs until they close. The first pass is written to shared storage.
    """
    vocab = vocab or vocabulary()

    def pieces():
        ids_of = text_ids(vocab).ids
        return lambda rows: cut(rows, ids_of, size, keep_ids)

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    once = map_rows(source, schema, _pass(size, open_bins, ahead, 3, False, pieces))
    return _closed(scratch or Scratch(docs.sparkSession), once, size, open_bins, ahead)
