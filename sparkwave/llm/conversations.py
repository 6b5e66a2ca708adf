"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``.

The edits of a row depend on all later ones, through four numbers: what the rest costs from each state of the role
pattern. Less their minimum, they are one of few vectors. Each becomes a state of a deterministic automaton when it is
first met, and what a kind of row makes of it is kept in a transition table, so a scan from the last row to the first
is a table lookup a row. It leaves with each row the vector of the rest; from the first row on, the trace then takes
the least letter among the arcs that are tight.

Both directions are streams over sorted rows: a conversation of any length is read row by row in bounded memory. All
rows of one conversation pass through one task, since the digest of its text has to be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_rows

# Costs of the edits, and what an inserted or renamed row is in each state of the pattern.
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
#: States: nothing yet, after system, after user, after assistant. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs of the rest behind the last row.
END = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"


class Automaton:
    """Vectors of costs as states, met as they come; symbols are (role initial or '', must go, truncated)."""

    def __init__(self):
        self.moves: dict[tuple, tuple] = {}  # (vector of the rest, symbol) -> (vector with the row, what was taken off it)
        self.traces: dict[tuple, tuple] = {}

    @staticmethod
    def arcs(state: int, symbol: tuple) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits of a row."""
        initial, must_go, truncated = symbol
        yield "D", DELETE, state
        if not must_go:
            if state in KEPT.get(initial, ()):
                yield "K", TRUNCATED * truncated, KEPT[initial][state]
            yield "R", RENAME + TRUNCATED * truncated, NEXT[state]

    def raw(self, rest: tuple, symbol: tuple) -> tuple:
        """Costs with the row, from the costs of the rest; rows inserted before it included."""
        v = [min(cost + rest[to] for _, cost, to in self.arcs(s, symbol)) for s in range(4)]
        for _ in range(2):
            v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
        return tuple(v)

    def move(self, rest: tuple, symbol: tuple) -> tuple[tuple, int]:
        found = self.moves.get((rest, symbol))
        if found is None:
            v = self.raw(rest, symbol)
            least = min(v)
            found = self.moves[rest, symbol] = tuple(x - least for x in v), least
        return found

    def trace(self, state: int, rest: tuple, symbol: tuple) -> tuple[tuple, int]:
        """Letters and roles, least first, of the tight arcs from a state over a row, and the state after it."""
        found = self.traces.get((state, rest, symbol))
        if found is None:
            v, out, at = self.raw(rest, symbol), [], state
            while True:
                tight = [(letter, to) for letter, cost, to in self.arcs(at, symbol) if v[at] == cost + rest[to]]
                if v[at] == INSERT + v[NEXT[at]]:
                    tight.append(("I", NEXT[at]))
                letter, to = min(tight)
                out.append((letter, NAMES.get(to) if letter in "IR" else None))
                at = to
                if letter != "I":
                    break
            found = self.traces[state, rest, symbol] = tuple(out), at
        return found


def packed(v: tuple) -> int:
    return v[0] | v[1] << 8 | v[2] << 16 | v[3] << 24


def unpacked(n: int) -> tuple:
    return n & 255, n >> 8 & 255, n >> 16 & 255, n >> 24 & 255


def faults(role: Column, text: Column, copy: Column) -> Column:
    """blank, duplicate, truncated or null; ``copy``: the row's number among those of its role and text."""
    bare = F.btrim(text, F.lit(BLANKS))
    return (
        F.when(bare == "", F.lit("blank"))
        .when(copy > 1, F.lit("duplicate"))
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit("truncated"))
    )


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None) -> DataFrame:
    """The edits of every conversation, a row each: conv_id, seq, edit, role, text, was, turn, fault, cost.

    Rows count by turn, nulls first, then by role and text; a null role or text is one space. A row's fault is the first of
    blank (no character but white space), duplicate (role and text seen earlier in the conversation) and truncated (its
    last character isn't one of ``.!?``). Edits: K keeps a row; R makes it the user's or the assistant's, for 1; D deletes
    it, for 2, and must where it is blank or a duplicate; I inserts an empty row of either anywhere, for 5; a truncated row
    that stays costs 5. The edits are the cheapest after which role initials read ``(s?(ua)+)?``; of several, those
    whose letters come first in ASCII. ``role`` and ``text`` are the row's after its edit, null once deleted; ``was`` is its role before
    (null: inserted); ``cost`` is that of this and all later rows of the conversation, inserted ones before it included.

    Rows with true in ``gone_col`` count as not there. A conversation without rows is one row without edit, so none is
    lost; null ids are one conversation, repeated rows are duplicates, an empty table gives an empty result, other columns
    are left out. Partitions hold whole conversations, sorted by seq.
    """
    # Names of its own for all columns: those of the input don't matter.
    pick = lambda c: F.col(f"`{c}`")
    own = rows.select(
        pick(conv_col).alias("conv_id"),
        pick(turn_col).cast("long").alias("turn"),
        F.coalesce(pick(role_col).cast("string"), F.lit(" ")).alias("was"),
        F.coalesce(pick(text_col).cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(pick(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone")
    )
    own = own.withColumns({"was": F.when(~F.col("gone"), F.col("was")), "text": F.when(~F.col("gone"), F.col("text"))})
    kind = own.schema["conv_id"].dataType.simpleString()
    # One shuffle: the window and both sorts find a conversation's rows in its partition.
    dealt = own.repartition("conv_id").withColumn("same", F.xxhash64("was", "text"))
    from pyspark.sql import Window

    seen = Window.partitionBy("conv_id", "same", "was", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    counted = dealt.withColumn("copy", F.row_number().over(seen)).withColumn("fault", F.when(~F.col("gone"), faults(F.col("was"), F.col("text"), F.col("copy"))))
    forward = [F.asc_nulls_first("conv_id"), F.asc("gone"), F.asc_nulls_first("turn"), F.asc("was"), F.asc("text"), F.asc("copy")]
    back = [F.desc_nulls_last("conv_id"), F.desc("gone"), F.desc_nulls_last("turn"), F.desc("was"), F.desc("text"), F.desc("copy")]
    columns = ["conv_id", "turn", "was", "text", "gone", "copy", "fault"]

    def scan():
        """Last row first: each row with the vector of the rest and the cost from it on, at the pattern's start."""
        auto = Automaton()

        def run(rows: Iterable[tuple]) -> Iterator[tuple]:
            now, first = None, True
            for row in rows:
                if first or row[0] != now:
                    now, first, v, taken = row[0], False, END, 0
                if row[4]:
                    yield *row, None, None
                    continue
                rest = v
                v, least = auto.move(v, symbol(row[2], row[6]))
                taken += least
                yield *row, packed(rest), taken + v[START]

        return run

    def trace():
        """First row first: the edits."""
        auto = Automaton()

        def run(rows: Iterable[tuple]) -> Iterator[tuple]:
            now, first, seq, state, rest = None, True, 0, START, None
            for conv, turn, was, text, gone, _, fault, after, cost in rows:
                if first or conv != now:
                    if not first:
                        yield from ended(now, seq, state)
                    now, first, seq, state = conv, False, 0, START
                if gone:  # after all others
                    continue
                rest = unpacked(after)
                edits, state = auto.trace(state, rest, symbol(was, fault))
                for letter, role in edits:
                    if letter == "I":
                        yield conv, seq, "I", role, "", None, None, None, cost
                    else:
                        yield conv, seq, letter, {"K": was, "R": role, "D": None}[letter], None if letter == "D" else text, was, turn, fault, cost
                    seq += 1
            if not first:
                yield from ended(now, seq, state)

        return run

    middle = map_rows(counted.select(*columns).sortWithinPartitions(*back), f"conv_id {kind}, turn long, was string, text string, gone boolean, copy int, fault string, rest long, cost long", scan)
    return map_rows(middle.sortWithinPartitions(*forward), f"conv_id {kind}, seq long, edit string, role string, text string, was string, turn long, fault string, cost long", trace)


def symbol(role: str, fault: str | None) -> tuple:
    initial = role[:1]
    return initial if initial in KEPT else "", fault in ("blank", "duplicate"), fault == "truncated"


def ended(conv, seq: int, state: int) -> Iterator[tuple]:
    """Rows that the pattern still wants behind the last one; one row for a conversation without any."""
    if state == START:
        if seq == 0:
            yield conv, 0, None, None, None, None, None, None, 0
    while state in (SYSTEM, USER):
        state = NEXT[state]
        yield conv, seq, "I", NAMES[state], "", None, None, None, INSERT * (1 + (state == USER))
        seq += 1


def summary(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s: conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256.

    gaps: turns missing between the first and the last; illegal: neighbours whose initials aren't su, ua or au; audit:
    the edits' letters; the digest is of the repaired rows as ``role:text``, joined by newlines.
    """

    def make():
        def run(rows: Iterable[tuple]) -> Iterator[tuple]:
            now, held = None, None
            for conv, _, edit, role, text, was, turn, fault, cost in rows:
                if held is None or conv != now:
                    if held is not None:
                        yield held.row(now)
                    now, held = conv, Figures(cost)
                held.add(edit, role, text, was, turn, fault)
            if held is not None:
                yield held.row(now)

        return run

    kind = edits.schema["conv_id"].dataType.simpleString()
    return map_rows(
        edits.select("conv_id", "seq", "edit", "role", "text", "was", "turn", "fault", "cost"),
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
        make,
    )


class Figures:
    """What is counted of one conversation as its edits pass."""

    def __init__(self, cost: int):
        self.cost, self.faults, self.illegal, self.before = cost, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.letters, self.digest, self.repaired = [], hashlib.sha256(), 0
        self.low, self.high, self.turns = None, None, 0

    def add(self, edit, role, text, was, turn, fault) -> None:
        if edit is None:
            return
        self.letters.append(edit)
        if was is not None:
            self.faults[fault] = self.faults.get(fault, 0) + 1
            self.illegal += self.before is not None and self.before[:1] + was[:1] not in ("su", "ua", "au")
            self.before = was
            if turn is not None and turn != self.high:  # in order
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if role is not None:
            self.digest.update((b"\n" if self.repaired else b"") + f"{role}:{text}".encode())
            self.repaired += 1

    def row(self, conv) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        f = self.faults
        return conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: every twentieth row dropped, emptied, without its stops, doubled, or the user's, by crc32 of ``conv_id:turn``.

    Dropped rows stay as ``gone``, so that no conversation is lost. Nulls are read as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how, = fresh(rows, "_how")
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias(how))
    text = F.when(F.col(how) == 1, F.lit("")).when(F.col(how) == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col(how) == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col(how) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col(how) == 0).alias("gone"), F.explode(times).alias("_copy"))
    return out.drop("_copy")
