"""Conversation repair against a plain search over all edits, and by SQL."""

import random
import re
import zlib
from functools import lru_cache

import pytest
from oracle import difference, duck
from support import sha

from sparkwave.llm import conversations, queries

GAP = re.compile(r"[\x20\x09-\x0D]+")
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def plain(ids, rows):
    """For every conversation: all edit sequences, by dynamic programming over what roles they have given so far."""
    out = []
    for conv in ids:
        mine = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
        seen, kinds = set(), []
        for _, role, text in mine:
            bare = GAP.sub(" ", text).strip(" ")
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserted=0):
            """(cost, letters, repaired) of the rest; state: '' or the last role's initial."""
            found = []
            if i == len(mine) and state in ("", "a"):
                found.append((0, "", ()))
            wanted = "assistant" if state == "u" else "user"
            if inserted < 3:
                c, a, r = best(i, wanted[0], inserted + 1)
                found.append((c + 5, "I" + a, (f"{wanted}:", *r)))
            if i < len(mine):
                _, role, text = mine[i]
                c, a, r = best(i + 1, state)
                found.append((c + 2, "D" + a, r))
                if kinds[i] not in ("blank", "duplicate"):
                    late = 5 * (kinds[i] == "truncated")
                    if role[:1] == wanted[0] or role[:1] == "s" and state == "":
                        c, a, r = best(i + 1, role[:1])
                        found.append((c + late, "K" + a, (f"{role}:{text}", *r)))
                    c, a, r = best(i + 1, wanted[0])
                    found.append((c + late + 1, "R" + a, (f"{wanted}:{text}", *r)))
            return min(found, default=(10**9, "", ()))

        cost, audit, repaired = best(0, "")
        assert GRAMMAR.match("".join(x[0] for x in repaired))
        turns = {t for t, _, _ in mine if t is not None}
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(repaired))))
    return sorted(out, key=str)


def made(seed, conversations_=40):
    rng, rows = random.Random(seed), []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Ünit", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut", "", " \n", "A. ", "b", f"line {turn}.", f"long {conv}", None])
            rows.append((conv if conv % 13 else None, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def results(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = made(seed)
    table = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, seq long, gone string").repartition(5)
    ids = {r[0] for r in rows}
    assert results(conversations.summary(conversations.repair(table.drop("gone")))) == plain(ids, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    got = conversations.summary(conversations.repair(conversations.damage(table), gone_col="gone"))
    assert results(got) == plain(ids, hurt(rows))


def test_query_equals_sql_and_the_search(spark, sf):
    got = queries.op12_conversation_structure_repair(spark, sf)
    assert difference(got, queries.oracle_sql()["op12_conversation_structure_repair"], duck(sf)) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(got) == plain({r[0] for r in rows}, hurt(rows))


def test_dropped_conversations_stay_and_an_empty_table_is_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "gone.")], "conv_id long, turn long, role string, text string")
    got = conversations.summary(conversations.repair(conversations.damage(table), gone_col="gone"))
    assert results(got) == [(dropped, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert conversations.summary(conversations.repair(conversations.damage(table.limit(0)), gone_col="gone")).count() == 0


def test_edits_are_rows_in_order(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", ""), (1, 3, "system", "Late.")]
    got = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [(r.edit, r.role, r.text, r.was) for r in got] == [("D", None, None, "user"), ("K", "user", "There.", "user"), ("D", None, None, "assistant"), ("R", "assistant", "Late.", "system")]
    assert got[0].cost == 5 and got[2].fault == "blank"


def test_a_long_conversation_is_a_stream(spark):
    """A third of all rows in one conversation; its automaton stays small."""
    rng, auto, v = random.Random(7), conversations.Automaton(), conversations.END
    for _ in range(200_000):
        v, _ = auto.move(v, (rng.choice("sua "), rng.random() < 0.1, rng.random() < 0.1))
    assert len({rest for rest, _ in auto.moves}) < 200
    long = [(0, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"t {i}.", f"cut {i}"])) for i in range(3000)]
    rows = long + [(1 + i // 8, i % 8, ["user", "assistant"][i % 2], f"w {i}.") for i in range(6000)]
    got = conversations.summary(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got.count() == 751
    first = got.where("conv_id = 0").head()
    assert len(first.audit.replace("I", "")) == 3000 and got.agg({"cost": "sum"}).head()[0] == first.cost
