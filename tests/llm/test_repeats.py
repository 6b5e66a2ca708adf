"""Later copies of strings of 50 bytes against every window by brute force, by SQL, and their parts."""

import random

import numpy as np
import pytest
from oracle import difference, duck
from support import sha

from sparkwave.llm import queries, repeats


def plain(rows, length=50):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    for d, t in rows:
        b = (t or "").encode()
        gone, reach = [False] * len(b), 0
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                for j in range(max(i, reach), i + length):
                    gone[j] = True
                reach = i + length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, sha(kept), kept))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é\0") for _ in range(rng.randint(20, 300))) for _ in range(30)]
    fill = lambda: "".join(rng.choice("xyz é") for _ in range(rng.randint(1, 80)))
    rows = [(d if d % 17 else None, None if d == 5 else "".join(rng.choice(passages) if rng.random() < 0.6 else fill() for _ in range(rng.randint(0, 8)))) for d in range(150)]
    rows += [rows[3], (3, rows[7][1]), (250, rows[10][1]), (251, "ab" * 200), (252, "ab" * 100), (253, "a" * 49), (254, "a" * 49), (255, "a" * 50), (256, "a" * 51), (257, ""), (None, None)]
    # A line with its own surroundings in each of many documents, and a passage that a third of all share.
    line = "a line of some eighty bytes that stands in very many of these documents, as it does"
    return rows + [(300 + i, fill() + str(i) * 9 + line + str(i) * 9 + fill() + (passages[0] if i % 3 == 0 else "")) for i in range(90)]


@pytest.mark.parametrize("seed, unit", [(1, 2000), (2, 8 << 20)])
def test_equals_every_window(spark, seed, unit):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeats.later_copies(docs, unit_bytes=unit, sample=100).collect()
    assert sorted(((*r[:5], bytes(r.kept)) for r in got), key=str) == plain(rows)


def test_awkward_rows_and_an_empty_table(spark, awkward):
    got = repeats.later_copies(awkward).collect()
    assert sorted(((*r[:5], bytes(r.kept)) for r in got), key=str) == plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert repeats.removed_figures(awkward).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert repeats.removed_figures(awkward.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    assert difference(queries.op11_suffix_array_dedup(spark, sf), queries.oracle_sql()["op11_suffix_array_dedup"], duck(sf)) == ""


def test_a_text_of_many_slabs(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3 * repeats.SLAB))
    rows = [(1, long[2 * repeats.SLAB - 500 : 2 * repeats.SLAB + 500]), (2, long), (3, "z" + long[repeats.SLAB - 70 :])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.removed_figures(spark.createDataFrame(rows, "doc_id long, text string"), unit_bytes=1 << 20).collect()}
    assert got == {1: (0, 0), 2: (1000, 1), 3: (2 * repeats.SLAB + 70, 1)}


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    data, length = rng.integers(97, 99, 600).astype(np.uint8), 20
    starts, doc = np.arange(580), rng.integers(0, 9, 580)
    texts = [bytes(data[s : s + length]) for s in starts]
    common = lambda a, b: next((i for i in range(length) if a[i] != b[i]), length)
    want = [max((common(t, u) for u, e in zip(texts, doc) if e < d), default=0) for t, d in zip(texts, doc)]
    assert repeats.longest_previous(repeats.window_keys(data, starts, length), doc, length).tolist() == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 5000).astype(np.uint8)
    h = repeats.kmer_hashes(text, 16)
    anchors = repeats.Anchors(50, [int(x) for x in h[::3]])
    whole, part = (anchors.of(t, np.array([len(t)])) for t in (text, text[1234:3000]))
    each = lambda found, at: {s + at: x for f, t, x in zip(*found) for s in range(f, t + 1)}
    a, b = each(whole, 0), each(part, 1234)
    assert len(a) == 4951 and len(b) == 1717 and all(a[s] == x for s, x in b.items())
