"""The divergence audit against plain counting, and by SQL."""

import re
from collections import Counter, defaultdict

import pytest
from oracle import difference, duck

from sparkwave.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, top=200):
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        lang, source = lang or "", source or ""
        groups[lang, source].update(found)
        langs[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t in docs[lang] if docs[lang][t] >= 3]

        def p(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // total for t in kept}

        mine, whole = p(own), p(langs[lang])
        f = lambda t, q: (mine[t] - q[t]) ** 2 // q[t]
        pairs = [(sum(f(t, q) for t in kept), s) for (other, s), count in groups.items() if other == lang and s != source for q in [p(count)]]
        terms = [(f(t, whole), t) for t in kept if own[t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


ROWS = [("en", "a", "One two THREE one"), ("en", "b", "two two three é"), ("en", "c", "one\0two_three é É ß"), ("en", "c", "one two"), ("en", None, None), ("de", "a", "nur hier"), (None, None, "x x x"), (None, "z", "x"), (None, "z", "x y"), ("en", "", "two é"), ("fr", "lone", "un un un")]


@pytest.mark.parametrize("top, size", [(200, 8 << 20), (1, 7)])
def test_equals_plain_counting(spark, top, size):
    rows = [*ROWS, *ROWS[:3]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, term int").repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, top=top, shard_bytes=size).collect())) == plain(rows, top)


def test_documents_awkward_rows_and_an_empty_table(spark, awkward, docs):
    small = docs.limit(60)
    for rows in (awkward, small):
        assert sorted(map(tuple, divergence.audit(rows).collect())) == plain([(r.lang, r.source, r.text) for r in rows.collect()])
    assert divergence.audit(awkward.limit(0)).count() == 0


def test_query_equals_sql(spark, sf):
    assert difference(queries.op13_source_divergence_audit(spark, sf), queries.oracle_sql()["op13_source_divergence_audit"], duck(sf)) == ""


def test_terms_are_cut_at_any_byte_that_is_no_letter():
    place, found = divergence.terms(["Ab1cD".encode(), b"", "éÉ\x7fz ".encode()])
    assert place.tolist() == [0, 0, 2, 2] and found.to_pylist() == ["ab", "cd", "éÉ", "z"]


def test_counts_are_handed_on_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "source": ["a", "b"] * 3, "text": [b"one two", b"one", b"Two two", b"", b"three", b"one one"]})
    found = Counter()
    for b in divergence.count_terms(cut=4, most=2)(iter([batch, batch])):
        for r in b.to_pylist():
            found[r["source"], r["term"]] += complex(r["n"], r["docs"])
    assert found == {("a", "one"): 2 + 2j, ("a", "two"): 6 + 4j, ("a", "three"): 2 + 2j, ("b", "one"): 6 + 4j}
