"""The training-data pipeline: each stage's decision on what its predecessor kept, and the whole against plain versions."""

from collections import defaultdict

import pytest
from support import base_figures, base_secrets, classes, close_fingerprints, simhash

import corpus_pipeline
from sparkwave.llm import queries
from sparkwave.llm.common import Scratch

BLANK = " \t\x0b\f\r"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark, docs, sf):
    """What goes into each stage, and what the last one returns."""
    scratch, now, out = Scratch(spark), docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = now
        now = scratch.save(stage(spark, now, sf), name)
    out["end"] = now
    return out


def test_stages_in_order():
    assert list(STAGES) == ["quality_rules", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_columns_are_those_of_documents(kept, docs):
    for name in [*STAGES][1:]:
        assert kept[name].columns == docs.columns and kept[name].dtypes == docs.dtypes


def test_rejected_documents_go_and_clean_ones_stay(spark, kept, sf):
    left = {r.doc_id: r for r in kept["line_dedup"].collect()}
    for r in kept["quality_rules"].collect():
        if base_figures(r.text)[-1]:
            assert r.doc_id not in left
        elif r.doc_id in left:
            assert left[r.doc_id] == r
    good = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    assert sum(i in left for i in good) / len(good) > 0.95


def test_lines_on_many_pages_of_a_source_go(kept):
    before, after = kept["line_dedup"].collect(), {r.doc_id: r for r in kept["simhash_near_dedup"].collect()}
    pages, on = defaultdict(int), defaultdict(int)
    for r in before:
        pages[r.source] += 1
        for line in {x.strip(BLANK) for x in r.text.split("\n")} - {""}:
            on[r.source, line] += 1
    assert len(after) == len(before)
    for r in before:
        bad = lambda x: x != "" and on[r.source, x] >= 2 and on[r.source, x] > 0.1 * pages[r.source]  # noqa: E731, B023
        text = "\n".join(x for x in r.text.split("\n") if not bad(x.strip(BLANK)))
        assert after[r.doc_id].text == text and after[r.doc_id].n_chars == len(text)


def test_one_document_of_each_group_stays(kept):
    before = sorted(kept["simhash_near_dedup"].collect(), key=lambda r: r.doc_id)
    root = classes(len(before), close_fingerprints([simhash(r.text) for r in before]))
    assert sorted(kept["secret_scans"].collect()) == sorted(before[c] for c in set(root))


def test_no_base_secret_is_left(kept):
    before, after = kept["secret_scans"].collect(), {r.doc_id: r.text for r in kept["best_fit_packing"].collect()}
    assert len(after) == len(before)
    for r in before:
        assert base_secrets(after[r.doc_id]) == "" and (base_secrets(r.text) != "" or "[secret]" in after[r.doc_id] or after[r.doc_id] == r.text)


def test_sequences_hold_all_that_is_left(kept, library):
    total = sum(len(library[0](r.text)) + 1 for r in kept["best_fit_packing"].collect())
    assert sum(r.length for r in kept["end"].collect()) == total


def test_run_equals_the_stages(spark, kept, sf):
    got = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(key).collect()) == sorted(kept["end"].select(key).collect())


def test_awkward_and_empty_documents(spark, awkward, docs, sf):
    for rows in (awkward, docs.limit(0)):
        now, scratch = rows, Scratch(spark)
        for name, stage in corpus_pipeline.STAGES:
            now = scratch.save(stage(spark, now, sf), name)


def test_helper_names_do_not_clash(docs):
    from pyspark.sql import functions as F

    from sparkwave.llm import line_dedup, simhash as op

    odd = docs.limit(20).withColumns({c: F.lit(c) for c in ("_fp", "_ID", "_best", "_host", "_lines", "text_", "line", "host")})
    assert op.retain_one(odd).columns == odd.columns and op.retain_one(odd).count() > 0
    assert line_dedup.drop_boilerplate(odd).count() == 20


@pytest.mark.parametrize("name", ["base_figures", "base_secrets", "op10_html_extraction"])
def test_reduced_queries_equal_sql(spark, sf, name):
    from oracle import difference, duck

    assert difference(queries.queries()[name](spark, sf), queries.oracle_sql()[name], duck(sf)) == ""


def test_every_query_runs(spark, sf):
    assert len(queries.queries()) == 15
    for name, query in queries.queries().items():
        assert query(spark, sf).count() > 0, name
