import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["TOKENIZERS_PARALLELISM"] = "false"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, slot int, sequence_id string"
#: Nulls, empty texts, ties, repeated rows, odd characters, special strings, and columns whose names clash with results.
AWKWARD = [None, "", " \n\t ", "one", "one", "A B C", "a b c", "Σ ΟΔΟΣ İstanbul ŉ ﬁ é Å", "<|endoftext|> inside<|startoftext|>text", "x" * 50_000, "\n".join(["same line of words here"] * 40), "tab\tand\x0bvertical\x1funit\x85next\xa0nbsp 　wide"]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 == 0 else "s", None, "f", 3, "q") for i, t in enumerate(AWKWARD)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(4).persist()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)
