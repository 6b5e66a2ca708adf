"""BPE encoding and decoding of whole texts with the merge queue of ``bpe.BytePairs``."""

from __future__ import annotations

from array import array
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_pairs, chunk_memo
from .common import map_rows
from .token_ids import vocabulary


def encode(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: 4-byte unsigned little-endian integers) of every row. A null text is empty.

    Null ids and repeated rows give a row each; an empty table gives an empty result; extra columns are left out.
    """
    vocab = vocab or vocabulary()

    def make():
        ids = chunk_memo(vocab).ids

        def run(rows):
            for i, text in rows:
                yield i, ids(text)

        return run

    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, ids binary", make)


def decode(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id, ids: vocabulary strings, concatenated as the library does without a decoder. Null ids: empty."""
    vocab = vocab or vocabulary()

    def make():
        bpe = byte_pairs(vocab)

        def run(rows):
            for i, ids in rows:
                yield i, bpe.decode(array("I", ids or b""))

        return run

    return map_rows(encoded.select("doc_id", "ids"), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string", make)


def round_trip(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass: the digests of what ``encode`` and then ``decode`` give."""
    vocab = vocab or vocabulary()

    def make():
        ids_of, bpe = chunk_memo(vocab).ids, byte_pairs(vocab)

        def run(rows):
            for i, text in rows:
                ids = ids_of(text)
                yield i, len(ids) // 4, sha256(ids).hexdigest(), sha256(bpe.decode(array("I", ids)).encode()).hexdigest()

        return run

    return map_rows(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
        ), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string", make
    )
