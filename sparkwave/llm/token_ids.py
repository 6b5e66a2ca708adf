"""Ids of whole texts by the tokenizers library's model, with memos of what repeats.

The library spends most of its time on normalising, matching and building results; words repeat, so each worker asks
its model for a pre-token once while the memo holds it (``bpe.ChunkMemo``). Tests hold the ids against the library's own.
"""

from __future__ import annotations

import os
from functools import lru_cache
from hashlib import sha256

from .bpe import ChunkMemo, byte_chars, byte_pairs


@lru_cache(maxsize=2)
def text_ids(path: str) -> ChunkMemo:
    """One memo for a worker process; it outlives tasks. ``.ids(text)``: 4-byte unsigned little-endian integers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model, shown = library.model, dict(enumerate(byte_chars()))

    def merge(piece: str) -> list[int]:
        return [t.id for t in model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(shown))]

    return ChunkMemo(byte_pairs(path), merge)


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """Digest of a tokenizer: the vocabulary file's bytes."""
    with open(path, "rb") as f:
        return sha256(f.read()).hexdigest()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
