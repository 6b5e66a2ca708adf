"""Byte-pair encoding with a queue of merge ranks, and the lookups built on it.

``BytePairs`` encodes one pre-token: its symbols form a doubly linked list, every adjacent pair that has a
merge waits in a priority queue ordered by (rank, position), and an entry whose pair has changed since it was
queued is stale and skipped. Decoding concatenates vocabulary strings the way a tokenizer without a decoder
does, one space between tokens.

Texts are cut at white space first. No pre-token crosses white space, normalisation never composes across it,
and the special strings contain none, so a text's ids are its chunks' ids in order; chunks repeat, and so do the
pre-tokens of those that are new, hence ``ChunkMemo``. The memos are bounded: they affect speed only.

Characters are letters, digits and cases by Unicode tables, and those of Python, of its ``regex`` module and of the
library are of different versions. They agree on what Python's table assigns (tests ask the library for every code
point) as long as nothing is to be composed or put in order; a chunk that isn't normalised, or has any other character,
is normalised and split by the library itself.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

# The pattern of the vocabulary file's splitter, and the white space of its engine.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHUNKS = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """White-space separated chunks; ``str.split`` also cuts at four control characters that are not white space here."""
    return CHUNKS.findall(text) if SEPARATORS.search(text) else text.split()


def byte_chars() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b if b in set(shown) else 256 + hidden.index(b)) for b in range(256)]


class BytePairs:
    """Ids of texts for a vocabulary file with word ends (kind BPE, suffix on the last symbol of a pre-token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.base = max(self.names) + 1
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.rank = {vocab[a] * self.base + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.inner = [vocab[c] for c in byte_chars()]
        self.last = [vocab[c + suffix] for c in byte_chars()]
        self.pieces = regex.compile(PIECES)
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(byte_chars())}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        n, base, rank, merged = len(sym), self.base, self.rank.get, self.merged
        queue = [r * n + i for i in range(n - 1) if (r := rank(sym[i] * base + sym[i + 1])) is not None]
        if not queue:
            return sym
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            r, i = divmod(heappop(queue), n)
            j = after[i]
            if sym[i] < 0 or j >= n or rank(sym[i] * base + sym[j]) != r:
                continue  # stale: one of the two symbols has been merged meanwhile
            sym[i], sym[j] = c, _ = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(c * base + sym[k])) is not None:
                    heappush(queue, q * n + i)
            h = before[i]
            if h >= 0 and (q := rank(sym[h] * base + c)) is not None:
                heappush(queue, q * n + h)
        return [s for s in sym if s >= 0]

    def library_split(self, text: str) -> list[str]:
        """Pre-tokens of a text by the library's normaliser and splitter, which gives each byte as a visible character."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        shown = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in shown]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not text.isascii():
            # Marks and compositions that the library's older table lacks change nothing in normalised text.
            if not unicodedata.is_normalized("NFC", text) or any(unicodedata.category(c) == "Cn" for c in text):
                return self.library_split(text)
            # One character at a time, as the library does: a final sigma is no special case.
            text = text.replace("Σ", "σ")
        low = text.lower()
        return [low] if low.isalpha() else self.pieces.findall(low)

    def ids(self, text: str, of_piece) -> bytes:
        """Packed ids of any text, special strings included; ``of_piece`` gives those of a pre-token."""
        if self.cut is None or "<" not in text:
            return b"".join(map(of_piece, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(of_piece, self.split(text[at : m.start()]))
            out.append(packed([self.special[m.group()]]))
            at = m.end()
        return b"".join([*out, *map(of_piece, self.split(text[at:]))])

    def encode(self, text: str) -> list[int]:
        """Ids of any text."""
        return array("I", self.ids(text, lambda p: packed(self.merge(p.encode())))).tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, concatenated with one space between; unknown ids are left out."""
        return " ".join([s for s in map(self.names.get, ids) if s is not None])


class ChunkMemo(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers. At most twice ``most`` chunks stay.

    A pre-token is kept like a chunk: as a chunk it would be that one pre-token.
    """

    def __init__(self, bpe: BytePairs, merge=None, most: int = 400_000):
        super().__init__()
        self.bpe, self.most, self.old = bpe, most, {}
        self.merge = merge or (lambda p: bpe.merge(p.encode()))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.bpe.ids(chunk, self.of_piece)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of_piece(self, piece: str) -> bytes:
        ids = self.get(piece) or self.old.get(piece)
        if ids is None:
            ids = packed(self.merge(piece))
            if len(piece) <= 64:
                self[piece] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text (None: none), 4 bytes each."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, chunks(text))) if text else b""


def packed(ids) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        raise RuntimeError("unsigned int of 4 bytes expected")
    return a.tobytes()


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


@lru_cache(maxsize=2)
def chunk_memo(path: str) -> ChunkMemo:
    """One memo for a worker process; it outlives tasks."""
    return ChunkMemo(byte_pairs(path))
