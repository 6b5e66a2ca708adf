"""Quality rules by line labelling: a chain CRF marks lines as content or boilerplate; their share decides.

Base figures and the share come from one narrow pass over whole texts. The model is trained on a bounded sample of
labelled documents (lowest hashes of doc_id first). Labels tell of documents, so the labels of lines are learnt: a
document's label bounds the share of its words that lines marked as content may hold (``learn``). Weights are pulled
towards a documented prior, which also is the model if nothing is labelled.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .crf import Chain, label_within, train

SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = frozenset(SYMBOLS.encode())
# Phrases of page furniture, lower case.
FURNITURE = re.compile(
    rb"https?://|www\.|cookie|copyright|all rights reserved|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in|click here|read more|newsletter|share this|javascript"
)
ENDS = re.compile(rb"[.!?:;][\"')\]]*$")

#: Features of a line, in the order of their bits, with the prior's weight for content over boilerplate.
FEATURES = [
    ("any", 1.0),
    ("symbols on many words", -2.5),
    ("exclamation on many words", -2.5),
    ("bars between words", -2.5),
    ("mostly capitals", -1.5),
    ("words repeat", -2.0),
    ("line seen before", -1.0),
    ("one or two words", -0.3),
    ("ends like a sentence", 0.7),
    ("ten words or more", 0.5),
    ("digits in many words", -1.0),
    ("page furniture in a short line", -5.0),
    ("odd word length", -0.5),
]
PRIOR = Chain([(-w / 2, w / 2) for _, w in FEATURES], [(0.5, -0.5), (-0.5, 0.5)])


def line_mask(line: bytes, words: list[bytes], again: bool) -> int:
    """Bits of FEATURES for a line with at least one word."""
    n = len(words)
    letters = sum(len(w) for w in words)
    symbols = sum(w[-1] in SYMBOL_BYTES and len(w) > 1 for w in words)
    bang = sum(w.endswith(b"!!") for w in words)
    bars = words.count(b"|") + words.count(b"-") + words.count(b"\xc2\xbb")
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    digits = sum(48 <= w[0] <= 57 for w in words)
    flags = (
        True, 4 * symbols > n, 4 * bang > n, 6 * bars > n, 2 * upper > n, n >= 8 and 2 * len(set(words)) < n, again, n < 3,
        ENDS.search(words[-1]) is not None, n >= 10, 4 * digits > n, n < 16 and FURNITURE.search(line.lower()) is not None, not 2 * n <= letters <= 16 * n,
    )
    return sum(1 << i for i, f in enumerate(flags) if f)


def repeat_words(words: list[bytes], span: int = 5) -> int:
    """Words that lie in windows of ``span`` words found twice or more in the text, the first included."""
    n = len(words)
    if n <= span or len(set(words)) == n:
        return 0
    # Equal windows get equal numbers, exactly: numbers of words, then of pairs, fours and the window.
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    window, width = ids, 1
    while width < span:
        step = min(width, span - width)
        part = window[: n - width - step + 1] * (int(window.max()) + 1) + window[step : n - width + 1]
        window, width = np.unique(part, return_inverse=True)[1], width + step
    found = np.flatnonzero(np.bincount(window)[window] > 1)
    if not len(found):
        return 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + span, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def read(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, masks of lines with a word, words of those lines."""
    text = text or ""
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    words, masks, sizes, seen, dup = [], [], [], set(), 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        # bytes.split() cuts at the same six white-space characters as the contract's pattern.
        if found := line.split():
            again = line in seen
            dup += again
            seen.add(line)
            masks.append(line_mask(line, found, again))
            sizes.append(len(found))
            words += found
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeat_words(words), masks, sizes


def _runs(most_lines: int):
    def make():
        def run(rows):
            for i, label, text in rows:
                *_, masks, sizes = read(text)
                first = crc32((text or "").encode("utf-8", "surrogatepass")) % max(1, len(masks) - most_lines + 1)
                at = slice(first, first + most_lines)
                yield i, label, masks[at], sizes[at]

        return run

    return make


def learn(runs: list[tuple[int, list[int], list[int]]], rounds: int = 3, steps: int = 50, good: float = 0.9, bad: float = 0.45) -> Chain:
    """A chain from runs of lines (quality of the document, masks, words) whose own labels aren't known.

    Expectation maximisation with best labellings: lines get the labels that the chain of the round before likes best,
    within what the document's label says (quality 1: at least ``good`` of the words are content, quality 0: at most
    ``bad``), and the weights are learnt from those. Weights of label pairs are held close to the prior's: documents are
    mostly of one kind, and would teach that labels never change. Equal runs count once.
    """
    runs = sorted({(q, tuple(masks), tuple(words)) for q, masks, words in runs if masks})
    if not runs:
        return PRIOR
    quality, masks, words = zip(*runs)
    is_good, chain = np.array(quality) > 0, PRIOR
    for _ in range(rounds):
        labels = label_within(chain, masks, words, np.where(is_good, good, 0.0), np.where(is_good, 1.0, bad))
        chain = train(PRIOR, masks, labels, rounds=steps, pull_moves=float(len(runs)), start=chain)
    return chain


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 3000, most_lines: int = 100, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """``learn`` from at most ``most_docs`` labelled documents; of one with more than ``most_lines`` lines, a run of that many neighbouring ones.

    The sample: labelled ids with the lowest hashes. Labels that are null or an id with both labels are left out; an id
    with several texts gives one run.
    """
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max("quality").alias("r")
    ).where("q = r")
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "q", "text")
    runs = map_rows(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, q int, masks array<int>, sizes array<int>", _runs(most_lines))
    got = runs.groupBy("doc_id").agg(F.min(F.struct("q", "masks", "sizes")).alias("run")).select("run.*").collect()
    return learn([(min(max(r.q, 0), 1), r.masks, r.sizes) for r in got])


def judge(docs: DataFrame, chain: Chain = PRIOR, least_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base figures, base_failed, n_lines, n_content_lines, content_share, kept.

    Words are runs of characters other than the six ASCII white-space ones. n_dup_lines counts lines with a word that
    equal an earlier line. base_failed: under 10 words, or over 20 % of words in repeated five-word windows. kept: not
    base_failed, and at least ``least_share`` of the words lie in lines that the chain labels content. Null and empty
    texts fail. Null ids and repeated rows give a row each; an empty table gives an empty result; extra columns are left out.
    """

    def make():
        def run(rows):
            for i, text in rows:
                n, chars, symbols, dup, repeat, masks, sizes = read(text)
                label = chain.viterbi(masks)
                share = sum(s for s, y in zip(sizes, label) if y) / n if n else 0.0
                failed = n < 10 or 100 * repeat > 20 * n
                yield i, n, chars, symbols, dup, repeat, failed, len(masks), sum(label), share, not failed and sum(
                    s for s, y in zip(sizes, label) if y
                ) >= least_share * n

        return run

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"
    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, {schema}", make)


def retain(docs: DataFrame, chain: Chain = PRIOR, least_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in the same narrow pass."""
    at = docs.columns.index(text_col)

    def make():
        def run(rows):
            for row in rows:
                n, _, _, _, repeat, masks, sizes = read(row[at])
                if n >= 10 and 100 * repeat <= 20 * n and sum(s for s, y in zip(sizes, chain.viterbi(masks)) if y) >= least_share * n:
                    yield row

        return run

    return map_rows(docs, docs.schema, make)


def label_lines(docs: DataFrame, chain: Chain = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, is_content) for each line with a word, line counted among those from 0."""

    def make():
        def run(rows):
            for i, text in rows:
                for k, y in enumerate(chain.viterbi(read(text)[5])):
                    yield i, k, bool(y)

        return run

    return map_rows(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
        f"doc_id {dict(docs.dtypes)[id_col]}, line long, is_content boolean",
        make
    )
