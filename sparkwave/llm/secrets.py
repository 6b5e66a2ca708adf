"""Secret scans: three base patterns, and zstandard novelty of what stands in a sensitive context.

A candidate is an unbroken run of credential characters close after a sensitive word. Its novelty is the number of
bytes by which it lengthens the compressed form of the code around it, under a zstandard dictionary of common
identifiers and parts of words: names and words cost little, since dictionary and surroundings hold their parts; random
strings cost nearly their entropy. Every candidate is measured, and those whose marginal bytes per character reach
``novelty`` are reported as kind ``novel``. Base spans always stay.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The base patterns, in the order of their kinds, with the least length of the group that decides.
BASE = [
    ("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run shorter than 16 holds no match either way
]
KINDS = [k for k, *_ in BASE] + ["novel"]
# Words that make what follows sensitive.
CONTEXT = re.compile(
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|auth[_-]?key|signing[_-]?key|client[_-]?secret)",
    re.ASCII
)
#: The least length of a candidate.
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
# Identifiers and words of source code, for the compressor's dictionary.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 accessKeyId access_key accountName action address admin allowed apiEndpoint api_key application argument array "
    "attribute authentication authorization background baseUrl boolean buffer bytes cache callback certificate changeme character checksum class client_id client_secret collection column command "
    "com.example.service config.properties configuration connection constructor container content-type context controller credential currentUser customer database datetime default delete description "
    "development directory document domain element enabled encoding encryption endpoint environment error example exception execute expires export expression extends extension false field "
    "filename filter final float format function generate getElementById getParameter group handler hashmap header hostname http://localhost:8080/ https://www.example.com/ identifier implements import include index "
    "initialize input insert instance integer interface internal iterator java.lang.String java.util.List javascript keyboard keystore language length library listener localhost location logger login manager "
    "memory message metadata method module mysecretpassword namespace network none null number object operation option org.apache.commons output override package parameter parent password passwordHash "
    "password_reset_token path pattern permission placeholder pointer position primary_key private_key process production project property protected protocol provider public query receiver redirect "
    "refresh_token register release remote repository request required resource response result return runtime scheduler schema secretName secret_key select sequence server service session_token setting "
    "signature socket source standard static status storage string subject subscription super template test_password thread timestamp token_type transaction true undefined update upload user_name "
    "username utils validate value variable version view visible void warning website width window workspace writer xxxxxxxxxxxxxxxx your_api_key_here your_password "
)


# Short words, and beginnings and ends of long ones, for the same dictionary.
PARTS = (
    " the and that with from this have which their about would there been were they will more when said some time into could them other than then only over also after first two may such "
    "should these most many must even because through before between under without within during against where being still while those both each few own same too very just how what who why "
    "tion sion ment ness able ible ance ence ing ings ity ive ous ful less ship hood ward wise ist ism ize ise ation ition ational ically ologist ography ometer olog graph phon tele inter trans "
    "super under over counter extra ultra micro macro multi semi anti auto pre pro con com dis mis non un re de in im sub ex en em heit keit schaft lich ung ungen isch versicherung ment eaux "
    "tion ique eux ion cion dad mente amiento "
)
#: Stands before the surroundings, so that letters cost what they cost in running text, however short those are.
RUNNING = (
    " It is said that most of the people who came to the meeting were not there when the question was first raised, and that none of them had seen what was written about it in the papers of "
    "the following week. "
)


@lru_cache(maxsize=1)
def _codec() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict((PARTS + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal(candidate: str, around: str) -> int:
    """Bytes that the candidate adds to the compressed surroundings."""
    codec, base = _codec(), (RUNNING + around).encode("utf-8", "surrogatepass")
    return len(codec.compress(base + candidate.encode())) - len(codec.compress(base))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base patterns, leftmost and non-overlapping per kind."""
    return [
        (m.start(), k, m.end()) for k,
        (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least
    ]


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Sorted spans (start, kind, end) as runs that don't overlap."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str, reach: int):
    """(start, end) of unbroken runs that start within ``reach`` characters after a sensitive word, in order.

    A run is looked for within reach only and then followed to its end, so the work is in proportion to the text.
    """
    done = 0
    for c in CONTEXT.finditer(text):
        at, last = max(c.end(), done), c.end() + reach
        while at <= last and (m := CANDIDATE.search(text, at, last + LEAST)) and m.start() <= last:
            at = done = CANDIDATE.match(text, m.start()).end()
            yield m.start(), at


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: float, reach: int = 48, around: int = 256) -> list[tuple[int, int, int]]:
    """Incompressible candidates that overlap no base span; ``base`` is sorted."""
    out, taken, k = [], merged(base), 0
    for s, e in candidates(text, reach):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        near = text[max(0, s - around) : s] + text[e : e + around]
        if marginal(text[s:e], near) >= novelty * (e - s):
            out.append((s, len(BASE), e))
    return out


def spans_of(text: str | None, novelty: float) -> tuple[list, list]:
    """Base spans and all spans of a text, each (start, kind's place, end), sorted."""
    base = sorted(base_spans(text)) if text else []
    return base, sorted(base + novel_spans(text, base, novelty)) if text else []


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, novelty: float = 0.72, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Spans are of whole matches, in code points, end exclusive. Null texts are empty and have none. Null ids and repeated
    rows give a row each; an empty table gives an empty result; extra columns are left out. Texts are scanned whole, in
    time that grows with their length. Matches of one kind that start
    together can't occur; of several kinds they are listed in the order of KINDS. Candidates of novelty are runs that
    begin within 48 characters after a sensitive word; they are measured against the 256 characters on both sides.
    """

    def make():
        def run(rows):
            for i, text in rows:
                base, spans = spans_of(text, novelty)
                n = [sum(k == j for _, k, _ in spans) for j in range(len(KINDS))]
                yield i, *n, sha256(shown(base).encode()).hexdigest(), shown(spans)

        return run

    schema = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {dict(docs.dtypes)[id_col]}, {schema}", make)


def redact(text: str | None, novelty: float = 0.72, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    out, at, until = [], 0, 0
    for s, _, e in spans_of(text, novelty)[1]:
        if s >= until:
            out += [text[at:s], mark]
        at = until = max(until, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, novelty: float = 0.72, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced. All rows (repeated ones too) and columns stay; null and empty texts stay as they are."""
    at = docs.columns.index(text_col)

    def make():
        def run(rows):
            for row in rows:
                yield (*row[:at], redact(row[at], novelty), *row[at + 1 :])

        return run

    return map_rows(docs, docs.schema, make)
