"""Secret scan: three fixed patterns, and strings that a dictionary-primed zstandard cannot shorten.

A candidate of the second kind is a run of 16 or more key characters with both letters and digits,
within REACH of a sensitive word on its line, on either side, or on the lines that continue it (LINES
at most, where a line ends in an opening sign). A run is cut at the sensitive words in it, and each part
is a candidate; where none is reported, the whole run is one. The base64 lines of a PEM private key are
reported as they are. A candidate's novelty is the number of bytes it adds to the compressed form
of the code around it, with a dictionary of common identifiers primed, over its length. It is
reported when that is at least NOVELTY and no pattern has reported it. Spans are in code points,
end exclusive.

Cases: a null text is empty; very long texts are scanned whole, with a bounded window of code
around each candidate; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.runtime import returning
from corpuslake.llm.textbatch import slices

NOVELTY = 0.75
WINDOW = 256
REACH = 48
LINES = 4
MASK = "[SECRET]"

#: Fixed patterns, with the least length of what they must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: Words near which a string may be a secret (in camel case and the plural too), and what a text must hold to be looked at.
WORDS = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret|signing|encryption)[_\x20-]?key|authorization|bearer|credential|signature)s?(?-i:(?![a-z])(?!(?<=[A-Z])[A-Z]))"
SENSITIVE = re.compile(WORDS, re.I | re.A)
#: Where a run is cut: at a word, with the rest of the name that is assigned to.
CUT = re.compile(WORDS + r"(?:[A-Za-z_]{0,16}=(?=[A-Za-z0-9+/_.-]))?", re.I | re.A)
#: A line that ends in one of these goes on in the next.
OPENERS = (":", "=", "(", "[", "{", ",", "|", ">", "\\", "+")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
BODY, BASE64 = re.compile(r"(?:\s+[A-Za-z0-9+/=]{16,}(?!\S))*"), re.compile(r"[A-Za-z0-9+/=]{16,}|^[A-Za-z0-9+/=]+\r?$", re.M)
HINTS = ("pass", "pwd", "secret", "token", "key", "authorization", "bearer", "credential", "signature")
RUN, LEAST_RUN = re.compile(r"[A-Za-z0-9+/_=.-]+"), 16
#: Identifiers that code around secrets commonly holds.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key client_id client_secret private_key public_key "
    "authorization bearer credential signature username user_name user_id session_id request response config settings "
    "environment production staging development database connection string localhost http https www com org net "
    "example test default value true false null none undefined import export return function class self this const "
    "let var def public private static final void int str bool float list dict array object index length count name "
    "type data path file url uri host port key id email address created_at updated_at timestamp version "
    "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DATABASE_URL Content-Type application/json "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000000000000000 "
)

Span = tuple[int, int, str]


@lru_cache(1)
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that the candidate adds to the code around it, per byte of its own."""
    pack, context, own = _compressor().compress, around.encode("utf-8", "replace"), candidate.encode()
    return (len(pack(context + own)) - len(pack(context))) / len(own)


def base_spans(text: str, lowered: str) -> list[Span]:
    """Leftmost non-overlapping matches of each fixed pattern; matches that are too short are dropped."""
    found: list[Span] = []
    if any(word in lowered for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def window(text: str, start: int, end: int) -> tuple[int, int]:
    """The code around a sensitive word: REACH on its line, and lines that continue it, each way."""
    low, high = text.rfind("\n", max(0, start - REACH), start) + 1 or max(0, start - REACH), end + REACH
    if low and text[low - 1] == "\n":
        for _ in range(LINES):
            above = text.rfind("\n", max(0, low - 1 - WINDOW), low - 1) + 1 or max(0, low - 1 - WINDOW)
            if not text[above : low - 1].rstrip(" \t\r").endswith(OPENERS) or start - above > 2 * WINDOW:
                break
            low = above
            if not low or text[low - 1] != "\n":
                break
    if (line := text.find("\n", end, high)) >= 0:
        high = line
        for _ in range(LINES):
            if not text[max(end, line - WINDOW) : line].rstrip(" \t\r").endswith(OPENERS):
                break
            line = text.find("\n", line + 1, line + 1 + WINDOW)
            high = line if line >= 0 else high + 1 + WINDOW
            if line < 0 or line - end > 2 * WINDOW:
                break
    return low, high


def armoured(text: str) -> Iterator[tuple[int, int]]:
    """The base64 of PEM private keys; without an end mark, the lines of base64 that follow."""
    for m in PEM.finditer(text):
        stop = text.find("-----", m.end())
        if stop < 0 or not text.startswith("-----END", stop):
            stop = BODY.match(text, m.end()).end()
        yield from (b.span() for b in BASE64.finditer(text, m.end(), stop))


def novel_spans(text: str, lowered: str, base: list[Span], least: float) -> list[Span]:
    if not any(hint in lowered for hint in HINTS):
        return []
    words = list(SENSITIVE.finditer(text))
    if not words:
        return []
    found = {span: (*span, "novel") for span in armoured(text)}
    base = sorted([*base, *found.values()])
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    runs = [m.span() for m in RUN.finditer(text) if m.end() - m.start() >= LEAST_RUN]
    run_starts, run_stops = [a for a, _ in runs], [b for _, b in runs]

    def judged(start: int, stop: int) -> bool:
        own = text[start:stop].lstrip("=.-/")
        start = stop - len(own)
        own = own.rstrip(".-")
        end = start + len(own)
        if len(own) < LEAST_RUN or not (re.search(r"[0-9]", own) and re.search(r"[A-Za-z]", own)):
            return False
        before = bisect_left(starts, end)
        if before and furthest[before - 1] > start:
            return False
        if novelty(own, text[max(0, start - WINDOW) : start] + text[end : end + WINDOW]) >= least:
            found[start, end] = (start, end, "novel")
            return True
        return False

    done = bytearray(len(runs))  # which runs were judged
    for word in words:
        low, high = window(text, *word.span())
        for i in range(bisect_right(run_stops, low), bisect_left(run_starts, high)):
            if done[i]:
                continue
            done[i], (start, stop) = 1, runs[i]
            at, hit, cut = start, False, False
            for inner in CUT.finditer(text, start, stop):
                cut = True
                hit |= judged(at, inner.start())
                at = inner.end()
            hit |= judged(at, stop)
            if cut and not hit:
                judged(start, stop)
    return list(found.values())


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(text: str | None, least: float = NOVELTY) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one text; both by start, then kind."""
    text = text or ""
    lowered = text.lower()
    base = base_spans(text, lowered)
    return ordered(base), ordered(base + novel_spans(text, lowered, base, least))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str | None, spans: list[Span], mask: str = MASK) -> str | None:
    """The text with every span replaced; spans that overlap become one mask."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for start, stop, _ in sorted(spans):
        if start >= end:
            out += [text[at:start], mask]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def scanned(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for every document; no shuffle."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                rows = []
                for text in part:
                    base, spans = scan(text.as_py(), least)
                    kinds = [kind for _, _, kind in base]
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, written(spans), len(spans) - len(base)))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), *columns], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(returning(find), schema)


def redacted(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """The documents with every secret masked and n_chars set anew; other columns stay."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, scan(t, least)[1]) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(returning(mask), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
