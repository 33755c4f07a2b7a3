"""Secrets: fixed forms, and strings that zstandard cannot compress against their context.

Base kinds, matched from left to right without overlap; matches that fail a length rule are
dropped:

* ``assign``: a name such as ``password`` or ``api_key``, ``:`` or ``=``, and 12 or more
  characters of a value (the span is the whole match)
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters
* ``hex``: 16 or more lower-case hexadecimal digits

Novelty. A candidate is a run of ``MIN_CANDIDATE`` or more key characters with letters and
digits in a sensitive context, outside the base spans (``hex`` counts as one only where no
letter or digit goes on beside it). Sensitive are the line of a sensitive word, the next line
with text after a line that ends in such a word and ``:`` or ``=``, and all lines between
``-----BEGIN`` and ``-----END`` of a key, where letters alone are enough. The compressor is
primed with a dictionary of identifiers followed by the text around the candidate (other
occurrences of the candidate left out, so that a repeated key is as new as a single one); its
marginal size is that of the candidate compressed with this dictionary less that of nothing.
At ``MIN_NOVELTY`` bytes for each of its characters or more it is reported as ``novel``. From
about 40 characters on, the compressor codes even random characters with the 4 to 6 bits
that their alphabet needs, so a longer candidate is also measured in equal windows of at most
``WINDOW`` characters, and the sum of their sizes counts if it is larger.

``spans`` are ordered by start, then by kind as listed; positions count code points, ends are
exclusive. Texts of any length are scanned in one pass: lines, spans and blocks are met in
order, and only the ``CONTEXT`` around a candidate is compressed. Null text is empty and stays
null when redacted; repeated rows each get their row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfscope.llm.common import arrow_map, over_texts, short_batches, utf8

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
MIN_CANDIDATE = 20
MIN_NOVELTY = 0.9
WINDOW = 32
CONTEXT = 2048
MASK = "[SECRET]"
IDENTIFIERS = (
    "access_key access_token account api_key apikey application auth authorization base64 bearer "
    "certificate client_id client_secret config connection credential credentials database "
    "default encryption environment export function header http https import key localhost "
    "login passphrase passwd password port private_key production public_key refresh_token "
    "return secret secret_key self server service session signature ssh-rsa string test token "
    "username value version webhook www abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 0000000000000000 xxxxxxxxxxxxxxxx example changeme placeholder"
).encode()
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
_SENSITIVE = re.compile(
    r"passw(?:or)?d|passphrase|secret|token|credential|api[_-]?key|private|auth|bearer|signature|key\b",
    re.ASCII | re.IGNORECASE,
)
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*KEY[A-Z0-9 ]*-----")
#: a line that announces the next one
_NEXT = re.compile(
    r"(?:passw(?:or)?d|passphrase|secret|token|credentials?|key|auth|bearer|signature)[\"']?\s*[:=]\s*\Z",
    re.IGNORECASE,
)
_TEXT = re.compile(r"[^\x20\x09-\x0D]")
_CUES = (b"-----begin", b"passw", b"passphrase", b"secret", b"token", b"credential", b"key", b"private", b"auth", b"bearer", b"signature")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per character of a candidate in its surroundings, exact
    below ``MIN_NOVELTY`` only as far as needed to tell that it is below."""
    primer = zstandard.ZstdCompressionDict(
        IDENTIFIERS + utf8(around), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    packer = zstandard.ZstdCompressor(
        level=19, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    nothing = len(packer.compress(b""))
    raw = utf8(candidate)
    whole = len(packer.compress(raw)) - nothing
    # equal windows; they end when the rest cannot change the answer
    parts = -(-len(raw) // WINDOW)
    cuts = [len(raw) * i // parts for i in range(parts + 1)] if parts > 1 else []
    found, least = 0, MIN_NOVELTY * len(raw)
    for start, end in zip(cuts, cuts[1:]):
        if max(whole, found) >= least or found + 1.1 * (len(raw) - start) < least:
            break
        found += len(packer.compress(raw[start:end])) - nothing
    return max(whole, found) / len(raw)


def _sensitive(text: str) -> list[tuple[int, int, bool]]:
    """Sensitive ranges in order, without overlap; with each: is it the body of a block?"""
    blocks = []
    at = 0
    while (m := _BEGIN.search(text, at)) is not None:
        end = text.find("-----END", m.end())
        at = len(text) if end < 0 else end
        blocks.append((m.end(), at, True))
    lines = []
    at = 0
    for m in _SENSITIVE.finditer(text):
        if m.start() < at:
            continue
        start = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if _NEXT.search(text, max(start, end - 200), end):
            more = _TEXT.search(text, end)
            if more:
                end = text.find("\n", more.start())
                end = len(text) if end < 0 else end
        at = end
        lines.append((start, end, False))
    # blocks first: a line keeps what stands outside them
    out, b = [], 0
    for start, end, _ in lines:
        while b < len(blocks) and blocks[b][1] <= start:
            b += 1
        k = b
        while k < len(blocks) and blocks[k][0] < end:
            if start < blocks[k][0]:
                out.append((start, blocks[k][0], False))
            start = max(start, blocks[k][1])
            k += 1
        if start < end:
            out.append((start, end, False))
    return sorted(out + blocks)


def _around(text: str, a: int, b: int) -> str:
    """The text around a candidate, without other occurrences of it."""
    return (text[max(0, a - CONTEXT) : a] + text[b : b + CONTEXT]).replace(text[a:b], "")


def _novel(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates that are new. ``taken``: spans of the base kinds, ordered by start."""
    found = []
    starts = [x for x, _ in taken]
    # the furthest end of the spans so far
    ends = list(accumulate((y for _, y in taken), max))
    for start, end, block in _sensitive(text):
        for c in _CANDIDATE.finditer(text, start, end):
            a, b = c.span()
            own = c.group()
            before = bisect_left(starts, b)
            if before and ends[before - 1] > a:
                continue
            if not re.search("[A-Za-z]", own) or not (block or re.search("[0-9]", own)):
                continue
            if novelty(own, _around(text, a, b)) >= MIN_NOVELTY:
                found.append((a, b))
    return found


def _piece(text: str, start: int, end: int, kind: int) -> bool:
    """A run of hexadecimal digits inside a longer string, which is judged as a whole."""
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return kind == 2 and any(c.isascii() and c.isalnum() for c in beside)


def find(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` in the order of ``spans``."""
    if not text:
        return []
    low = utf8(text).lower()
    out = []
    if any(n in low for n in _NAMES):
        out += [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 12]
    if b"akia" in low:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    if any(n in low for n in _CUES):
        out += [(a, b, 3) for a, b in _novel(text, sorted(x[:2] for x in out if not _piece(text, *x)))]
    return sorted(out, key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans if k < kinds)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_spans, spans)`` per document."""

    def work(ids: list, texts: list) -> tuple:
        found = [find(t) for t in texts]
        counts = [[sum(s[2] == k for s in f) for f in found] for k in range(len(BASE))]
        return ids, *counts, [joined(f, len(BASE)) for f in found], [joined(f) for f in found]

    schema = StructType(
        [docs.schema[id_col], *(StructField(f"n_{k}", LongType()) for k in BASE),
         StructField("base_spans", StringType()), StructField("spans", StringType())]
    )
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)


def mask(text: str | None) -> str | None:
    """The text with every secret replaced by ``MASK``; overlapping spans become one."""
    found = find(text)
    if not found:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in found:
        if a >= end:
            if end >= 0:
                out.append(MASK)
                at = end
            out.append(text[at:a])
        end = max(end, b)
    return "".join([*out, MASK, text[end:]])


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """All documents, secrets masked; ``chars_col`` follows where the text changed."""

    own = "__masked"
    while own in docs.columns:
        own += "_"
    out = short_batches(docs).withColumn(own, over_texts(mask, StringType())(F.col(text_col)))
    if chars_col:
        kind = docs.schema[chars_col].dataType
        same = F.col(own).eqNullSafe(F.col(text_col))
        new = F.when(same, F.col(chars_col)).otherwise(F.length(own).cast(kind))
        out = out.withColumn(chars_col, new)
    return out.withColumn(text_col, F.col(own)).select(docs.columns)
