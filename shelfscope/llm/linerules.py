"""Line-first cleaning: rules per line, then a document-level limit on what was lost.

A line with a word fails if it is

* navigation: two or more separator words (``|``, ``>``, ``»``, ``·``, ``•``, ``/``), at
  least one to five words
* boilerplate: one of ``BOILERPLATE`` in it, case ignored
* badly punctuated: it has no end mark, or over a quarter of its words end in two or more of
  ``!?`` or in one of the symbols ``#*$%&|<>``

An end mark is a last character that ends sentences in any script, or a closing bracket or
quotation mark, or one of ``:;…``. A line without one that the next line continues (it
follows at once and begins with a lower-case letter, or one of a script without case) is judged
by the line that ends the run: wrapped sentences pass, a run that never ends does not.

Failing lines are removed. A document is rejected if it fails the base rule (under
``min_words`` words, or over half of its words in repeated three-word windows) or if more
than ``max_lost`` of its word characters stood in removed lines.

Null text counts as empty: no words, base rule failed, cleaned text null. Blank lines are
kept as they are and count neither way. Repeated rows each get their row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from shelfscope.llm.common import arrow_map, over_texts, short_batches, utf8

MIN_WORDS = 50
MAX_LOST = 0.5
#: from the character classes: sentence terminals, closing and both kinds of quoting marks
_ENDING = regex.compile(r"[\p{Sentence_Terminal}\p{Pe}\p{Pf}\p{Pi}:;…\"']")
ENDINGS = frozenset(c for c in map(chr, range(0x110000)) if _ENDING.match(c))
_GOES_ON = regex.compile(r"[\p{Ll}\p{Lo}]")
SEPARATORS = ("|", ">", "»", "·", "•", "/")
BOILERPLATE = (
    "all rights reserved", "alle rechte vorbehalten", "apache license", "aviso legal", "click here", "cookie policy", "enable javascript",
    "licensed under", "lorem ipsum", "mit license", "nutzungsbedingungen", "powered by",
    "privacy policy", "share on facebook", "sign up for", "subscribe to our", "terms of service",
    "terms of use", "todos los derechos reservados", "use of cookies", "we use cookies",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.ASCII | re.IGNORECASE)
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SEPARATORS = frozenset(utf8(x) for x in SEPARATORS)
_ODD = re.compile(rb"(?:[!?][!?]|[#*$%&|<>])(?=[ \t-\r]|\Z)")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    if size == n:
        return 0
    if size < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * size + ids[2:]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def line_fault(line: bytes, words: list[bytes], ended: bool) -> str | None:
    """The rule that a line with words fails, if any. ``ended``: does it, or the run of lines
    that it begins, have an end mark?"""
    n = len(words)
    bars = sum(w in _SEPARATORS for w in words)
    if bars >= 2 and bars * 5 >= n:
        return "navigation"
    if _BOILERPLATE.search(line.decode("utf-8")):
        return "boilerplate"
    if not ended or len(_ODD.findall(line)) * 4 > n:
        return "punctuation"
    return None


def ended_lines(lines: list[list[bytes]]) -> list[bool]:
    """For lines given as words: has the line, or the run that it belongs to, an end mark?"""
    out = [False] * len(lines)
    goes_on = False  # does the line below continue one above?
    below = False
    for i in range(len(lines) - 1, -1, -1):
        words = lines[i]
        if not words:
            goes_on = False
            continue
        own = words[-1].decode("utf-8")[-1] in ENDINGS
        below = out[i] = own or (goes_on and below)
        goes_on = _GOES_ON.match(words[0].decode("utf-8")) is not None
    return out


def judge(text: str | None, min_words: int = MIN_WORDS, max_lost: float = MAX_LOST) -> tuple:
    """All results for one text, the cleaned text last."""
    raw = utf8(text or "")
    words = raw.split()
    symbols = len(_SYMBOLS.findall(raw))
    seen: set[bytes] = set()
    dups = chars = lost = lines = failed = 0
    clean = []
    split = [(line, line.split()) for line in raw.split(b"\n")]
    for (line, own), ended in zip(split, ended_lines([own for _, own in split]), strict=True):
        if not own:
            clean.append(line)
            continue
        lines += 1
        dups += line in seen
        seen.add(line)
        size = len(b"".join(own).decode("utf-8"))
        chars += size
        if line_fault(line, own, ended):
            failed += 1
            lost += size
        else:
            clean.append(line)
    repeated = repeat_words(words)
    base = len(words) < min_words or 100 * repeated > 50 * len(words)
    kept = not base and lost <= max_lost * chars
    cleaned = None if text is None else text if not failed else b"\n".join(clean).decode("utf-8")
    return len(words), chars, symbols, dups, repeated, base, kept, lines, failed, lost, cleaned


_FIELDS = [
    ("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()),
    ("n_dup_lines", LongType()), ("n_repeat_words", LongType()), ("base_failed", BooleanType()),
    ("kept", BooleanType()), ("n_lines", LongType()), ("n_failed_lines", LongType()),
    ("lost_chars", LongType()), ("cleaned", StringType()),
]


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_lost: float = MAX_LOST,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: counts, verdict and (``with_text``) the cleaned text."""
    fields = _FIELDS if with_text else _FIELDS[:-1]

    def work(ids: list, texts: list) -> tuple:
        found = [judge(t, min_words, max_lost)[: len(fields)] for t in texts]
        return ids, *zip(*found, strict=True)

    schema = StructType([docs.schema[id_col], *(StructField(*f) for f in fields)])
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)


def cleaned(
    docs: DataFrame,
    text_col: str = "text",
    chars_col: str | None = None,
    min_words: int = MIN_WORDS,
    max_lost: float = MAX_LOST,
) -> DataFrame:
    """The kept documents with failing lines removed; all other columns as they were."""

    def rule(text: str | None) -> dict:
        found = judge(text, min_words, max_lost)
        return {"kept": found[6], "text": found[-1] if found[6] else None}

    verdict = StructType([StructField("kept", BooleanType()), StructField("text", StringType())])
    out = "__judged"
    while out in docs.columns:
        out += "_"
    judged = short_batches(docs).withColumn(out, over_texts(rule, verdict)(F.col(text_col)))
    kept = judged.filter(F.col(out)["kept"])
    kept = kept.withColumn(text_col, F.col(out)["text"])
    if chars_col:
        kind = docs.schema[chars_col].dataType
        kept = kept.withColumn(chars_col, F.length(text_col).cast(kind))
    return kept.drop(out)
