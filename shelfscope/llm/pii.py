"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-signs, digits, schemes and identifier
cues. At each anchor a small deterministic parser expands to both sides and validates.

Kinds, in this order in ``spans``: ``email``, ``ip``, ``card`` (16 to 19 digits, Luhn) and
``phone``, with the boundaries that the patterns in ``tests/llm`` state; then ``login`` (user
and password in a URL), ``iban`` (modulo 97), ``ssn`` and ``account`` (8 to 17 digits after a
cue). An ``iban``, ``ssn`` or ``account`` that overlaps a span of the first four is dropped.
Positions count code points, the end is exclusive. Each kind is matched from left to right without overlap; a
match that fails its check is dropped and not tried again from within.

Null and empty texts have no span; repeated rows each get their row; an empty table gives an
empty result; other columns are ignored. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import ahocorasick
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfscope.llm.common import arrow_map

BASE = ("email", "ip", "card", "phone")
ACCOUNTS = ("iban", "ssn", "account")
KINDS = (*BASE, "login", *ACCOUNTS)
CUES = {
    "iban": ("IBAN", "Iban", "iban"),
    "ssn": ("SSN", "ssn", "Social Security", "social security"),
    "account": ("Account", "account", "ACCOUNT", "acct", "Acct", "Konto", "konto"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\x00-\x20\"'<>/@:]+:[^\x00-\x20\"'<>/@]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\x20:#.=-]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Z0-9])")
_SSN = re.compile(r"[^0-9\n]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"(?:\x20?(?:no\.?|nr\.?|number|id))?[\x20:#.=-]{1,4}([0-9]{8,17})(?![0-9])")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("login", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def valid_ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def _octets(text: str, at: int, found: list) -> int:
    """Adds the addresses in the run of dotted numbers at ``at``; gives the run's end."""
    run = _GROUPS.match(text, at)
    if "." not in run.group():
        return run.end()
    groups = run.group().split(".")
    start = at
    for i in range(0, len(groups) - 3, 4):
        four = groups[i : i + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in four):
            found.append((start, end))
        start = end + 1
    return run.end()


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text by kind, each list in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    done = dict.fromkeys((*KINDS, "digit"), 0)
    for last, (kind, size) in _ANCHORS[0].iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= done["ip"]:
                done["ip"] = _octets(text, at, out["ip"])
            if at >= done["card"]:
                m = _CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 16:
                    digits = re.sub("[ -]", "", m.group())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(m.span())
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m and 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out["phone"].append(m.span())
        elif kind == "login":
            start = at
            while start > done["login"] and text[start - 1] in _LETTERS:
                start -= 1
            m = _LOGIN.match(text, last + 1) if start < at else None
            if m:
                out["login"].append((start, m.end()))
                done["login"] = m.end()
        else:
            pattern, check = {
                "iban": (_IBAN, valid_iban), "ssn": (_SSN, valid_ssn), "account": (_ACCOUNT, bool)
            }[kind]
            m = pattern.match(text, last + 1)
            if m and m.start(1) >= done[kind] and check(m.group(1)):
                out[kind].append(m.span(1))
                done[kind] = m.end(1)
    base = sorted(s for k in BASE for s in out[k])
    if base:
        reach, most = [], 0
        for _, end in base:
            most = max(most, end)
            reach.append(most)
        starts = [s for s, _ in base]
        for kind in ACCOUNTS:
            # the spans that begin before this one ends must all end before it begins
            out[kind] = [
                (a, b) for a, b in out[kind]
                if not (i := bisect_right(starts, b - 1)) or reach[i - 1] <= a
            ]
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_spans, spans)`` per document."""

    def work(ids: list, texts: list) -> tuple:
        found = [find(t) for t in texts]
        counts = [[len(f[k]) for f in found] for k in BASE]
        return ids, *counts, [joined(f, BASE) for f in found], [joined(f, KINDS) for f in found]

    schema = StructType(
        [docs.schema[id_col], *(StructField(f"n_{k}", LongType()) for k in BASE),
         StructField("base_spans", StringType()), StructField("spans", StringType())]
    )
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
