"""Balanced JSON ranges in page source, by one linear scan with a stack.

Outside of brackets everything is passed over. Inside, quoted strings are stepped over, so
brackets in texts do not count; a quote that its line does not close is no string, nor are
the others like it in the rest of that line. A closing bracket drops what is still open
inside its opening one, and one without an opening one is passed over. ``<script`` and
``</script`` end whatever is open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_OPEN = re.compile(r"[{\[]")
_NEXT = re.compile(r"[{}\[\]\"']|</?script", re.IGNORECASE)
_STRING = {c: re.compile(rf"{c}(?:[^{c}\\\n]|\\.)*+{c}") for c in "\"'"}
_PARTNER = {"}": "{", "]": "["}


@dataclass
class Range:
    """``text[start:end]`` is balanced; ``inner`` are the ranges directly inside, ``height``
    is the number of levels."""

    start: int
    end: int = -1
    height: int = 1
    inner: list[Range] = field(default_factory=list)

    def own(self, text: str) -> str:
        """The text without that of the ranges inside."""
        parts, at = [], self.start
        for r in self.inner:
            parts.append(text[at : r.start])
            at = r.end
        return "".join([*parts, text[at : self.end]])


def balanced(text: str) -> list[Range]:
    """All balanced ranges, ordered by start."""
    found: list[Range] = []
    stack: list[Range] = []
    opened = {"{": 0, "[": 0}
    closed_until = {'"': -1, "'": -1}  # quotes of a kind are no strings up to here
    at = 0
    while True:
        m = (_NEXT if stack else _OPEN).search(text, at)
        if m is None:
            break
        i, c = m.start(), m.group()
        at = m.end()
        if c in "\"'":
            if i >= closed_until[c]:
                s = _STRING[c].match(text, i)
                if s:
                    at = s.end()
                else:
                    line = text.find("\n", i)
                    closed_until[c] = len(text) if line < 0 else line
        elif c in "{[":
            stack.append(Range(i))
            opened[c] += 1
        elif c in "}]":
            if not opened[_PARTNER[c]]:
                continue
            while True:
                r = stack.pop()
                opened[text[r.start]] -= 1
                if text[r.start] == _PARTNER[c]:
                    break
                if stack:  # never closed: what is inside belongs to the one around it
                    stack[-1].inner += r.inner
            r.end = at
            r.height = 1 + max((x.height for x in r.inner), default=0)
            found.append(r)
            if stack:
                stack[-1].inner.append(r)
        else:
            stack.clear()
            opened = {"{": 0, "[": 0}
    return sorted(found, key=lambda r: r.start)


def objects_with(text: str | None, words: tuple[str, ...]) -> list[str]:
    """The own texts of the objects that hold all of ``words`` outside of inner ranges."""
    if not text or any(w not in text for w in words):
        return []
    owns = (r.own(text) for r in balanced(text) if text[r.start] == "{")
    return [own for own in owns if all(w in own for w in words)]
