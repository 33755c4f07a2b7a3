"""Crawled HTML as columns, and CSS selectors over them.

One small Python step flattens a page: its elements in document order and its text
pieces. An element knows the position of its last descendant, so a subtree is a slice, and
the numbers of the selectors that match it. Everything after that (precedence, text,
cleaning) is expressions over the two arrays and needs neither Python nor a shuffle.

The step reads a page once, from left to right, whatever the page holds: each construct
ends where its terminator is first found, an unfinished one at the end of the page is text, and
all selectors are one automaton over the stack of open elements.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType,
)

from shelfscope.functions import selectors as known
from shelfscope.functions.bind import let
from shelfscope.functions.text import clean_text, trim_space

ELEMENT = StructType(
    [
        StructField("pos", IntegerType()),
        StructField("last", IntegerType()),
        StructField("tag", StringType()),
        StructField("first_child", BooleanType()),
        StructField("attrs", MapType(StringType(), StringType())),
        StructField("text_at", IntegerType()),
        StructField("text_n", IntegerType()),
        StructField("script", StringType()),
        StructField("marks", ArrayType(IntegerType())),
    ]
)
DOM = StructType(
    [
        StructField("elements", ArrayType(ELEMENT)),
        StructField("texts", ArrayType(StringType())),
    ]
)
_ARROW_ELEMENT = pa.struct(
    [
        ("pos", pa.int32()), ("last", pa.int32()), ("tag", pa.string()),
        ("first_child", pa.bool_()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_at", pa.int32()), ("text_n", pa.int32()), ("script", pa.string()),
        ("marks", pa.list_(pa.int32())),
    ]
)
_ARROW_DOM = pa.struct(
    [("elements", pa.list_(_ARROW_ELEMENT)), ("texts", pa.list_(pa.string()))]
)

# fixed values: elements without content, and elements whose text is not page text
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
OPAQUE = frozenset(("script", "style", "template"))
VERBATIM = frozenset(("pre", "textarea"))
_BLANK = " \n\t\f\r"
#: pages of a batch that are Python objects at once: these take many times their Arrow size
_PAGES = 32


_NAME = r"[^\t\n\r\f />]"
#: a tag ends at the first ``>`` that is in no quoted value; possessive, so read once
_TAG = re.compile(
    rf"<([a-zA-Z]{_NAME}*)((?:[^>=]|=[\t\n\r\f ]*(?:\"[^\"]*\"|'[^']*')?)*+)>"
)
_ATTRIBUTE = re.compile(
    r"""([^\t\n\r\f /=][^\t\n\r\f /=]*)(?:[\t\n\r\f ]*=[\t\n\r\f ]*("[^"]*"|'[^']*'|[^\t\n\r\f ]*))?"""
)
_END_TAG = re.compile(rf"</([a-zA-Z]{_NAME}*)[^>]*>")
#: elements whose content is no markup
_CLOSED = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.IGNORECASE) for t in ("script", "style")}


# --- selectors ---------------------------------------------------------------------

_TOKEN = re.compile(
    r"(?P<tag>[a-z][a-z0-9]*)"
    r"|\.(?P<cls>[\w-]+)"
    r"|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)'(?P<val>[^']*)')?\]"
    r"|:not\((?P<no>[^)]*)\)"
    r"|:(?P<first>first-child)"
)


def _compound(simple: str) -> tuple[list, set[str]]:
    """The tests of a selector without blanks, and the attributes that they read."""
    tests, attrs, at = [], set(), 0
    while at < len(simple):
        t = _TOKEN.match(simple, at)
        if t is None:
            raise ValueError(f"unsupported selector {simple!r}")
        at = t.end()
        kind = t.lastgroup if t.lastgroup != "val" else "op"
        if t["no"]:
            inner, more = _compound(t["no"])
            tests.append(("no", inner, None))
            attrs |= more
        elif t["attr"]:
            tests.append(("attr" if t["op"] is None else t["op"], t["attr"], t["val"]))
            attrs.add(t["attr"])
        else:
            tests.append((kind, t[kind], None))
            attrs |= {"cls": {"class"}, "id": {"id"}}.get(kind, set())
    return tests, attrs


def _holds(tests: list, tag: str, attrs: dict[str, str], first: bool) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            ok = tag == name
        elif kind == "cls":
            ok = name in re.split("[\t\n\r\f ]", attrs.get("class", ""))
        elif kind == "id":
            ok = attrs.get("id") == name
        elif kind == "first":
            ok = first
        elif kind == "no":
            ok = not _holds(name, tag, attrs, first)
        elif kind == "attr":
            ok = name in attrs
        elif kind == "=":
            ok = attrs.get(name) == value
        else:
            ok = value in attrs.get(name, "") and name in attrs
        if not ok:
            return False
    return True


def number_of(selector: str) -> int:
    """A selector's number in ``marks``."""
    return zlib.crc32(selector.encode()) >> 1


class Matcher:
    """All selectors as one automaton.

    A selector is a chain of compounds. The state of an element is the set (bits) of chain
    beginnings that it and its ancestors satisfy; it follows from the parent's state and the
    compounds that the element fits, and an element that ends a chain is marked.
    """

    def __init__(self, selectors: Sequence[str]) -> None:
        compounds: dict[str, int] = {}
        self.uses: list[list[tuple[int, int, int | None]]] = []  # needed bit, given bit, mark
        self.tests: list[list] = []
        attrs: set[str] = set()
        bit = 1
        for selector in selectors:
            chain = selector.split()
            needed = 0
            for k, simple in enumerate(chain):
                if simple not in compounds:
                    compounds[simple] = len(compounds)
                    tests, more = _compound(simple)
                    self.tests.append(tests)
                    self.uses.append([])
                    attrs |= more
                last = k == len(chain) - 1
                self.uses[compounds[simple]].append((needed, 0 if last else bit, number_of(selector) if last else None))
                needed, bit = bit, bit << 1
        self.attrs = sorted(attrs)
        self.fits: dict[tuple, list[int]] = {}

    def match(self, tag: str, attrs: dict[str, str], first: bool, state: int) -> tuple[list[int], int]:
        """The marks of an element below ``state``, and the state for what is inside it."""
        key = (tag, first, *(attrs.get(a) for a in self.attrs))
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > 10_000:
                self.fits.clear()
            fits = [k for k, tests in enumerate(self.tests) if _holds(tests, tag, attrs, first)]
            self.fits[key] = fits
        marks, inside = [], state
        for k in fits:
            for needed, given, mark in self.uses[k]:
                if needed & state == needed:
                    inside |= given
                    if mark is not None:
                        marks.append(mark)
        return marks, inside


class _Flattener:
    """The elements and text pieces of a page."""

    def __init__(self, matcher: Matcher) -> None:
        self.matcher = matcher
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self.open: list[tuple[dict, int]] = []  # with the state inside
        self.named: Counter[str] = Counter()  # open elements per tag
        self.verbatim_open = 0
        self.parents: set[int] = set()
        self.piece: list[str] = []  # the text piece being read

    def _flush(self) -> None:
        """End the text piece: white space alone becomes one line break or one blank, unless
        it counts."""
        if not self.piece:
            return
        piece = entities.unescape("".join(self.piece))
        self.piece = []
        if not piece.strip(_BLANK) and not self.verbatim_open:
            piece = "\n" if "\n" in piece else " "
        self.texts.append(piece)

    def _start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        parent, state = (self.open[-1][0]["pos"], self.open[-1][1]) if self.open else (0, 0)
        first = parent not in self.parents
        marks, inside = self.matcher.match(tag, attrs, first, state)
        element = {
            "pos": len(self.elements) + 1,
            "last": len(self.elements) + 1,
            "tag": tag,
            "first_child": first,
            "attrs": list(attrs.items()),
            "text_at": len(self.texts),
            "text_n": 0,
            "script": None,
            "marks": marks,
        }
        self.parents.add(parent)
        self.elements.append(element)
        if tag not in VOID:
            self.open.append((element, inside))
            self.named[tag] += 1
            self.verbatim_open += tag in VERBATIM
            if closed:
                self._close(tag)

    def _close(self, tag: str) -> None:
        if self.named[tag]:
            while self._end() != tag:
                pass

    def _end(self) -> str:
        element, _ = self.open.pop()
        element["last"] = len(self.elements)
        element["text_n"] = len(self.texts) - element["text_at"]
        self.named[element["tag"]] -= 1
        self.verbatim_open -= element["tag"] in VERBATIM
        return element["tag"]

    def _data(self, text: str) -> None:
        if not text:
            return
        inner = self.open[-1][0] if self.open else None
        if inner is not None and inner["tag"] in OPAQUE:
            inner["script"] = (inner["script"] or "") + text
        else:
            self.piece.append(text)

    def page(self, html: str) -> dict:
        at, end = 0, len(html)
        while at < end:
            i = html.find("<", at)
            if i < 0:
                break
            self._data(html[at:i])
            at = self._markup(html, i)
        self._data(html[at:])
        self._flush()
        while self.open:
            self._end()
        return {"elements": self.elements, "texts": self.texts}

    def _markup(self, html: str, i: int) -> int:
        """Read what begins with the ``<`` at ``i``; where reading goes on."""
        if html.startswith("</", i):
            m = _END_TAG.match(html, i)
            if m:
                self._flush()
                self._close(m[1].lower())
                return m.end()
            return self._skipped(html, i, ">")
        if html.startswith("<!--", i):
            return self._skipped(html, i + 2, "-->") if not html.startswith("<!-->", i) else self._skipped(html, i, ">")
        if html.startswith(("<!", "<?"), i):
            return self._skipped(html, i, "]]>" if html.startswith("<![", i) else ">")
        if not re.match("[a-zA-Z]", html[i + 1 : i + 2]):
            self._data("<")
            return i + 1
        m = _TAG.match(html, i)
        if not m:  # there is no end of a tag any more
            self._data(html[i:])
            return len(html)
        self._flush()
        tag, rest = m[1].lower(), m[2]
        attrs = {}
        for a in _ATTRIBUTE.finditer(rest):
            value = a[2] or ""
            if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
                value = value[1:-1]
            attrs[a[1].lower()] = entities.unescape(value)  # the last of a repeated one
        closed = rest.endswith("/")
        self._start(tag, attrs, closed)
        if tag not in _CLOSED or closed:
            return m.end()
        found = _CLOSED[tag].search(html, m.end())
        stop = found.start() if found else len(html)
        if stop > m.end():
            self.open[-1][0]["script"] = html[m.end() : stop]
        return stop

    def _skipped(self, html: str, i: int, end: str) -> int:
        """Leave out a comment or declaration; one without an end is text."""
        stop = html.find(end, i)
        if stop < 0:
            self._data(html[i:] if end == ">" else html[i - 2 :] if end == "-->" else html[i:])
            return len(html)
        self._flush()
        return stop + len(end)


@lru_cache(maxsize=8)
def _matcher(selectors: tuple[str, ...]) -> Matcher:
    return Matcher(selectors)


def _doms(pages: pa.Array, matcher: Matcher) -> pa.Array:
    """The pages of a batch as ``DOM``, some of them as Python objects at a time."""

    def some(at: int) -> pa.Array:
        texts = pages.slice(at, _PAGES).to_pylist()
        return pa.array([None if p is None else _Flattener(matcher).page(p) for p in texts], type=_ARROW_DOM)

    parts = [some(at) for at in range(0, len(pages), _PAGES)] or [some(0)]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]


_registered = set(known.ALL)


def flatten(html: Column, selectors: Sequence[str] = ()) -> Column:
    """``struct<elements, texts>`` of a page; ``selectors`` may be selected besides
    those of ``functions.selectors``."""
    every = (*known.ALL, *selectors)
    _matcher(every)  # a selector that is none fails here
    _registered.update(every)

    @F.arrow_udf(DOM)
    def flat(pages: pa.Array) -> pa.Array:
        return _doms(pages, _matcher(every))

    return flat(html)


def select_all(elements: Column, selector: str) -> Column:
    """All elements a selector matches, in document order (array, maybe empty)."""
    if selector not in _registered:
        raise ValueError(f"pages were not flattened for selector {selector!r}")
    return F.filter(elements, lambda e: F.array_contains(e["marks"], number_of(selector)))


def select_first(elements: Column, selectors) -> Column:
    """The first element of the first selector that matches anything."""
    return F.coalesce(*[F.get(select_all(elements, s), 0) for s in selectors])


def select_any(elements: Column, selectors) -> Column:
    """All elements of the first selector that matches anything, else NULL."""
    found = [select_all(elements, s) for s in selectors]
    return F.coalesce(*[F.when(F.size(f) > 0, f) for f in found])


def _pieces(texts: Column, e: Column, base: Column | int = 0) -> Column:
    return F.slice(texts, e["text_at"] - base + 1, e["text_n"])


def stripped_text(texts: Column, element: Column, base: Column | int = 0) -> Column:
    """The element's text pieces, each trimmed, joined without a separator."""

    def join(e: Column) -> Column:
        return F.array_join(F.transform(_pieces(texts, e, base), trim_space), "")

    return let(element, lambda e: F.when(e.isNotNull(), join(e)))


def raw_text(texts: Column, element: Column, base: Column | int = 0) -> Column:
    return let(element, lambda e: F.when(e.isNotNull(), F.array_join(_pieces(texts, e, base), "")))


def field_text(elements: Column, texts: Column, selectors, base: Column | int = 0) -> Column:
    """Raw text of the first matching element; NULL when nothing matches or it is empty."""
    return F.nullif(stripped_text(texts, select_first(elements, selectors), base), F.lit(""))


def clean_field(raw: Column) -> Column:
    """Cleaned text of a field, NULL when the field is missing."""
    return F.when(raw.isNotNull(), clean_text(raw))
