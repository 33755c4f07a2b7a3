"""Language identification by rank-order n-gram profiles.

Every language is described by its most frequent letter n-grams (one to three letters,
words padded with a blank) in rank order. A document's own ranking is compared with each
profile: an n-gram costs the difference of its two ranks, or the profile's length if the
profile lacks it; the language with the least sum wins.

Counting runs inside the tasks over all training texts and is summed by Spark; what
reaches the driver is ``size`` rows per language, for as many languages as there are different
values of ``lang`` in training (a column of language codes: some hundreds at most). Results
for special inputs:

* text null, empty or without letters (combining marks alone are none): ``und``, score 0
* no training row, or none with letters: ``und`` for every document
* equal sums: the language first in code-point order; equal counts: the n-gram with the
  smaller key
* null ``lang`` in training: the row is not used; an empty ``lang`` is a value like others
* repeated rows: each counts in training and each gets its row; other columns are ignored
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shelfscope.llm.common import arrow_map

SIZE = 400
#: n-grams held by a counting task before it hands them on
_HELD = 1_000_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: is it a letter or a mark on one?"""
    if not _LETTERS:
        _LETTERS.append(
            np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
        )
    return _LETTERS[0]


def slices(text: str, size: int = 1 << 18) -> Iterator[str]:
    """``text`` in parts of bounded size, cut at blanks where there are any."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        cut = at + size if cut < 0 else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def gram_keys(text: str) -> np.ndarray:
    """The n-grams of a text as 64-bit keys, one per occurrence."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(_letters()[codes], codes, 0).astype(np.int64)
    s = np.concatenate([[0], kept, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one blank between words
    if len(s) < 3:
        return np.empty(0, np.int64)
    one = s[s != 0]
    two = (s[:-1] << 21) | s[1:] | np.int64(-(1 << 63))
    three = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] != 0]
    return np.concatenate([one, two, three])


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(gram_keys(p), return_counts=True) for p in slices(text)]
    return parts[0] if len(parts) == 1 else _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def profiles(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE
) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, in rank order."""
    schema = "lang string, gram long, n long"
    target = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def emit(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], schema=target
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size_of: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch[0], batch[1], strict=True):
                lang = lang.as_py()
                parts = held.setdefault(lang, [])
                for part in slices(text.as_py()):
                    parts.append(np.unique(gram_keys(part), return_counts=True))
                    size_of[lang] = size_of.get(lang, 0) + len(parts[-1][0])
                    if size_of[lang] > _HELD:
                        parts[:] = [_merged(parts)]
                        size_of[lang] = len(parts[0][0])
                        if size_of[lang] > _HELD // 2:
                            yield emit(lang, *parts.pop())
                            size_of[lang] = 0
        for lang, parts in held.items():
            if parts:
                yield emit(lang, *_merged(parts))

    lang, text = F.col(lang_col), F.col(text_col)
    usable = docs.select(lang.alias("lang"), text.alias("text")).filter(
        "lang is not null and text is not null"
    )
    totals = usable.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    out: dict[str, list] = {}
    for row in top.select("lang", "rank", "gram").collect():
        out.setdefault(row.lang, []).append((row.rank, row.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(out.items())}


class Distances:
    """Out-of-place sums of a document's ranking to every profile at once."""

    def __init__(self, learned: dict[str, np.ndarray], size: int) -> None:
        self.names, self.size = list(learned), size
        grams = [g for g in learned.values()] or [np.empty(0, np.int64)]
        self.keys = np.unique(np.concatenate(grams))
        self.rank = np.full((len(learned), len(self.keys)), -1, np.int64)
        for i, g in enumerate(learned.values()):
            self.rank[i, np.searchsorted(self.keys, g)] = np.arange(len(g))

    def best(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not len(self.keys):
            return "und", 0.0
        keys, counts = _counted(text)
        if not len(keys) or not any(unicodedata.category(c)[0] == "L" for c in text):
            return "und", 0.0
        own = keys[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        there = self.rank[:, at]
        known = (self.keys[at] == own) & (there >= 0)
        cost = np.where(known, np.abs(there - np.arange(len(own))), self.size).sum(axis=1)
        i = int(np.argmin(cost))
        return self.names[i], float(1.0 - cost[i] / (self.size * len(own)))


def identify(
    docs: DataFrame,
    learned: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
) -> DataFrame:
    """``(id, lang_pred, score)`` for every row; score is 1 less the mean cost per n-gram."""
    model = Distances(learned, size)

    def work(ids: list, texts: list) -> tuple:
        found = [model.best(t) for t in texts]
        return ids, [x for x, _ in found], [s for _, s in found]

    schema = StructType(
        [docs.schema[id_col], StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    )
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)


def held_out(id_col: str, part: int, of: int) -> Column:
    """Is the row kept from training: crc32 of its id as text, modulo ``of``, is ``part``?"""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == part, F.lit(False))
