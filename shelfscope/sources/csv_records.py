"""CSV records with quoted line breaks, read from splittable files.

A line break ends a record if the quotes before it in the file pair up. Whether they do at
the start of a file range is known from the ranges before it:

1. Ranges are counted: one row per range (file, start, quotes, first and last line with an odd
   number of quotes), from one splittable read. A running sum per file says which ranges begin
   inside quotes. Such a range ends a record by its first odd line; one that ends inside quotes
   begins a record by its last odd line.
2. Every task goes through its ranges again, each from its right state, and hands on whole
   records.
3. The lines of records that go over a range's end are read once more, if there are any, and
   put together per record.

So the read is narrow, what is shuffled are a row per range and the lines at ranges' ends, and
no record is stored. A quote counts wherever it stands: a field that has one must be quoted and
double it.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfscope.session import durable

_RANGES = 1_000_000  # rows of the list of ranges that may be broadcast
_LINES = 1 << 13  # lines that are put together at once


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, line, at)``: physical lines, the range that each begins in, and a number
    that grows inside a range and is the same in every read."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"),
    )


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """A row per range: ``file``, ``start``; ``open``, does it begin inside quotes; ``first``, is it
    the first of its file that has a line; ``ends``, the line that ends a record begun earlier
    if it is open; ``begins``, the line that begins a record which it does not finish, or NULL;
    ``nr``, how many such records its file begins before it."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = F.when(quotes % 2 == 1, F.col("at"))
    counted = _lines(spark, path).groupBy("file", "start").agg(
        F.sum(quotes).alias("n"), F.min(odd).alias("ends"), F.max(odd).alias("last")
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("n").over(earlier)
    known = counted.select(
        "file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("open"), before.isNull().alias("first"),
        "ends", F.when((F.coalesce(before, F.lit(0)) + F.col("n")) % 2 == 1, F.col("last")).alias("begins"),
    )
    return known.withColumn("nr", F.coalesce(F.count("begins").over(earlier), F.lit(0)))


def _beside(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, bool]:
    """Lines with the row of their range, and whether they were shuffled for it."""
    short = known.count() <= _RANGES
    return lines.join(F.broadcast(known) if short else known, ["file", "start"]), not short


def _over_ends(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``(record, unfinished)`` for the records that go over the end of a range."""
    rows, _ = _beside(lines, known.filter("open or begins is not null"))
    head = F.col("open") & (F.col("ends").isNull() | (F.col("at") <= F.col("ends")))
    tail = F.coalesce(F.col("at") >= F.col("begins"), F.lit(False))
    end = F.coalesce(F.col("open") & (F.col("at") == F.col("ends")), F.lit(False))
    place = F.struct("start", "at", "line", end.alias("end"))
    pieces = rows.filter(head | tail).select("file", (F.col("nr") + tail.cast("int")).alias("nr"), place.alias("place"))
    return pieces.groupBy("file", "nr").agg(F.sort_array(F.collect_list("place")).alias("p")).select(
        F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record"),
        (~F.element_at("p", -1)["end"]).alias("unfinished"),
    )


class Assembler:
    """The records of one range, line by line.

    Yields ``(kind, text)``: ``record``; ``head``, what ends a record begun earlier;
    ``inside``, a range without any end; ``tail``, what is unfinished at the end.
    """

    def __init__(self, is_open: bool) -> None:
        self.open = is_open
        self.began_open = is_open
        self.held: list[str] = []

    def add(self, line: str) -> Iterator[tuple[str, str]]:
        self.held.append(line)
        if line.count('"') % 2:
            self.open = not self.open
        if not self.open:
            kind, text = ("head" if self.began_open else "record"), "\n".join(self.held)
            self.held, self.began_open = [], False
            yield kind, text

    def end(self) -> Iterator[tuple[str, str]]:
        if self.held:
            yield ("inside" if self.began_open else "tail"), "\n".join(self.held)
            self.held = []


class Lines:
    """``Assembler`` for arrays of lines: ``(kinds, texts)`` of what they end."""

    def __init__(self, is_open: bool) -> None:
        self.open = is_open
        self.began_open = is_open
        self.held: list[pa.Array] = []

    def add(self, lines: pa.Array) -> tuple[list[str], pa.Array]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        opened = (np.cumsum(quotes) + self.open) % 2 == 1
        self.open = bool(opened[-1])
        ends = np.nonzero(~opened)[0] + 1
        if not len(ends):
            self.held.append(lines)
            return [], pa.array([], pa.string())
        before = sum(map(len, self.held))
        every = pa.concat_arrays([*self.held, lines])
        self.held = [every.slice(before + ends[-1])] if ends[-1] < len(lines) else []
        offsets = pa.array(np.concatenate([[0], before + ends]), pa.int32())
        kinds = ["head" if self.began_open else "record"] + ["record"] * (len(ends) - 1)
        self.began_open = False
        return kinds, pc.binary_join(pa.ListArray.from_arrays(offsets, every), "\n")

    def end(self) -> tuple[list[str], pa.Array]:
        if not self.held:
            return [], pa.array([], pa.string())
        every = pa.concat_arrays(self.held)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), "\n")
        self.held = []
        return ["inside" if self.began_open else "tail"], text


def _runs(files: pa.Array, starts: pa.Array) -> list[tuple[int, int]]:
    """The rows ``(from, to)`` of each range in a batch."""
    n = len(starts)
    if n < 2:
        return [(0, n)] if n else []
    other = pc.or_(
        pc.not_equal(starts.slice(1), starts.slice(0, n - 1)), pc.not_equal(files.slice(1), files.slice(0, n - 1))
    )
    cuts = [0, *(np.nonzero(other.to_numpy(zero_copy_only=False))[0] + 1).tolist(), n]
    return list(zip(cuts, cuts[1:]))


def _filled(texts: pa.Array) -> list[bool]:
    """Which texts are not blank."""
    sure = pc.match_substring_regex(texts, "[!-~]").to_pylist()
    return [x or bool(texts[i].as_py().strip()) for i, x in enumerate(sure)]


def _header_of(text: str) -> list[str]:
    return next(csv.reader([text.removesuffix("\r").removeprefix("﻿")]), [])


def records(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """``(record, unfinished)`` for every record but the headers; ``unfinished`` ones lack a
    closing quote at the end of their file. Blank records are left out. A file with another
    header than ``header`` fails the read."""
    known = durable(ranges(spark, path))
    lines = _lines(spark, path)
    joined, shuffled = _beside(lines, known)
    if shuffled:
        # shuffled: the lines of a range, which a file split bounds, in order again
        joined = joined.repartition("file", "start").sortWithinPartitions("file", "start", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, work, top = None, None, False

        def rows(found: tuple[list[str], pa.Array]) -> Iterator[pa.RecordBatch]:
            nonlocal top
            types, texts = found
            if top and types:
                top = False
                if _header_of(texts[0].as_py()) != header:
                    raise ValueError(f"{key[0]} has another header than the first file")
                types, texts = types[1:], texts.slice(1)
            keep = [k == "record" and full for k, full in zip(types, _filled(texts))]
            if any(keep):
                yield pa.RecordBatch.from_arrays([texts.filter(pa.array(keep, pa.bool_()))], ["record"])

        for whole in batches:
            for at in range(0, whole.num_rows, _LINES):
                batch = whole.slice(at, _LINES)
                for a, b in _runs(batch.column(0), batch.column(1)):
                    file, start, _, is_open, first = (c[a].as_py() for c in batch.columns)
                    if (file, start) != key:
                        if work:
                            yield from rows(work.end())
                        key, work, top = (file, start), Lines(is_open), first
                    yield from rows(work.add(batch.column(2).slice(a, b - a)))
        if work:
            yield from rows(work.end())

    done = joined.select("file", "start", "line", "open", "first").mapInArrow(run, "record string")
    every = done.withColumn("unfinished", F.lit(False)).unionByName(_over_ends(lines, known))
    return every.select(F.regexp_replace("record", r"\r\z", "").alias("record"), "unfinished")
