"""Packing into sequences by linear grouping and best fit.

A document is its token ids and a final id 0. One longer than ``capacity`` is cut into pieces
of ``capacity``, the first of which may be shorter. Lengths lie between 1 and ``capacity``, so
the driver sees the data only as a histogram of that many rows, whatever their number, and
plans on it:

1. Large lengths (over ``capacity / 8``) are sorted and put into groups of equal cardinality,
   each rounded up to its largest length.
2. Configurations of rounded sizes are built one after the other: the largest size left, and
   the fullest completion from the sizes left (a subset-sum over bit sets); each is used as
   often as its sizes last.
3. Actual lengths replace the rounded ones. Sequences of one content stay one run, and the
   space that rounding left is known exactly.
4. Small lengths, falling, go to the run with the least space that holds them, as often as they
   fit; new sequences are opened only if none does.

The plan is a list of intervals ``(length, ranks, first sequence, pieces per sequence,
offset)``. Each piece gets a rank among those of its length (counts per salted group, then a
window within the group, so a common length is no hot spot) and meets its interval in a join.

Null text counts as empty: one token, the id 0. Repeated rows each get their pieces; null ids
are kept; an empty table gives an empty result; other columns are ignored. A document is
tokenized whole. Texts of special tokens count as ordinary text.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from math import isqrt

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from shelfscope.llm.common import arrow_map, small_side
from shelfscope.session import durable

CAPACITY = 2048
GROUPS = 512
#: the least number of pieces in one window of the ranking; a length with n pieces has about
#: as many windows as rows in each, the root of n
WINDOW_ROWS = 1_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, by the faster of two libraries.

    Both give equal ids (tested); the second, with its default settings, takes the texts that
    the first cannot: blanks by the hundred thousand, and texts that hold the content of an
    added token, which becomes that token's id."""

    #: longest run of characters of one kind for the fast library
    RUN = 20_000

    def __init__(self, path: str) -> None:
        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.added = tuple(t["content"] for t in spec.get("added_tokens", ()))
        special = {t["content"] for t in spec.get("added_tokens", ()) if t.get("special")}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        long = len(text) > self.RUN and (
            max(map(len, text.split(" ")), default=0) > self.RUN or " " * self.RUN in text
        )
        if long or any(x in text for x in self.added):
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def pieces(
    docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = CAPACITY
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every document's pieces."""

    def work(ids: list, texts: list) -> tuple:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        out: tuple[list, ...] = ([], [], [], [], [])
        for own, text in zip(ids, texts, strict=True):
            tokens = array("I", _ENCODERS[path].ids(text) if text else ())
            tokens.append(0)
            n = -(-len(tokens) // capacity)
            start, end = 0, len(tokens) - (n - 1) * capacity
            for k in range(n):
                crc = zlib.crc32(tokens[start:end].tobytes())
                for column, value in zip(out, (own, k, start, end - start, crc), strict=True):
                    column.append(value)
                start, end = end, end + capacity
        return out

    schema = StructType(
        [docs.schema[id_col], StructField("piece", IntegerType()),
         *(StructField(n, LongType()) for n in ("start", "length", "ids_crc32"))]
    )
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema, rows=128)


Interval = tuple[int, int, int, int, int, int]


class _Plan:
    """Intervals under construction; runs are sequences ``[lo, hi)`` of equal space."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.intervals: list[Interval] = []
        self.used: dict[int, int] = defaultdict(int)
        self.next = 0
        self.spaces: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, length: int, count: int, first: int, per: int, offset: int) -> None:
        rank = self.used[length]
        self.used[length] = rank + count
        self.intervals.append((length, rank, rank + count, first, per, offset))

    def free(self, lo: int, hi: int, space: int) -> None:
        if lo >= hi or space <= 0:
            return
        if space not in self.runs:
            insort(self.spaces, space)
            self.runs[space] = []
        self.runs[space].append((lo, hi))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The run with the least space of at least ``least``."""
        i = bisect_left(self.spaces, least)
        if i == len(self.spaces):
            return None
        space = self.spaces[i]
        lo, hi = self.runs[space].pop()
        if not self.runs[space]:
            del self.runs[space], self.spaces[i]
        return lo, hi, space


def _grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """``(length, count)`` in falling order, cut into groups of equal cardinality."""
    total = sum(c for _, c in lengths)
    size = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = size
    for length, count in lengths:
        while count:
            if not room:
                out.append([])
                room = size
            n = min(count, room)
            out[-1].append([length, n])
            count -= n
            room -= n
    return [g for g in out if g]


def _fullest(sizes: list[int], left: list[int], space: int) -> dict[int, int]:
    """Copies of each size (falling) that fill ``space`` best, large sizes first."""
    mask = (1 << (space + 1)) - 1
    below: list[tuple[int, int, int]] = []  # (group, copies possible, sums reachable with it)
    reach = 1
    full = 1 << space
    for g in range(len(sizes) - 1, -1, -1):  # small sizes first, so large ones decide last
        n = min(left[g], space // sizes[g])
        if not n:
            continue
        before = reach
        for _ in range(n):
            reach |= (reach << sizes[g]) & mask
        if reach != before:
            below.append((g, n, before))
        if reach & full:
            break
    target = reach.bit_length() - 1
    out: dict[int, int] = {}
    for g, n, before in reversed(below):
        for k in range(n + 1):
            rest = target - k * sizes[g]
            if rest >= 0 and before >> rest & 1:
                if k:
                    out[g] = k
                target = rest
                break
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Interval]:
    """Intervals ``(length, rank from, rank to, first sequence, per sequence, offset)``: the
    piece of rank r lies in sequence ``first + (r - from) // per`` at ``offset + (r - from) %
    per * length``."""
    p = _Plan(capacity)
    if n := counts.get(capacity, 0):
        p.put(capacity, n, 0, 1, 0)
        p.next = n
    limit = capacity // 8
    large = sorted(((x, c) for x, c in counts.items() if limit < x < capacity and c), reverse=True)
    grouped = _grouped(large, groups)
    sizes = [g[0][0] for g in grouped]
    left = [sum(c for _, c in g) for g in grouped]
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        left[first] -= 1
        use = _fullest(sizes[first:], left[first:], capacity - sizes[first])
        left[first] += 1
        use = {g + first: k for g, k in use.items()}
        use[first] = use.get(first, 0) + 1
        times = min(left[g] // k for g, k in use.items())
        for g, k in use.items():
            left[g] -= k * times
        _substitute(p, grouped, sorted(use.items()), times)
    for length in range(limit, 0, -1):
        count = counts.get(length, 0)
        while count:
            run = p.take(length)
            if run is None:
                n = -(-count // (capacity // length))
                run = (p.next, p.next + n, capacity)
                p.next += n
            lo, hi, space = run
            per = space // length
            whole = min(hi - lo, count // per)
            if whole:
                p.put(length, whole * per, lo, per, capacity - space)
                p.free(lo, lo + whole, space - per * length)
                count -= whole * per
                lo += whole
            if 0 < count < per and lo < hi:
                p.put(length, count, lo, count, capacity - space)
                p.free(lo, lo + 1, space - count * length)
                count = 0
                lo += 1
            p.free(lo, hi, space)
    return p.intervals


def _substitute(p: _Plan, grouped: list[list[list[int]]], use: list[tuple[int, int]], times: int) -> None:
    """Actual lengths for ``times`` sequences of one configuration, as runs of equal content."""
    slots: list[list[list[int]]] = []  # per slot: [length, count] in order, ``times`` in all
    for g, copies in use:
        for _ in range(copies):
            own, room = [], times
            while room:
                head = grouped[g][0]
                n = min(head[1], room)
                own.append([head[0], n])
                head[1] -= n
                room -= n
                if not head[1]:
                    grouped[g].pop(0)
            slots.append(own)
    at = p.next
    p.next += times
    while slots[0]:
        n = min(s[0][1] for s in slots)
        offset = 0
        for s in slots:
            p.put(s[0][0], n, at, 1, offset)
            offset += s[0][0]
            s[0][1] -= n
            if not s[0][1]:
                s.pop(0)
        p.free(at, at + n, p.capacity - offset)
        at += n


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: tuple[str, ...]) -> DataFrame:
    """Rows of longs as a DataFrame, by way of Arrow: for a list of tuples Spark starts a second
    set of Python workers on the executors and keeps it for a minute."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})
    return spark.createDataFrame(table)


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    groups: int = GROUPS,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, id_col, text_col, path or default_path(), capacity))
    # at most ``capacity`` rows
    counts = dict(cut.groupBy("length").count().collect())
    rows = plan(counts, capacity, groups)
    intervals = durable(_table(spark, rows, ("length", "lo", "hi", "first", "per", "at")))
    # at most ``capacity`` rows as well
    salts = [(length, -(-n // max(WINDOW_ROWS, isqrt(n)))) for length, n in counts.items()]
    salted = cut.join(F.broadcast(_table(spark, salts, ("length", "salts"))), "length")
    salted = salted.withColumn(
        "salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("salts")).cast("int")
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order)).join(base, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own") - 1)
    met = ranked.join(small_side(intervals), "length").filter("rank >= lo and rank < hi")
    step = F.col("rank") - F.col("lo")
    return met.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("length")).alias("offset"),
    )
