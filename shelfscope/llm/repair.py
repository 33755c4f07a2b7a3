"""Conversation structure repair by a min-plus program over grammar-compressed sequences.

A conversation's rows, by turn, are turned into symbols: the class of the role's initial
(``s``, ``u``, ``a``, other) and the row's first fault (none, truncated, or one that
requires deletion: blank, or role and text seen earlier). Edits per row are Keep (0), Rerole
to user or assistant (2), Delete (3, the only one for blank and duplicate rows), and Insert
of an empty user or assistant row anywhere (2); truncated rows that stay add 1. The cheapest
edits that leave role initials ``(s?(ua)+)?`` are found, ties going to the least string of
edit initials.

The method:

* Sequences are cut into blocks of at most 1,024 rows; equal blocks of all conversations are
  one string. Re-Pair rules (the most frequent pairs of symbols, over all distinct blocks,
  become new symbols, round by round) compress the strings.
* The prefix written so far is in one of four states (empty, after s, after u, after a).
  Every rule has a 4 x 4 matrix of least costs, computed from those of its two sides. With
  each cost goes a rope: the state in the middle, from which the edits are read off on
  demand, and the rank of its edits among those from the same state. Two edit strings of
  one block that differ never are a prefix of each other (both end with a row's edit), so
  ranks alone decide ties.
* A conversation's blocks are chained from left to right with four costs and four ranks, and
  the states at its block borders read backwards. Blocks then find their edits on their own.

Rows are range-sorted, so a conversation of any length is spread over tasks; the chain streams
over one narrow row per block and keeps four bytes of it. The rules are at most
``MAX_RULES``; what they do not cover is evaluated symbol by symbol.

Special cases: a null role or text counts as empty (class other; blank); a null conversation
id is a conversation of its own; null turns come first; rows of equal turn are ordered by
role, then by the SHA-256 of the text; repeated rows are duplicates; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.session import durable, stored

BLOCK_BITS = 10
MAX_RULES = 128
#: a pair is worth a rule if it stands at this share of all symbols, and twice at least
LEAST_SHARE = 0.002
_SPACE = r"\x20\x09-\x0D"
#: symbols by class, for rows without fault, truncated rows and rows to delete
CLASSES = "suao"
PLAIN, CUT, GONE = "suao", "SUAO", "wxyz"
_FIRST_RULE = 0xE000  # private use area
FAR = 1 << 40
#: states: nothing written, after s, after u, after a
_INSERTED = (2, 2, 3, 2)
_ROLE = {1: "system", 2: "user", 3: "assistant"}
_TAIL = (0, 2, 1, 0)  # inserts that end a conversation, by state


class Matrix(NamedTuple):
    """From state (row) to state: least cost, state in the middle, rank of the edits."""

    cost: tuple
    mid: tuple
    rank: tuple


def _ranked(keys: list[list]) -> tuple:
    """Each row's ranks of its keys; None (not reachable) has rank 0."""
    out = []
    for row in keys:
        order = {k: i for i, k in enumerate(sorted(k for k in row if k is not None))}
        out.append(tuple(order.get(k, 0) for k in row))
    return tuple(out)


def base(symbol: str) -> tuple[Matrix, dict]:
    """Matrix of one row, inserts before it included, and its edits by (state, state)."""
    row = next((PLAIN, CUT, GONE)[i] for i in range(3) if symbol in (PLAIN, CUT, GONE)[i])
    kind, more = CLASSES[row.index(symbol)], int(row == CUT)
    edits: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(i: int, j: int, cost: int, text: str) -> None:
        edits[i, j] = min(edits.get((i, j), (FAR, "")), (cost, text))

    for i in range(4):
        at, inserts = i, ""
        for _ in range(3):
            paid = 2 * len(inserts)
            offer(i, at, paid + 3, inserts + "D")
            if row != GONE:
                if kind == "s" and at == 0:
                    offer(i, 1, paid + more, inserts + "K")
                if kind in "ua" and _ROLE[_INSERTED[at]][0] == kind:
                    offer(i, _INSERTED[at], paid + more, inserts + "K")
                offer(i, _INSERTED[at], paid + 2 + more, inserts + "R")
            at, inserts = _INSERTED[at], inserts + "I"
    cost = tuple(tuple(edits.get((i, j), (FAR, ""))[0] for j in range(4)) for i in range(4))
    keys = [[edits[i, j][1] if (i, j) in edits else None for j in range(4)] for i in range(4)]
    return Matrix(cost, ((0,) * 4,) * 4, _ranked(keys)), {k: v[1] for k, v in edits.items()}


def product(y: Matrix, z: Matrix) -> Matrix:
    cost, mid, keys = [], [], []
    for i in range(4):
        costs, mids, row = [], [], []
        for j in range(4):
            best, _, k = min((y.cost[i][k] + z.cost[k][j], y.rank[i][k], k) for k in range(4))
            reached = best < FAR
            costs.append(best if reached else FAR)
            mids.append(k)
            row.append((y.rank[i][k], z.rank[k][j]) if reached else None)
        cost.append(tuple(costs))
        mid.append(tuple(mids))
        keys.append(row)
    return Matrix(tuple(cost), tuple(mid), _ranked(keys))


@dataclass
class Grammar:
    """Rules as pairs of symbols, and a matrix per symbol, evaluated bottom-up."""

    rules: dict[str, tuple[str, str]] = field(default_factory=dict)
    matrices: dict[str, Matrix] = field(default_factory=dict)
    edits: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for s in PLAIN + CUT + GONE:
            self.matrices[s], self.edits[s] = base(s)

    def add(self, pair: str) -> str:
        name = chr(_FIRST_RULE + len(self.rules))
        self.rules[name] = (pair[0], pair[1])
        self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])
        return name

    def prefixes(self, packed: str) -> list[Matrix]:
        """The matrices of ``packed[:1]``, ``packed[:2]`` ... """
        out = [self.matrices[packed[0]]]
        for s in packed[1:]:
            out.append(product(out[-1], self.matrices[s]))
        return out

    def read(self, symbol: str, i: int, j: int) -> list[str]:
        """The rope of a symbol from state to state: the edits of its rows, inserts first."""
        out, todo = [], [(symbol, i, j)]
        while todo:
            s, i, j = todo.pop()
            if s not in self.rules:
                out.append(self.edits[s][i, j])
                continue
            left, right = self.rules[s]
            k = self.matrices[s].mid[i][j]
            todo += [(right, k, j), (left, i, k)]
        return out

    def audit(self, packed: str, i: int, j: int) -> list[str]:
        """The edits of a block's rows from state ``i`` to state ``j``."""
        matrices, parts = self.prefixes(packed), []
        for at in range(len(packed) - 1, 0, -1):
            k = matrices[at].mid[i][j]
            parts.append(self.read(packed[at], k, j))
            j = k
        parts.append(self.read(packed[0], i, j))
        return [x for part in reversed(parts) for x in part]


def learn(distinct: DataFrame) -> tuple[Grammar, DataFrame]:
    """Re-Pair over ``distinct (symbols, n)``: the rules and ``(symbols, packed)``.

    A round takes the most frequent pairs that share no symbol; at most ``MAX_RULES`` counted
    pairs reach the driver.
    """
    grammar = Grammar()
    now = durable(distinct.select("symbols", "n", F.col("symbols").alias("packed")))
    while len(grammar.rules) < MAX_RULES:
        pairs = (
            now.filter("length(packed) > 1")
            .select("n", F.explode(F.expr("transform(sequence(1, length(packed) - 1), i -> substring(packed, i, 2))")).alias("pair"))
            .groupBy("pair").agg(F.sum("n").alias("n"))
        )
        total = now.agg(F.coalesce(F.sum(F.col("n") * F.length("packed")), F.lit(0))).first()[0]
        used: set[str] = set()
        packed: Column = F.col("packed")
        for pair, n in pairs.orderBy(F.desc("n"), "pair").limit(MAX_RULES).collect():
            if n < max(2, LEAST_SHARE * total) or len(grammar.rules) == MAX_RULES:
                break
            if used & set(pair):
                continue
            used |= set(pair)
            packed = F.replace(packed, F.lit(pair), F.lit(grammar.add(pair)))
        if not used:
            break
        now = durable(now.withColumn("packed", packed))
    return grammar, now.select("symbols", "packed")


def _streamed(rows: DataFrame, keys: list, work, schema: str) -> DataFrame:
    """``work`` over the sorted rows of a task as one stream of dicts; it yields tuples.

    All rows of the first key meet in one task, which holds one Arrow batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield from batch.slice(at, 512).to_pylist()

        held = []
        for out in work(each()):
            held.append(out)
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    known = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [known[x.split()[1]] for x in schema.split(",")]
    return rows.repartition(keys[0]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _chain(rows: Iterator[dict]) -> Iterator[tuple]:
    """Per block of a conversation: the states at its borders; with the last one the cost."""

    def ended(c: str | None, blocks: list) -> Iterator[tuple]:
        cost, _, j = min((v + 2 * _TAIL[j], ranks[j], j) for j, v in enumerate(costs))
        ways = []
        for start, illegal, backward in reversed(blocks):
            ways.append((start, illegal, backward[j], j))
            j = backward[j]
        for k, (start, illegal, i, j) in enumerate(reversed(ways)):
            last = k == len(ways) - 1
            yield c, start, i, j, last, cost if last else None, illegal

    none, current, blocks, before = object(), None, [], ""
    current, costs, ranks = none, [], []
    for row in rows:
        if row["c"] != current:
            if current is not none:
                yield from ended(current, blocks)
            current, blocks, before = row["c"], [], ""
            costs, ranks = [0, FAR, FAR, FAR], [0, 0, 0, 0]
        cost, rank = row["cost"], row["rank"]
        found = [min((costs[i] + cost[4 * i + j], ranks[i], i) for i in range(4)) for j in range(4)]
        keys = [(ranks[i], rank[4 * i + j]) if c < FAR else None for j, (c, _, i) in enumerate(found)]
        costs, ranks = [min(c, FAR) for c, _, _ in found], list(_ranked([keys])[0])
        border = before + row["first"]
        blocks.append((row["start"], row["illegal"] + (len(border) == 2 and _illegal(border)), bytes(i for _, _, i in found)))
        before = row["last"]
    if current is not none:
        yield from ended(current, blocks)


def _class(symbols: str) -> str:
    return symbols.translate({ord(x): CLASSES[i] for row in (PLAIN, CUT, GONE) for i, x in enumerate(row)})


def _illegal(symbols: str) -> int:
    kinds = _class(symbols)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))


def _evaluated(packed: DataFrame, grammar: Grammar) -> DataFrame:
    """Matrices of the distinct blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                m = grammar.prefixes(text)[-1]
                out.append((symbols, text, sum(m.cost, ()), sum(m.rank, ()), _illegal(symbols)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["symbols", "packed", "cost", "rank", "illegal"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
    schema = "symbols string, packed string, cost array<long>, rank array<int>, illegal long"
    return packed.mapInArrow(work, schema)


_STEPS = pa.list_(pa.struct([("at", pa.int64()), ("k", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))


def _edited(ways: DataFrame, grammar: Grammar) -> DataFrame:
    """Per block its edit initials, and a step per edit: row, edit and the role written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared: dict[tuple, list[str]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                audits, steps = [], []
                for start, symbols, packed, i, j, last in zip(*[c.to_pylist() for c in part.columns[1:7]]):
                    if len(shared) > 4096:
                        shared.clear()
                    way = shared.get((packed, i, j))
                    if way is None:
                        way = shared[packed, i, j] = grammar.audit(packed, i, j)
                    own, k, state, kinds = [], 0, i, _class(symbols)
                    whole = [*way, "I" * _TAIL[j]] if last else way
                    for row, edits in enumerate(whole):
                        # the inserts that end a conversation follow its last row
                        at = start + min(row, len(way) - 1)
                        for n, x in enumerate(edits):
                            role = None
                            if x in "IR":
                                state = _INSERTED[state]
                                role = _ROLE[state]
                            elif x == "K":
                                state = 1 if kinds[row] == "s" else _INSERTED[state]
                            own.append((at, k, x, role))
                            k += 1
                    audits.append("".join(whole))
                    steps.append([dict(zip(("at", "k", "edit", "role"), s)) for s in own])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(audits, pa.string()), pa.array(steps, _STEPS)],
                    ["c", "start", "audit", "steps"],
                )

    schema = "c string, start long, audit string, steps array<struct<at:long,k:int,edit:string,role:string>>"
    return ways.select("c", "start", "symbols", "packed", "entry", "exit", "last").mapInArrow(work, schema)


def _symbol(role: Column, fault: Column) -> Column:
    kind = F.substring(role, 1, 1)
    kind = F.when(kind.isin(*CLASSES[:3]), kind).otherwise(F.lit("o"))
    gone = F.translate(kind, CLASSES, GONE)
    return (
        F.when(fault.isin("blank", "duplicate"), gone).when(fault == "truncated", F.upper(kind)).otherwise(kind)
    )


class Repair(NamedTuple):
    """``report``: per conversation ``conv``, counts, cost and audit. ``rows``: the repaired
    rows ``(conv, at, k, role, text)``, in the order of ``at`` and ``k``. ``conv`` is the id as
    text."""

    report: DataFrame
    rows: DataFrame


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> Repair:
    none = F.lit("")
    given = turns.select(
        F.col(conv_col).cast("string").alias("c"), F.col(turn_col).alias("t"),
        F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows of any number are spread
    ).withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("t"), "role", "mark", "salt"]
    placed = stored(
        given.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
        .withColumn("at", F.monotonically_increasing_id()),
        "turns",
    )
    # rows of one conversation in one block have consecutive numbers
    firsts = placed.groupBy("c", "role", "mark").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank")
        .when(F.col("text").rlike(rf"[^.!?{_SPACE}][{_SPACE}]*\z"), "truncated")
    )
    marked = placed.select("at", "c", "t", "role", fault.alias("seen")).join(firsts, "at", "left")
    dup = F.col("new").isNull() & ~F.col("seen").eqNullSafe(F.lit("blank"))
    marked = durable(
        marked.withColumn("fault", F.when(dup, "duplicate").otherwise(F.col("seen")))
        .select("at", "c", "t", "fault", _symbol(F.col("role"), F.col("fault")).alias("symbol"))
    )
    blocks = marked.groupBy("c", F.shiftright("at", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("own")
    )
    blocks = durable(
        blocks.select("c", F.col("own")[0]["at"].alias("start"), F.expr("concat_ws('', own.symbol)").alias("symbols"))
    )
    grammar, packed = learn(blocks.groupBy("symbols").agg(F.count("*").alias("n")))
    known = blocks.join(durable(_evaluated(packed, grammar)), "symbols")
    known = durable(known)
    border = known.select(
        "c", "start", "cost", "rank", "illegal", F.left("symbols", F.lit(1)).alias("first"),
        F.right("symbols", F.lit(1)).alias("last"),
    )
    ways = durable(
        _streamed(
            border, ["c", "start"], _chain,
            "c string,start long,entry int,exit int,last boolean,cost long,illegal long",
        )
    )
    found = durable(
        _edited(known.select("start", "symbols", "packed").join(ways.select("c", "start", "entry", "exit", "last"), "start"), grammar)
    )
    per = {k: F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")}
    gap = F.max("t") - F.min("t") + 1 - F.count_distinct("t")
    counts = marked.groupBy("c").agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"), *per.values())
    costs = ways.groupBy("c").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    audits = found.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("start", "audit"))).alias("own"))
    audits = audits.select("c", F.expr("concat_ws('', own.audit)").alias("audit"))
    report = counts
    for more in (costs, audits):
        more = more.withColumnRenamed("c", "_c")
        report = report.join(more, F.col("c").eqNullSafe(F.col("_c"))).drop("_c")
    steps = found.select("c", F.explode("steps").alias("x")).select("c", "x.*").filter("edit <> 'D'")
    texts = placed.select("at", F.col("role").alias("old"), "text")
    rows = steps.filter("edit <> 'I'").join(texts, "at").select(
        "c", "at", "k", F.coalesce("role", "old").alias("role"), "text"
    ).unionByName(steps.filter("edit = 'I'").select("c", "at", "k", "role", F.lit("").alias("text")))
    return Repair(report.withColumnRenamed("c", "conv"), rows.withColumnRenamed("c", "conv"))


def written_sha256(rows: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of a conversation's lines ``role:text``, joined by newlines.

    The hash of one text has to run over it in order; it is fed row by row.
    """

    def work(rows: Iterator[dict]) -> Iterator[tuple]:
        none = object()
        current, state = none, None
        for row in rows:
            line = f"{row['role']}:{row['text']}".encode("utf-8", "surrogatepass")
            if row["c"] != current:
                if current is not none:
                    yield current, state.hexdigest()
                current, state = row["c"], hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        if current is not none:
            yield current, state.hexdigest()

    rows = rows.select(F.col("conv").alias("c"), "at", "k", "role", "text")
    out = _streamed(rows, ["c", "at", "k"], work, "c string,sha256 string")
    return out.withColumnRenamed("c", "conv")
