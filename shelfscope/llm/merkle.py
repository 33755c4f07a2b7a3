"""Merkle manifest of a dataset: every row a leaf, a tree per group, a tree over the groups.

A digest is the lower-case hex SHA-256 of its inputs' concatenation, digests being taken as
their hex text. Leaves of a group are ordered; every 16 consecutive nodes (the last run may
be shorter, even one node) become their digest until one node, the group's subroot, remains.
Subroots ordered by group (null first, then by UTF-8 bytes) give the root in the same way.

Levels are strings: an aligned block of 256 nodes keeps a level as the concatenation of its
digests, 64 characters each. Substrings of 1,024 characters hash to the parents; what stands
left and right of a node in its run is its sibling segment. A block ends in one node after
two levels, and the block nodes are the next 256th of the tree, so the recursion has one
round per two levels. Groups of any size are spread over blocks by a range sort; nothing is
gathered but the 256 rows of a block.

Special cases: null fields are hashed as ``-`` (an empty text as ``0:``); rows with equal
order column, null among them, are ordered by their leaf; equal rows have equal leaves and a
proof each; a group of one row has its leaf as subroot, a table of one group its subroot as
root; an empty table gives no rows; columns that are not named are ignored, so that any names
may clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.llm.common import small_side
from shelfscope.session import durable, stored

HEX = 64
RUN = 16
BLOCK = RUN * RUN
#: monotonically_increasing_id: partition above, position below
_SLOT_BITS = 33
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows (g, o, leaf, data)`` with ``i``, the position in the group, and ``n``, its size.

    Rows are range-sorted and written; a group's rows in one partition are consecutive, so
    one row per group and partition gives every position.
    """
    placed = stored(
        # the leaves are there already, so that sampling them is no second reading of the texts
        rows.repartitionByRange(F.asc_nulls_first("g"), F.asc_nulls_first("o"), "leaf", "salt")
        .sortWithinPartitions(F.asc_nulls_first("g"), F.asc_nulls_first("o"), "leaf", "salt")
        .drop("salt").withColumn("slot", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("part", F.shiftright("slot", _SLOT_BITS))
    runs = placed.groupBy("g", "part").agg(F.min("slot").alias("low"), F.count("*").alias("k"))
    runs = durable(runs)
    # one row per group and partition at most
    own = Window.partitionBy("g")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("g").alias("_g"), F.col("part").alias("_part"), "low",
        F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"), F.sum("k").over(own).alias("n"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("g").eqNullSafe(F.col("_g"))
    position = F.col("slot") - F.col("low") + F.col("before")
    return placed.join(small_side(durable(starts)), same).select(
        "g", position.alias("i"), "n", F.col("leaf").alias("h"), "data"
    )


def _piece(s: str, start: str, length: str) -> str:
    return f"substring({s}, cast({start} as int) + 1, cast({length} as int))"


def _flank(s: str, at: str) -> str:
    """What stands beside node ``at`` in its run of the level string ``s``."""
    first = f"({at} div {RUN}) * {RUN * HEX}"
    return (
        f"struct({_piece(s, first, f'({at} % {RUN}) * {HEX}')} as left, "
        f"{_piece(s, f'({at} + 1) * {HEX}', f'{RUN * HEX} - ({at} % {RUN} + 1) * {HEX}')} as right)"
    )


LEVEL = "concat_ws('', transform(own, x -> x.h))"
_PARENT = f"sha2(cast({_piece('s0', f'x * {RUN * HEX}', str(RUN * HEX))} as binary), 256)"
PARENTS = f"concat_ws('', transform(sequence(0, (length(s0) - 1) div {RUN * HEX}), x -> {_PARENT}))"


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes (g, i, n, h, data)`` in aligned blocks, with the one node that a block ends in."""
    blocks = nodes.groupBy("g", "n", F.expr(f"i div {BLOCK}").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("i", "h", "data"))).alias("own")
    )
    level = blocks.withColumn("s0", F.expr(LEVEL)).withColumn("s1", F.expr(PARENTS))
    above = F.when(F.col("n") > RUN, digest(F.col("s1"))).otherwise(
        F.when(F.col("n") > 1, F.col("s1")).otherwise(F.col("s0"))
    )
    return stored(level.select("g", "n", "b", "own", above.alias("node")), "blocks")


def _upwards(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and ``(g, top)``: the node that is left of each group."""
    rounds = [_blocks(nodes)]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        rounds.append(
            _blocks(
                rounds[-1].select(
                    "g", F.col("b").alias("i"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"),
                    F.col("node").alias("h"), F.col("b").alias("data"),
                )
            )
        )
    return rounds, rounds[-1].select("g", F.col("node").alias("top"))


def _downwards(rounds: list[DataFrame], rest: DataFrame) -> DataFrame:
    """``(g, h, data, path, info)`` for every node of the first round. ``rest (g, info,
    path)`` says for each group how its last node goes on."""
    rest = rest.withColumn("data", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        above = rest.select(F.col("g").alias("_g"), F.col("data").alias("_b"), "info", F.col("path").alias("rest"))
        same = (F.col("b") == F.col("_b")) & F.col("g").eqNullSafe(F.col("_g"))
        # a run at a time: its siblings, then those of its 16 nodes
        runs = blocks.join(above, same).withColumn("s0", F.expr(LEVEL)).select(
            "g", "n", "info", "own", "rest", "s0", F.expr(PARENTS).alias("s1"),
            F.explode(F.expr(f"sequence(0, (size(own) - 1) div {RUN})")).alias("r"),
        ).select(
            "g", "n", "info",
            F.expr(f"slice(own, r * {RUN} + 1, {RUN})").alias("own"),
            F.expr(_piece("s0", f"r * {RUN * HEX}", str(RUN * HEX))).alias("s"),
            F.expr(f"case when n > {RUN} then concat(array({_flank('s1', 'r')}), rest) else rest end").alias("rest"),
        )
        rest = runs.select("g", "n", "info", "s", "rest", F.posexplode("own").alias("k", "x")).select(
            "g", F.col("x.h").alias("h"), F.col("x.data").alias("data"), "info",
            F.expr(f"case when n > 1 then concat(array({_flank('s', 'k')}), rest) else rest end").alias("path"),
        )
    return rest


def fold(path: Column, node: Column) -> Column:
    """The node at the end of ``path`` that starts at ``node``."""
    return F.aggregate(path, node, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def siblings(path: Column) -> Column:
    """The digests along a path as one text, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def manifest(
    rows: DataFrame, columns: Sequence[Column], group: Column, order: Column, data: Column
) -> DataFrame:
    """``(data, leaf, subroot, root, path)`` for every row: ``path`` holds the siblings
    (``left``, ``right``) on every level from the leaf to the root.

    ``columns`` are hashed into the leaf, ``data`` (a narrow struct) is carried along.
    """
    leaves = rows.select(
        group.alias("g"), order.alias("o"), leaf(columns).alias("leaf"), data.alias("data"),
        F.monotonically_increasing_id().alias("salt"),  # equal rows of any number are spread
    )
    nodes = _numbered(stored(leaves, "leaves"))
    groups = durable(nodes.filter("i = 0").select("n"))
    largest, count = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    rounds, tops = _upwards(nodes, largest)
    tops = durable(tops)
    one = F.lit(None).cast("string")
    heads = tops.select(
        one.alias("g"), F.col("g").alias("o"), F.col("top").alias("leaf"), F.struct("g").alias("data"),
        F.lit(0).alias("salt"),
    )
    head_rounds, root = _upwards(_numbered(heads), count)
    end = root.select("g", F.struct(F.col("top").alias("root")).alias("info"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    ways = durable(
        _downwards(head_rounds, end).select(
            F.col("data.g").alias("g"),
            F.struct(F.col("h").alias("subroot"), F.col("info.root").alias("root")).alias("info"), "path",
        )
    )
    return _downwards(rounds, ways).select("data", F.col("h").alias("leaf"), "info.subroot", "info.root", "path")
