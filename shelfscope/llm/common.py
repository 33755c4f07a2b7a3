"""What the operators share: Arrow mapping, word splitting, durable keys, components.

Words are maximal runs of characters other than blank and U+0009 to U+000D. UTF-8 bytes
split at exactly these, so most loops work on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

from shelfscope.session import durable, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of their texts, that may be broadcast; larger sides are left to
#: shuffled joins.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch on its way to Python (one row at least), and links that a task holds
#: before they become a forest.
BATCH_BYTES = 1 << 20
FOLD_LINKS = 1 << 16


def utf8(text: str) -> bytes:
    """UTF-8 bytes, with lone surrogates replaced so that no text can fail a task."""
    return text.encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).split() if text else []


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, its session with a limit on the bytes of Arrow batches if none was set. They are
    limited to 10,000 rows otherwise, whatever the rows hold, and the JVM and Python both keep
    a task's batch in memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def arrow_map(
    df: DataFrame, columns: Sequence[Column], work: Callable, schema: StructType, rows: int = 512
) -> DataFrame:
    """``work`` over lists of column values, ``rows`` at a time, as Arrow batches.

    ``work`` gets one list per column and returns one list (or array) per field of
    ``schema``. Small chunks bound the memory of a task whatever the batch size is.
    """
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*[c.to_pylist() for c in part.columns])
                arrays = [pa.array(v, type=f.type) for v, f in zip(out, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return short_batches(df).select(*columns).mapInArrow(run, schema)


def over_texts(rule: Callable, kind: DataType, rows: int = 256) -> Callable:
    """``rule`` as a function of a text column; it gets one text, or None, and returns a value
    of ``kind`` (a dict for a struct). Texts and results are Python objects ``rows`` at a time
    only, Arrow arrays otherwise; for use on ``short_batches``."""
    target = to_arrow_schema(StructType().add("v", kind)).field("v").type

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), rows):
            some = texts.slice(at, rows).to_pylist()
            parts.append(pa.array([rule(t if isinstance(t, str) else None) for t in some], type=target))
        return pa.concat_arrays(parts) if parts else pa.array([], type=target)

    return run.asNondeterministic()


def small_side(df: DataFrame) -> DataFrame:
    """``df`` (durable already) with a broadcast hint if its counted rows and the bytes of
    its texts allow it; otherwise Spark chooses the join."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    size = sum((F.octet_length(c) for c in texts), F.lit(0).cast("long"))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(a, b)`` as one link from every node to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def spanning_of(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """``spanning`` of all links of ``parts``, which become a forest whenever they are more than
    ``FOLD_LINKS`` or twice the forest so far: never all in memory."""
    held, count, most = [(np.empty(0, np.int64),) * 2], 0, FOLD_LINKS
    for part in parts:
        held.append(part)
        count += len(part[0])
        if count > most:
            held = [spanning(*map(np.concatenate, zip(*held, strict=True)))]
            count = len(held[0][0])
            most = max(FOLD_LINKS, 2 * count)
    return spanning(*map(np.concatenate, zip(*held, strict=True)))


#: links of a node that one task may join; more are spread over as many tasks as it takes
_HUB = 256


def _folded(links: DataFrame) -> DataFrame:
    """``links (a, b)`` with ``a > b``: the links of a task as a forest, every node with one link to
    the least that it is tied to there. So no task has more than one link of a node ``a``."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = spanning_of((x[0].to_numpy(), x[1].to_numpy()) for x in batches)
        for at in range(0, len(a), FOLD_LINKS):
            part = [pa.array(x[at : at + FOLD_LINKS]) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(part, schema=target)

    return short_batches(links).select("a", "b").mapInArrow(run, "a long, b long")


def _raised(links: DataFrame, above: DataFrame) -> DataFrame:
    """``links (a, b)``, each ``b`` of ``above (b, m, n)`` replaced by its ``m``. If these are too many
    for a broadcast, the links of a ``b`` with many (``n``) are dealt by salt and its ``m`` goes to
    every salt."""
    own = small_side(above)
    to = F.coalesce("m", "b").alias("b")
    if own is not above:
        return links.join(own, "b", "left").select("a", to)
    salts = F.ceil(F.col("n") / F.lit(_HUB)).cast("int")
    # fewer than one in _HUB of the nodes
    hubs = durable(above.filter(F.col("n") > _HUB).select("b", salts.alias("salts")))
    salted = links.join(small_side(hubs), "b", "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("a"), "salts"), F.lit(0)).cast("int").alias("salt")
    )
    every = above.select("b", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return salted.join(every, ["b", "salt"], "left").select("a", to)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: the least node reachable.

    All links point down. A round brings the links of a node ``a`` together, where they become a
    forest, and then moves links from nodes that have links down themselves to the least end of
    these. Tasks fold their links before the shuffle, so no node comes with more links than there are
    tasks; nodes that many links point to are never gathered (``_raised``). A round is one shuffle of
    the links and one of a row per node; its links and the nodes still to be moved are written to the
    checkpoint folder. The rounds end when every node has one link down or none, and those with one
    are linked from no other: after a number of rounds logarithmic in the nodes.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        # Parquet, not checkpoints: these keep the estimated sizes of their plans, which grow to
        # numbers of thousands of digits over the rounds
        low = stored(_folded(_folded(now).repartition("a")), "links")
        ends = F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(0).alias("from")),
                F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("from")),
            )
        )
        nodes = low.select(ends.alias("e")).groupBy(F.col("e.node").alias("b")).agg(
            F.min("e.to").alias("m"), F.max("e.to").alias("top"), F.sum("e.from").alias("n")
        )
        # still to be moved: nodes with two links down, or with one and links from above
        above = stored(nodes.filter("m <> top or m is not null and n > 0").select("b", "m", "n"), "above")
        if above.isEmpty():
            break
        now = _raised(low, above.filter("n > 0"))
    # a link may be there twice
    both = F.explode(F.array(*[F.struct(F.col(c).alias("node"), F.col("b").alias("root")) for c in "ab"]))
    return low.select(both.alias("e")).select("e.node", "e.root").distinct()
