"""SimHash near-duplicates by tiled exact comparison.

A text's shingles of ``width`` words are hashed with XXH64 (seed 42); bit i of the
fingerprint is set if it is set in over half of the hashes. Fingerprints link at
``radius`` or fewer differing bits.

Comparison. Equal fingerprints become one row first. The 64 bits are cut into ``PARTS``
words, and the population counts of the words name a cell. The sum of the differences of
these counts never exceeds the number of differing bits, so only cells at a sum of
``radius`` or less are compared: all other tile pairs are skipped, and no link is lost.
A cell is cut into tiles of about ``TILE`` fingerprints by hash, tiles are stored as
arrays, and a task compares two tiles with exclusive-or and bit counts in numpy. It emits
a spanning forest of the links found, never the pairs, so a large group of near copies
costs as many rows as it has members. Components follow in Spark (``common.components``).

The work is quadratic in the distinct fingerprints, about 1.6 % of all pairs with four
words; ``parts=8`` leaves 0.03 % of them at the price of more tile rows.

Special inputs: null text and text without words have fingerprint zero and are linked
like any other; fewer words than ``width`` form one shingle; repeated rows each get their
row; rows with a null id are kept, and their component takes the least id there is (null
if none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfscope.llm.common import arrow_map, components, short_batches, small_side, spanning_of, words_of
from shelfscope.session import durable

WIDTH = 3
RADIUS = 2
PARTS = 4
TILE = 4096
_BLOCK = 1 << 14
_PAIRS = 1 << 18  # pairs compared at once: all of them may be links


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = [w.lower() for w in words_of(text)]  # bytes: only A-Z change
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        # the words of a block joined once, its shingles are slices of that
        part = words[at : min(n, at + _BLOCK) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        own = min(n - at, _BLOCK)
        last = ends[width - 1 : width - 1 + own] if len(part) >= width else ends[-1:]
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], 42)
            for a, b in zip(starts[:own].tolist(), last.tolist(), strict=True)
        ]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH
) -> DataFrame:
    """``(id, fp)``: the fingerprint of every row as a signed long."""

    def work(ids: list, texts: list) -> tuple:
        return ids, [fingerprint(t, width) for t in texts]

    schema = StructType([docs.schema[id_col], StructField("fp", LongType())])
    return arrow_map(docs, [F.col(id_col), F.col(text_col)], work, schema)


def _cell(fp: Column, parts: int) -> Column:
    """The population counts of the words, seven bits each, in one long."""
    size = 64 // parts
    ones = (1 << size) - 1 if size < 64 else -1
    out = F.lit(0).cast("long")
    for i in range(parts):
        word = F.shiftrightunsigned(fp, i * size).bitwiseAND(F.lit(ones).cast("long"))
        out = out.bitwiseOR(F.shiftleft(F.bit_count(word).cast("long"), 7 * i))
    return out


def _steps(parts: int, radius: int) -> list[int]:
    """Differences between two cells within the radius, each pair in one direction."""
    found = {sum(d << (7 * i) for i, d in enumerate(step)) for step in _sparse(parts, radius)}
    return sorted(d for d in found if d >= 0)


def _sparse(parts: int, radius: int) -> Iterator[tuple[int, ...]]:
    """Difference vectors with a sum of magnitudes of at most ``radius``."""
    if parts == 0:
        yield ()
        return
    for d in range(-radius, radius + 1):
        for rest in _sparse(parts - 1, radius - abs(d)):
            yield (d, *rest)


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two arrays of fingerprints."""
    rows = max(1, _PAIRS // max(1, len(b)))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), rows):
            near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
            i, j = np.nonzero(near)
            x, y = a[at + i], b[j]
            differ = x != y
            if differ.any():
                yield x[differ].view(np.int64), y[differ].view(np.int64)

    return spanning_of(found())


def links(
    distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE
) -> DataFrame:
    """``(a, b)``: links that connect exactly the fingerprints in ``distinct (fp)`` that
    a chain of links within the radius connects."""
    cells = distinct.select("fp", _cell(F.col("fp"), parts).alias("cell"))
    # one row per occupied cell: at most (64 / parts + 1) ** parts of them
    sizes = durable(
        cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    )
    placed = cells.join(small_side(sizes), "cell").select(
        "cell", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile"), "fp"
    )
    tiles = durable(placed.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[F.lit(d).cast("long") for d in _steps(parts, radius)])
    # pairs of tiles: first the pairs of cells, then the tiles of the second cell
    tile_keys = tiles.select("cell", "tile")
    towards = tile_keys.select(
        "cell", "tile", F.explode(steps).alias("step")
    ).select("cell", "tile", (F.col("cell") + F.col("step")).alias("to"))
    known = sizes.select(F.col("cell").alias("to"), "tiles")
    pairs = (
        towards.join(small_side(known), "to")
        .select("cell", "tile", "to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("to_tile"))
        .filter((F.col("cell") != F.col("to")) | (F.col("tile") <= F.col("to_tile")))
    )
    there = tiles.select(F.col("cell").alias("to"), F.col("tile").alias("to_tile"), F.col("fps").alias("others"))
    both = tiles.join(pairs, ["cell", "tile"]).join(there, ["to", "to_tile"]).select("fps", "others")
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def values(column: pa.Array, i: int) -> np.ndarray:
        return column[i].values.to_numpy().view(np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                linked(values(batch[0], i), values(batch[1], i), radius) for i in range(batch.num_rows)
            ]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=target
                )

    return short_batches(both).mapInArrow(compare, "a long, b long")


def grouped(prints: DataFrame, nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(fp, component_id, keep_fp)`` for every distinct fingerprint of ``prints (id,
    fp)`` in the components ``nodes (node, root)``: the least id of its component and the
    fingerprint of the row that has it."""
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    rooted = durable(
        least.join(nodes, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
    of_root = rooted.groupBy("root").agg(first.alias("k"))
    return rooted.join(of_root, "root").select(
        "fp", F.col("k.least").alias("component_id"), F.col("k.fp").alias("keep_fp")
    )


def clusters(
    prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, parts: int = PARTS
) -> DataFrame:
    """``grouped`` by the links between the fingerprints of ``prints (id, fp)``."""
    least = durable(prints.groupBy("fp").agg(F.min(id_col).alias(id_col)))
    return grouped(least, components(links(least.select("fp"), radius, parts)), id_col)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``."""
    prints = durable(fingerprints(docs, id_col, text_col, width))
    found = clusters(prints, id_col, radius, parts)
    return prints.join(found, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    parts: int = PARTS,
) -> DataFrame:
    """``docs`` with one row of each component, that of the least id, columns unchanged.

    Ids that occur once are decided by id, so texts are not shuffled. Rows whose id is
    null or repeated are decided by id and fingerprint; of equal ones, one row stays.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width))
    found = durable(clusters(prints, id_col, radius, parts))
    return least_rows(docs, prints, found, id_col, text_col, lambda t: fingerprint(t, width))


def least_rows(
    docs: DataFrame, prints: DataFrame, found: DataFrame, id_col: str, text_col: str, name: Callable
) -> DataFrame:
    """``keep_one`` for ``prints (id, fp)`` in the components ``found`` (see ``grouped``);
    ``name`` is the fingerprint of a text."""
    by_id = durable(prints.groupBy(id_col).agg(F.count("*").alias("n"), F.max("fp").alias("fp")))
    single = by_id.filter((F.col("n") == 1) & F.col(id_col).isNotNull())
    gone = durable(
        single.join(found, "fp").filter(F.col(id_col) != F.col("component_id")).select(id_col)
    )
    kept = docs.join(small_side(gone), id_col, "left_anti").select(docs.columns)
    odd = durable(by_id.filter((F.col("n") > 1) | F.col(id_col).isNull()).select(id_col))
    if odd.isEmpty():
        return kept

    odd = small_side(odd)
    sure = kept.join(odd, kept[id_col].eqNullSafe(odd[id_col]), "left_anti")
    doubtful = docs.join(odd, docs[id_col].eqNullSafe(odd[id_col]), "left_semi")
    own = "__fp"
    while own in docs.columns:
        own += "_"

    @F.pandas_udf(LongType())
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [name(t if isinstance(t, str) else None) for t in texts], dtype="int64"
        )

    marked = doubtful.withColumn(own, print_of.asNondeterministic()(F.col(text_col)))
    keepers = found.filter("fp = keep_fp").select(F.col("fp").alias(own + "k"), "component_id")
    stay = (F.col(own) == keepers[own + "k"]) & marked[id_col].eqNullSafe(keepers["component_id"])
    first = marked.join(keepers, stay, "left_semi").dropDuplicates([own]).select(docs.columns)
    return sure.select(docs.columns).unionByName(first)
