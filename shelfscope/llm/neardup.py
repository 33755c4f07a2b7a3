"""Near copies by the Jaccard similarity of word shingles: MinHash bands find candidates,
SimHash and MinHash bytes are the sieve, and exact sets decide.

Texts are linked if the sets of their shingles of ``WIDTH`` words (64-bit hashes of the words,
A-Z as a-z, combined) have a Jaccard similarity of ``SIMILAR`` or more. A group is a chain of
links.

Candidates. Equal sets become one row first, named by a 64-bit digest (two different sets
share one by chance only). A set has ``BANDS`` bands of ``DEPTH`` MinHash values, whatever its
size; two sets with a similarity of 0.8 share none of them in 5 of 100,000,000 cases, more
similar ones less often. Only sets that share a band are compared, so the work grows with the
texts and not with their pairs; a passage that many texts share rarely fills a whole band of
them. In each band the sets are tied to the one of least name, pair by pair once; bands in which
sets of different chains still meet are then compared all to all, in tiles. A pair passes the
sieve if its sizes are within ``SIMILAR``, at least ``AGREE`` of 64 MinHash bytes are equal and, for
sets of ``SURE`` shingles or more, at most ``RADIUS`` of 64 SimHash bits differ (exclusive-or and bit
counts). At a similarity of 0.8, 51.3 bytes agree on average with a deviation of 3.2 and 9.7
bits differ with one of 2.9: both limits lie six deviations away. Tasks emit spanning forests,
never the pairs.

Links. The shingle sets of the groups of candidates are built from the texts again and compared
exactly: all with the set of most copies first, then those that it does not link, if there
are any, with all others of the group, in tiles of about ``TILE_SHINGLES`` shingles. A candidate
that is not similar enough links nothing, whatever forest it was part of.

With ``simhash_radius``, the links of ``simhash`` (fingerprints over words of three, repeats
included, tiles compared by exclusive-or and bit counts) are the first candidates: bands whose
sets these chains hold already need no comparison of their own. The fingerprints come from the
pass that makes the sets, and the exact comparison decides as for all candidates.

Special inputs are those of ``simhash``: null text and text without words are copies of each
other; fewer words than ``width`` form one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, IntegerType, LongType, StructField, StructType,
)

from shelfscope.llm import simhash
from shelfscope.llm.common import arrow_map, components, short_batches, small_side, spanning_of, utf8
from shelfscope.session import durable, stored

WIDTH = 5
SIMILAR = 0.8
RADIUS = 28
AGREE = 32
SURE = 64
BANDS = 32
DEPTH = 4
TILE = 4096
TILE_SHINGLES = 1 << 18
_BLOCK = 1 << 11
_PAIRS = 1 << 18  # pairs compared at once, by their SimHashes
_NEAR_PAIRS = 1 << 15  # and by all fields
_SKETCH = 64
_MAX_WORDS = 50_000  # hashes of words that a task remembers
_PIECE = 1 << 17  # bytes of a text that are split at once
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
#: multipliers of a shingle's words, the last one also that of shorter texts
_PLACES = np.random.default_rng(7).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: one candidate: digest, SimHash, size of the set, MinHash bytes
_ROW = np.dtype([("key", "<i8"), ("fp", "<u8"), ("n", "<i8"), ("sketch", "u1", _SKETCH)])
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words, A-Z as a-z. Long texts are split piece by piece: a list of
    all their words takes many times the memory of the text."""
    data, parts, at = utf8(text or ""), [np.empty(0, np.uint64)], 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        words = data[at:end].lower().split()  # bytes: only A-Z change
        if len(_words) > _MAX_WORDS:
            _words.clear()
        for w in set(words).difference(_words):
            _words[w] = xxhash.xxh64_intdigest(w, 42)
        parts.append(np.fromiter((_words[w] for w in words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different shingle hashes of a text in ascending order."""
    own = _word_hashes(text)
    if not len(own):
        return own
    k = min(width, len(own))
    out = np.zeros(len(own) - k + 1, np.uint64)
    for j in range(k):
        out += own[j : len(own) - k + 1 + j] * _PLACES[j]
    if k < width:
        out += np.uint64(k)
    return np.unique(_mixed(out))


def digest(shingles: np.ndarray) -> int:
    """The name of a set as a signed 64-bit number; zero for the empty set."""
    if not len(shingles):
        return 0
    own = xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 42)
    return own - (1 << 64) if own >> 63 else own


def _sieve(shingles: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A set as one ``_ROW``, and its bands (none for the empty set)."""
    ones = np.zeros(64, np.int64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        np.minimum(least, (part[:, None] * _FACTORS).min(axis=0), out=least)
    fp = np.packbits((2 * ones > len(shingles)).astype(np.uint8), bitorder="little").view("<u8")[0]
    sketch = (least[:_SKETCH] >> np.uint64(24)).astype(np.uint8)
    row = np.array([(digest(shingles), fp, len(shingles), sketch)], _ROW).tobytes()
    parts = (_mixed(least).reshape(BANDS, DEPTH) * _PLACES[:DEPTH]).sum(axis=1, dtype=np.uint64)
    bands = _mixed(parts + np.arange(BANDS, dtype=np.uint64))
    return row, bands if len(shingles) else bands[:0]


def _near(a: np.ndarray, b: np.ndarray, radius: int, agree: int) -> np.ndarray:
    """Which rows of two equally long arrays of ``_ROW`` pass the sieve."""
    small, large = np.minimum(a["n"], b["n"]), np.maximum(a["n"], b["n"])
    same = (a["sketch"] == b["sketch"]).sum(axis=1) >= agree
    bits = np.bitwise_count(a["fp"] ^ b["fp"]) <= radius
    return (10 * small >= round(10 * SIMILAR) * large) & same & ((small < SURE) | bits)


def _candidates(a: np.ndarray, b: np.ndarray, radius: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates between two arrays of ``_ROW``."""
    # copies of the fields: strided ones are slow
    fa, fb, na, nb = (np.ascontiguousarray(x[f]) for f in ("fp", "n") for x in (a, b))
    rows = max(1, _PAIRS // max(1, len(b)))

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(a), rows):
            near = np.bitwise_count(fa[at : at + rows, None] ^ fb[None, :]) <= radius
            near |= np.minimum(na[at : at + rows, None], nb[None, :]) < SURE
            i, j = np.nonzero(near)
            i += at
            # short or similar sets: all pairs get here, with two whole rows each
            for k in range(0, len(i), _NEAR_PAIRS):
                p, q = i[k : k + _NEAR_PAIRS], j[k : k + _NEAR_PAIRS]
                near = _near(a[p], b[q], radius, agree)
                x, y = a["key"][p[near]], b["key"][q[near]]
                if (differ := x != y).any():
                    yield x[differ], y[differ]

    return spanning_of(found())


def similar(keys: np.ndarray, sets: list[np.ndarray], others: np.ndarray, other_sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the exact links between two lists of sets (none empty)."""
    sizes = np.array([len(s) for s in other_sets])
    known, at = np.unique(np.concatenate(other_sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    held = np.zeros(len(known), np.int32)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for key, own in zip(keys, sets, strict=True):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            place = place[known[place] == own]
            held[place] = 1
            both = np.add.reduceat(held[at], starts)
            held[place] = 0
            # in whole numbers: similarity of 80 % or more
            j = np.nonzero((100 * both >= round(100 * SIMILAR) * (len(own) + sizes - both)) & (others != key))[0]
            yield np.full(len(j), key), others[j]

    return spanning_of(found())


def _tiled(rows: DataFrame, unit: str, most: int, weight) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``tile`` each, and the number of ``tiles`` per ``unit``: a tile
    has a weight of about ``most``."""
    sizes = durable(rows.groupBy(unit).agg(F.ceil(F.sum(weight) / F.lit(most)).cast("int").alias("tiles")))
    placed = rows.join(small_side(sizes), unit)
    return placed.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles").cast("int")).drop("tiles"), sizes


def _tile_pairs(tiles: DataFrame, sizes: DataFrame, unit: str, columns: list[str], only: str = "true") -> DataFrame:
    """Pairs of ``tiles (unit, tile, *columns)`` within a unit, each once, the columns of the
    second tile with a 2; ``sizes`` has ``(unit, tiles)``. ``only``: a condition on the
    first tile."""
    pairs = tiles.filter(only).select(unit, "tile").join(small_side(sizes.select(unit, "tiles")), unit).select(
        unit, "tile", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("to_tile")
    )
    there = tiles.select(unit, F.col("tile").alias("to_tile"), *[F.col(c).alias(c + "2") for c in columns])
    both = tiles.join(pairs, [unit, "tile"]).join(there, [unit, "to_tile"])
    return both.select(*columns, *[c + "2" for c in columns])


def _forests(pairs: DataFrame, compare) -> DataFrame:
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = compare(*[c[i].values for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=target)

    return short_batches(pairs).mapInArrow(run, "a long, b long")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _ROW)


def candidates(
    sieves: DataFrame, radius: int = RADIUS, agree: int = AGREE, tile: int = TILE, *, first: DataFrame | None = None
) -> DataFrame:
    """``(a, b)``: links that connect all candidates among ``sieves (key, sieve, bands)``
    that a chain of candidates connects; ``first (a, b)``: candidates known already."""
    places = sieves.select(F.explode("bands").alias("s"), "key")
    # most bands are those of one set and go; a band of many sets is a skewed join, no window
    shared = places.groupBy("s").agg(F.min("key").alias("hub"), F.max("key").alias("top")).filter("hub <> top")
    met = stored(places.join(shared.select("s", "hub"), "s").select("s", "key", "hub"), "met")
    narrow = sieves.select("key", "sieve")

    # every set and the least one of a band, each pair once
    pairs = met.filter("key <> hub").select("hub", "key").distinct()
    pairs = pairs.join(narrow, "key").join(
        narrow.select(F.col("key").alias("hub"), F.col("sieve").alias("sieve2")), "hub"
    )

    def sift(a: list, b: list, x: list, y: list) -> tuple:
        near = _near(*(np.frombuffer(b"".join(v), _ROW) for v in (x, y)), radius, agree)
        return np.array(a, np.int64)[near], np.array(b, np.int64)[near]

    link = StructType([StructField("a", LongType()), StructField("b", LongType())])
    columns = [F.col(c) for c in ("key", "hub", "sieve", "sieve2")]
    tied = durable(arrow_map(pairs, columns, sift, link, rows=8192))
    if first is not None:
        tied = tied.unionByName(first)

    # bands in which different chains still meet
    chains = durable(components(tied).withColumnRenamed("node", "key"))
    rooted = met.join(chains, "key", "left").select("s", "key", F.coalesce("root", "key").alias("root"))
    rooted = stored(rooted, "rooted")
    mixed = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("s")
    rows = durable(rooted.join(mixed, "s").select("s", "key")).join(narrow, "key")
    placed, sizes = _tiled(rows, "s", tile, F.lit(1))
    tiles = durable(placed.groupBy("s", "tile").agg(F.collect_list("sieve").alias("rows")))
    more = _forests(
        _tile_pairs(tiles, sizes, "s", ["rows"]), lambda a, b: _candidates(_rows(a), _rows(b), radius, agree)
    )
    return tied.unionByName(more)


def links(sets: DataFrame, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``(a, b)``: exact links that connect what a chain of links connects inside each group
    of ``sets (root, key, shingles, copies)``."""
    first = F.max(F.struct("copies", "key", "shingles")).alias("h")
    hubs = sets.groupBy("root").agg(first).select("root", F.col("h.key").alias("hub"), F.col("h.shingles").alias("hub_set"))
    weight = F.size("shingles").cast("long")
    placed, _ = _tiled(sets.select("root", "key", "shingles"), "root", tile_shingles, weight)
    tiles = placed.groupBy("root", "tile").agg(F.collect_list(F.struct("key", "shingles")).alias("rows")).select(
        "root", F.col("rows.key").alias("keys"), F.col("rows.shingles").alias("sets")
    )

    def arrays(column: pa.Array) -> list[np.ndarray]:
        return [x.values.to_numpy().view(np.uint64) for x in column]

    def with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, keys, own, hub, hub_set = (c[i] for c in batch.columns)
                hub = np.array([hub.as_py()])
                found = similar(hub, arrays([hub_set]), keys.values.to_numpy(), arrays(own.values))
                every = keys.values.to_numpy()
                linked = np.union1d(np.concatenate(found), hub)
                rest = every[~np.isin(every, linked)]
                a, b = np.concatenate([found[0], rest]), np.concatenate([found[1], rest])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # a row (a, a): the set that most copies have does not link a
    ties = durable(short_batches(tiles.join(hubs, "root")).mapInArrow(with_hub, "a long, b long"))
    rest = ties.filter("a = b").select(F.col("a").alias("key"), F.lit(0).alias("late"))
    marked = sets.select("root", "key", "shingles").join(rest, "key", "left")
    open_roots = marked.filter("late = 0").select("root").distinct()
    marked = marked.join(open_roots, "root").withColumn("late", F.coalesce("late", F.lit(1)))
    # tiles of the rest come first: only they are compared with those behind them
    sizes = durable(
        marked.groupBy("root").agg(
            *[
                F.ceil(F.coalesce(F.sum(F.when(F.col("late") == k, weight)), F.lit(0)) / F.lit(tile_shingles))
                .cast("int").alias(name)
                for k, name in enumerate(("front", "back"))
            ]
        ).withColumn("tiles", F.col("front") + F.col("back"))
    )
    number = F.pmod(F.xxhash64("key"), F.when(F.col("late") == 0, F.col("front")).otherwise(F.col("back")))
    dealt = marked.join(small_side(sizes), "root").select(
        "root", (number + F.when(F.col("late") == 0, 0).otherwise(F.col("front"))).cast("int").alias("tile"),
        "late", "key", "shingles",
    )
    tiles = durable(
        dealt.groupBy("root", "tile", "late").agg(F.collect_list(F.struct("key", "shingles")).alias("rows"))
        .select("root", "tile", "late", F.col("rows.key").alias("keys"), F.col("rows.shingles").alias("sets"))
    )

    def compare(keys: pa.Array, own: pa.Array, others: pa.Array, other_sets: pa.Array) -> tuple:
        return similar(keys.to_numpy(), arrays(own), others.to_numpy(), arrays(other_sets))

    more = _forests(_tile_pairs(tiles, sizes, "root", ["keys", "sets"], "late = 0"), compare)
    return ties.filter("a <> b").unionByName(more)


def _print_links(prints: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that connect the sets of ``prints (fp, print)`` whose SimHash fingerprints
    a chain of links within ``radius`` connects; ``fp`` names a set."""
    named = durable(prints.select("print", "fp").distinct())
    near = simhash.links(named.select("print").distinct().withColumnRenamed("print", "fp"), radius)
    nodes = durable(components(near))
    chains = named.join(nodes, F.col("print") == F.col("node"), "left").select(
        F.coalesce("root", "print").alias("chain"), "fp"
    )
    # combined in the tasks first; most chains are one set and go
    shared = chains.groupBy("chain").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    shared = durable(shared.filter("b <> top").select("chain", "b"))
    return chains.join(small_side(shared), "chain").select(F.col("fp").alias("a"), "b").filter("a <> b")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    agree: int = AGREE,
    simhash_radius: int | None = None,
) -> DataFrame:
    """``docs`` with one row of each group, that of the least id, columns unchanged."""

    def sieve(ids: list, texts: list) -> tuple:
        rows, bands = zip(*[_sieve(shingle_set(t, width)) for t in texts], strict=True)
        keys = np.frombuffer(b"".join(rows), _ROW)["key"].copy()
        prints = [None if simhash_radius is None else simhash.fingerprint(t) for t in texts]
        return ids, keys, rows, [b.view(np.int64) for b in bands], prints

    own = docs.schema[id_col]
    schema = StructType(
        [
            own, StructField("fp", LongType()), StructField("sieve", BinaryType()),
            StructField("bands", ArrayType(LongType())), StructField("print", LongType()),
        ]
    )
    columns = [F.col(id_col), F.col(text_col)]
    prints = durable(arrow_map(docs, columns, sieve, schema))
    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")))
    one = durable(
        prints.groupBy(F.col("fp").alias("key"))
        .agg(
            least.alias("k"), F.count("*").alias("copies"), F.any_value("sieve").alias("sieve"),
            F.any_value("bands").alias("bands"),
        )
        .select("key", F.col("k.id").alias("least"), "copies", "sieve", "bands")
    )
    first = None if simhash_radius is None else durable(_print_links(prints, simhash_radius))
    groups = durable(components(candidates(one, radius, agree, first=first)))
    members = durable(one.join(groups, F.col("key") == F.col("node")).select("key", "least", "copies", "root"))

    def sets(texts: list) -> tuple:
        found = [shingle_set(t, width) for t in texts]
        return [digest(s) for s in found], [s.view(np.int64) for s in found]

    # the texts of one row for each member; repeated and null ids bring others along
    named = small_side(members.select("least").distinct())
    chosen = docs.join(named, docs[id_col].eqNullSafe(named["least"]), "left_semi")
    schema = StructType([StructField("key", LongType()), StructField("shingles", ArrayType(LongType()))])
    shingles = arrow_map(chosen, columns[1:], sets, schema)
    rooted = durable(
        shingles.join(small_side(members.select("key", "root", "copies")), "key")
        .groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("root", "copies", "shingles")])
    )
    found = simhash.grouped(prints.select(id_col, "fp"), components(links(rooted)), id_col)
    return simhash.least_rows(
        docs, prints.select(id_col, "fp"), durable(found), id_col, text_col,
        lambda t: digest(shingle_set(t, width)),
    )
