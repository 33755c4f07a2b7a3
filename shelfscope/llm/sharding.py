"""Sharding by a permutation-filled lookup table.

A table of prime size holds a shard in every slot. Each shard has a preference order, a
permutation of the slots given by an offset and a step from its name; the shards take turns,
each claiming the first slot of its order that is free, until the table is full. Every shard
gets the same number of slots, give or take one, and removing a shard moves few other slots.

A row's slot is a hash of its key modulo the size. The table has ``size`` rows whatever the
data are, so it is broadcast: placement is one look-up per row, without a shuffle, and a hot
value of another column spreads over all shards. Equal keys go to one shard.

Null keys are one value of their own (as the text ``null``); repeated rows each get their row;
an empty table gives an empty result; other columns are ignored (``placed``) or kept
(``write``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = 48
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def prime_from(n: int) -> int:
    """The least prime of at least ``n``."""
    while not is_prime(n):
        n += 1
    return n


def names(count: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def table(shards: Sequence[str], size: int | None = None) -> list[int]:
    """The shard number of every slot; ``size`` is a prime, by default the first from a
    hundred slots per shard on."""
    size = size or prime_from(100 * len(shards))
    if not shards or not is_prime(size) or size < len(shards):
        raise ValueError("shards and a prime size of at least as many slots are needed")
    offset = [_number(f"{s}/offset") % size for s in shards]
    step = [_number(f"{s}/step") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    tried = [0] * len(shards)
    claimed = 0
    while True:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + tried[i] * step[i]) % size
                tried[i] += 1
                if owner[slot] < 0:
                    break
            owner[slot] = i
            claimed += 1
            if claimed == size:
                return owner


def lookup(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """``(slot, shard)``: the table as rows."""
    cells = F.split(F.lit(",".join(map(str, owner))), ",")
    rows = spark.range(0, 1, 1, 1).select(F.posexplode(cells).alias("slot", "shard"))
    return rows.select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return (number % size).cast("int")


def placed(
    df: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, size: int | None = None
) -> DataFrame:
    """``(key, slot, shard)`` for every row."""
    owner = table(names(shards), size)
    rows = df.select(F.col(key_col).alias(key_col), slot_of(F.col(key_col), len(owner)).alias("slot"))
    return rows.join(F.broadcast(lookup(df.sparkSession, owner)), "slot").select(key_col, "slot", "shard")


def write(
    df: DataFrame, path: str, key_col: str = "doc_id", shards: int = SHARDS, size: int | None = None,
    files: int = 1,
) -> None:
    """``df`` as Parquet, a folder per shard with ``files`` files at most, keys spread over
    them by slot."""
    owner = table(names(shards), size)
    own = "shard"
    while own in df.columns:
        own += "_"
    cells = lookup(df.sparkSession, owner).select(F.col("slot").alias(own + "s"), F.col("shard").alias(own))
    rows = df.join(F.broadcast(cells), slot_of(F.col(key_col), len(owner)) == F.col(own + "s"))
    part = F.pmod(F.col(own + "s"), files)
    rows.repartition(shards * files, own, part).drop(own + "s").write.partitionBy(own).parquet(path)
