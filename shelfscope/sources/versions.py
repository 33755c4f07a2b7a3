"""Tables in versions: immutable Parquet folders, and one small commit file per version.

A version is written in two steps: its rows into a folder of their own, then the commit file
``commits/<number>``, which lists the folders that make up the table. A reader follows the
last commit, or any earlier one; a writer that stops between the steps leaves a folder that
nobody reads. A commit file is created and never overwritten, so of two writers of one number
one fails and loses nothing but its folder (on a store whose create is not exclusive, let one
writer at a time commit).

A version may be a base and changes: rows that replace or add to those with their key, and
keys that are gone. Reading merges them, the last change of a key winning; ``compact``
writes the merged rows as a new base.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfscope.session import _file_system


def _commits(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _file_system(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def last_version(spark: SparkSession, path: str) -> int:
    """The number of the last committed version, 0 if there is none."""
    return max(_commits(spark, path), default=0)


def _folders(spark: SparkSession, path: str, version: int) -> dict:
    text = spark.read.text(f"{path.rstrip('/')}/commits/{version:012d}", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, version: int, folders: dict) -> None:
    fs, target = _file_system(spark, f"{path.rstrip('/')}/commits/{version:012d}")
    out = fs.create(target, False)  # fails if the version is there already
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()


def write_folder(df: DataFrame, path: str) -> str:
    """First step: the rows in a folder of their own, named relative to the table."""
    name = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}", compression="zstd")
    return name


def replace(df: DataFrame, path: str) -> int:
    """Replace all rows in one step: the table is the old or the new one, never less. The
    frame may read the table itself. Returns the version."""
    spark = df.sparkSession
    version = last_version(spark, path) + 1
    _commit(spark, path, version, {"base": write_folder(df, path), "changes": []})
    return version


def change(path: str, rows: DataFrame, key: str, gone: DataFrame | None = None) -> int:
    """Add or replace ``rows`` by ``key`` (one row per key) and delete the keys of ``gone``,
    writing the changes only. Returns the version."""
    spark = rows.sparkSession
    version = last_version(spark, path) + 1
    folders = _folders(spark, path, version - 1)
    changes = rows.withColumn("_gone", F.lit(False))
    if gone is not None:
        lost = gone.select(key).distinct().join(rows.select(key), key, "left_anti")
        changes = changes.unionByName(lost.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    folders["changes"].append({"folder": write_folder(changes, path), "key": key})
    _commit(spark, path, version, folders)
    return version


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last."""
    root = path.rstrip("/")
    folders = _folders(spark, path, last_version(spark, path) if version is None else version)
    base = spark.read.parquet(f"{root}/{folders['base']}")
    if not folders["changes"]:
        return base
    key = folders["changes"][0]["key"]
    parts = [
        spark.read.parquet(f"{root}/{c['folder']}").withColumn("_nr", F.lit(i))
        for i, c in enumerate(folders["changes"])
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    last = Window.partitionBy(key).orderBy(F.desc("_nr"))
    latest = every.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1")
    kept = base.join(latest.select(key), key, "left_anti").select(base.columns)
    return kept.unionByName(latest.filter("not _gone").select(base.columns))


def compact(spark: SparkSession, path: str) -> int:
    """The last version's rows as a new version without changes."""
    return replace(read(spark, path), path)
