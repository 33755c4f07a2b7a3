"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are applied in order. Each stage gets the documents that its predecessor kept, as
Parquet, and its decisions take effect: rejected documents go, failing lines and secrets leave
the texts (with ``n_chars`` following), one document of each near-duplicate group stays. All
stages but the last return the columns of the documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscope.llm import decontaminate, linerules, neardup, packing, secrets, simhash
from shelfscope.session import work_path


def _chars(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without the lines that failed."""
    return linerules.cleaned(docs, chars_col=_chars(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. The SimHash step of ``op3_simhash_dedup`` names
    the first candidates, MinHash bands those that differ in more bits; of all of them, texts with
    a similarity of five words of 0.8 or more are near copies."""
    return neardup.keep_one(docs, simhash_radius=simhash.RADIUS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redacted(docs, chars_col=_chars(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in a sequence."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
#: Fingerprints and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
