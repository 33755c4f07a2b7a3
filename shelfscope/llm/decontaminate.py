"""Benchmark decontamination: MinHash containment search, then exact containment.

Words are runs of letters and digits, lower-cased; shingles have ``WIDTH`` words. An item is
found in a document if ``PERCENT`` of the item's distinct shingles or more are in it.

Search. Items are partitioned by size (powers of two of their distinct shingles). The MinHash
sketch of an item is its bottom k shingle hashes, k taken from the largest size of its
partition: one more than the shingles that may be missing. A document that contains the item
must then hold one of the k, however long it is, so that no window or tuning can lose it.
Documents with fewer windows than an item needs skip it. Document shingles meet the sketches in
a join on the hash inside the scan's stage; only the (document, item) candidates are shuffled.

Verification. The candidate documents are read again, their shingles are joined with the
items' shingles on the text itself, and distinct ones are counted.

Sketches and item shingles are broadcast only while their counted rows stay below
``common.BROADCAST_ROWS``; beyond that the joins are shuffled. Everything is DataFrame code.

Null text, and texts or items of fewer than ``WIDTH`` words, have no shingle: they are never
found and find nothing. A null item or document id is a value like any other. Rows that repeat
an id and a text give one result; equal ids with different texts are judged apart. Empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.llm.common import small_side
from shelfscope.session import durable

WIDTH = 5
PERCENT = 80


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _windows(df: DataFrame, keys: list[str], width: int, with_text: bool) -> DataFrame:
    """``keys``, number of windows ``size``, hash ``h`` (and text ``s``) of each window."""
    at = [F.get("words", F.col("i") + k if k else F.col("i")) for k in range(width)]
    rows = (
        df.withColumn("size", F.size("words") - (width - 1))
        .filter("size > 0")
        .select(*keys, "size", "words", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    )
    text = [F.concat_ws(" ", *at).alias("s")] if with_text else []
    return rows.select(*keys, "size", F.xxhash64(*at).alias("h"), *text)


def _keyed(df: DataFrame, id_col: str, text_col: str, key: str, name: str) -> DataFrame:
    id_, text = F.col(id_col), F.col(text_col)
    return df.select(
        F.xxhash64(id_, text).alias(key), id_.alias(name), words(text).alias("words")
    )


def needed(n: Column, percent: int) -> Column:
    """The least number of an item's ``n`` shingles that must be there."""
    return F.greatest(F.lit(1), F.ceil(n * percent / 100)).cast("int")


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """``(dk, doc, item, n_shared, n_item)``: ``dk`` is a hash of the row's id and text."""
    own = _keyed(items, item_col, item_text, "ik", "item")
    shingles = durable(_windows(own, ["ik", "item"], width, True).drop("size").distinct())
    sized = shingles.groupBy("ik").agg(F.count("*").cast("int").alias("n"))
    sized = sized.withColumn("part", F.floor(F.log2("n")))
    top = sized.groupBy("part").agg(F.max("n").alias("top"))
    sized = sized.join(top, "part").select(
        "ik", "n", needed(F.col("n"), percent).alias("need"),
        (F.col("top") - needed(F.col("top"), percent) + 1).alias("k"),
    )
    sized = durable(sized)
    order = Window.partitionBy("ik").orderBy("h")
    least = shingles.select("ik", "h").distinct().withColumn("at", F.row_number().over(order))
    sketch = durable(least.join(sized, "ik").filter("at <= k").select("h", "ik", "need"))

    texts = _keyed(docs, id_col, text_col, "dk", "doc")
    met = _windows(texts, ["dk"], width, False).join(small_side(sketch), "h")
    pairs = durable(met.filter("size >= need").select("dk", "ik").distinct())

    again = texts.join(small_side(durable(pairs.select("dk").distinct())), "dk", "left_semi")
    held = _windows(again, ["dk", "doc"], width, True).drop("size")
    both = held.join(small_side(shingles), ["h", "s"]).select("dk", "doc", "ik", "item", "s").distinct()
    shared = both.groupBy("dk", "doc", "ik", "item").agg(F.count("*").cast("int").alias("n_shared"))
    found = shared.join(pairs, ["dk", "ik"], "left_semi").join(small_side(sized), "ik")
    return found.filter("n_shared >= need").select("dk", "doc", "item", "n_shared", F.col("n").alias("n_item"))


def contaminated(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` for every item in a document."""
    return matches(docs, items, **options).select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        "n_shared",
        "n_item",
        (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def decontaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object
) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    found = matches(docs, items, id_col, text_col, **options)
    gone = durable(found.select(F.col("dk").alias("__dk")).distinct())
    same = F.xxhash64(docs[id_col], docs[text_col]) == gone["__dk"]
    return docs.join(small_side(gone), same, "left_anti")
