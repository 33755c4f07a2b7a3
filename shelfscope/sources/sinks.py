"""Writing results and keeping stored tables current."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfscope.operators import sessions as sessions_ops, store as store_ops
from shelfscope.session import durable, exists, folders, remove, stored
from shelfscope.sources import versions


def replace_table(df: DataFrame, path: str) -> int:
    """Replace all rows of a table in one step (``versions``); ``versions.read`` reads it."""
    return versions.replace(df, path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _bucketed(products: DataFrame, buckets: int) -> DataFrame:
    """Products without a URL are spread by their content."""
    content = F.xxhash64(*store_ops.UPDATED_FIELDS).cast("string")
    key = F.xxhash64(F.coalesce("url", content))
    return products.withColumn("url_bucket", F.pmod(key, F.lit(buckets)).cast("int"))


def top_id(spark: SparkSession, path: str) -> DataFrame:
    """One row: the largest id given out for the table at ``path``.

    Ids are noted beside the table (``note_top``), so the table itself is read only before
    the first note.
    """
    notes = f"{path.rstrip('/')}_top"
    if exists(spark, notes):
        return spark.read.parquet(notes).agg(F.max("top").alias("top"))
    return spark.read.parquet(path).agg(F.max("id").alias("top"))


def note_top(rows: DataFrame, path: str, before: DataFrame) -> None:
    """Note the largest id of ``rows`` or of ``before`` (one row, ``top``); written before
    the rows, so no id is given twice."""
    own = rows.agg(F.max("id").alias("own")).crossJoin(F.broadcast(before))
    top = own.select(F.greatest("own", "top").cast("bigint").alias("top"))
    top.filter("top is not null").coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}_top")


def _write_buckets(products: DataFrame, path: str, mode: str) -> None:
    """One folder per bucket, with a bloom filter of ids and URLs in every file. The
    rebalance hint lets AQE join small buckets into one task and split large ones over several,
    so file sizes do not depend on the number of buckets."""
    (
        products.hint("rebalance", F.col("url_bucket"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .option("parquet.bloom.filter.enabled#url", "true")
        .option("parquet.bloom.filter.enabled#id", "true")
        .partitionBy("url_bucket")
        .parquet(path)
    )


def stored_product_by_url(spark: SparkSession, path: str, url: str, buckets: int = 1024) -> DataFrame:
    """The product of a URL from a table of ``write_products``: only the URL's bucket is
    listed and opened, and its files' bloom filters say which may hold it."""
    bucket = F.pmod(F.xxhash64(F.lit(url)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).filter((F.col("url_bucket") == bucket) & (F.col("url") == url)).drop("url_bucket")


def stored_product_by_id(spark: SparkSession, path: str, product_id: int) -> DataFrame:
    """The product of an id: files are passed over by the bloom filters of ids."""
    return spark.read.parquet(path).filter(F.col("id") == product_id).drop("url_bucket")


def _product_bucket(product_id, buckets: int):
    return F.pmod(F.xxhash64(product_id.cast("bigint")), F.lit(buckets)).cast("int")


def write_reviews_of_products(reviews: DataFrame, path: str, buckets: int = 1024) -> None:
    """A copy of the reviews laid out for look-ups by product: one folder per hash bucket
    of ``product_id``, rows in its order inside a file."""
    (
        reviews.withColumn("product_bucket", _product_bucket(F.col("product_id"), buckets))
        .hint("rebalance", F.col("product_bucket"))
        .sortWithinPartitions("product_bucket", "product_id")
        .write.mode("overwrite").option("parquet.bloom.filter.enabled#product_id", "true")
        .partitionBy("product_bucket").parquet(path)
    )


def stored_reviews_of(spark: SparkSession, path: str, product_id: int, buckets: int = 1024) -> DataFrame:
    """The reviews of a product from a table of ``write_reviews_of_products``: one bucket is
    read."""
    bucket = _product_bucket(F.lit(product_id), buckets)
    own = (F.col("product_bucket") == bucket) & (F.col("product_id") == product_id)
    return spark.read.parquet(path).filter(own).drop("product_bucket")


def write_products(products: DataFrame, path: str, buckets: int = 1024) -> None:
    """A product table laid out for merging: one folder per hash bucket of ``url``."""
    _write_buckets(_bucketed(products, buckets), path, "static")


def upsert_products(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    as_of: dt.datetime,
    order: str = "seq",
    buckets: int = 1024,
) -> None:
    """Merge a crawl batch into a table written by ``write_products``.

    Only the buckets the batch touches are read and rewritten. Their list is at most
    ``buckets`` numbers, so collecting it is safe. The merged rows are stored first: the
    folders read are the folders replaced. Rows without a URL are told apart by their
    content: those already in the table are not inserted again, so a batch may be replayed.
    """
    keyed = stored(_bucketed(batch, buckets), "batch")
    touched = [r[0] for r in keyed.select("url_bucket").distinct().collect()]
    part = spark.read.parquet(path).filter(F.col("url_bucket").isin(touched)).drop("url_bucket")
    same = list(store_ops.UPDATED_FIELDS)
    known = part.filter("url is null").select(F.xxhash64(*same).alias("_content")).distinct()
    rows = keyed.drop("url_bucket").withColumn(
        "_content", F.when(F.col("url").isNull(), F.xxhash64(*same))
    )
    rows = rows.join(known, "_content", "left_anti").drop("_content")
    updated, inserted = store_ops.split_product_merge(part, rows, as_of, order)
    top = durable(top_id(spark, path))
    numbered = store_ops.number_rows(inserted, ["first_seq"], after=top)
    note_top(numbered, path, top)
    merged = stored(_bucketed(updated.unionByName(numbered.drop("first_seq")), buckets), "merged")
    _write_buckets(merged, path, "dynamic")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A session table with one folder per day; sessions without a time are one folder."""
    (
        sessions.withColumn("day", F.to_date("created_at"))
        .hint("rebalance", F.col("day"))
        .write.mode("overwrite").partitionBy("day").parquet(path)
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("day")


def expire_stored_sessions(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    """Drop sessions older than ``days`` before ``as_of`` from a table of ``write_sessions``.

    Whole days go as folders, unread; only the day of the limit is read and rewritten. Returns
    the folders removed. May be run again after a failure.
    """
    limit = as_of - dt.timedelta(days=days)
    root = path.rstrip("/")
    last = f"day={limit.date().isoformat()}"
    names = folders(spark, root)
    gone = sorted(n for n in names if n.startswith("day=2") and n < last or n.startswith("day=1"))
    if last in names:
        rows = spark.read.parquet(root).filter(F.col("day") == F.lit(limit.date()))
        kept = stored(sessions_ops.expire_sessions(rows, as_of, days), "sessions")
        if kept.isEmpty():
            gone.append(last)
        else:
            (
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("day").parquet(root)
            )
    for name in gone:
        remove(spark, f"{root}/{name}")
    return gone


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, order: tuple[str, ...], column: str = "text") -> None:
    """Report lines as text files in order; a short report is a single file."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(path)


def export_analysis(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Category statistics and rating distribution as CSV, the rest as JSON."""
    written = {}
    for name, df in results.items():
        path = f"{folder}/{name}"
        (write_csv if name in ("category_stats", "rating_distribution") else write_json)(df, path)
        written[name] = path
    return written
