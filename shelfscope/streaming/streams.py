"""The store's incremental writes as streams.

Every job runs with ``availableNow`` (all data present, then stop) unless another
trigger is given, so a stream over files equals the batch result. All sinks are
idempotent: a micro-batch that is replayed after a failure leaves the same table.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators import store as store_ops
from shelfscope.operators.histogram import folded, histogram_changes
from shelfscope.operators.numbering import number_rows
from shelfscope.session import durable, exists, stored
from shelfscope.sources import sinks


def file_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of Parquet files arriving in ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_merge_products(
    batches: DataFrame,
    path: str,
    as_of: dt.datetime,
    checkpoint: str,
    order: str = "seq",
    buckets: int = 1024,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Upsert crawled products into a table written by ``sinks.write_products``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sinks.upsert_products(batch.sparkSession, path, batch, as_of, order, buckets)

    return _start(batches.writeStream.foreachBatch(merge), checkpoint, trigger)


def _review_bucket(buckets: int):
    """Keyed reviews by key, the others by content."""
    keyed = F.nullif("review_id", F.lit(""))
    content = F.xxhash64("product_id", "reviewer_name", "title", "body").cast("string")
    key = F.xxhash64(F.coalesce(keyed, content))
    return F.pmod(key, F.lit(buckets)).cast("int").alias("review_bucket")


_FOLDERS = ("review_bucket", "stream_id", "batch_id")


def write_reviews(reviews: DataFrame, path: str, buckets: int = 64) -> None:
    """A review table laid out for appending streams: folders by hash bucket of the review
    key, then by stream and micro-batch."""
    placed = reviews.select("*", _review_bucket(buckets)).hint("rebalance", F.col("review_bucket"))
    # what is the same for all rows comes after the shuffle
    (
        placed.select("*", F.lit("base").alias("stream_id"), F.lit(-1).cast("bigint").alias("batch_id"))
        .write.mode("overwrite").partitionBy(*_FOLDERS).parquet(path, compression="zstd")
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """The table with ``stream_id`` as text, whatever the folder names look like."""
    inner = spark.read.parquet(path).schema
    types = {"review_bucket": "int", "stream_id": "string", "batch_id": "bigint"}
    columns = [f"`{f.name}` {types.get(f.name, f.dataType.simpleString())}" for f in inner]
    return spark.read.schema(", ".join(columns)).parquet(path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that owns ``checkpoint``, kept beside it."""
    path = f"{checkpoint.rstrip('/')}_stream_id"
    if not exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def append_batch(
    batch: DataFrame, batch_id: int, stream: str, path: str, as_of: dt.datetime,
    order: str = "seq", buckets: int = 64,
) -> None:
    """Append one micro-batch's unseen reviews to a table of ``write_reviews``.

    The batch is compared with the rows of all other micro-batches, of this stream and of
    others, in the buckets it touches, and replaces its own folders: a replay neither
    drops rows nor repeats them, and nobody else's rows are touched.
    """
    spark = batch.sparkSession
    rows = stored(batch.select("*", _review_bucket(buckets)), "review-batch", "zstd")
    # at most ``buckets`` numbers
    touched = [r[0] for r in rows.select("review_bucket").distinct().collect()]
    own = (F.col("stream_id") == stream) & (F.col("batch_id") == batch_id)
    others = (
        read_reviews(spark, path).filter(F.col("review_bucket").isin(touched) & ~own).drop(*_FOLDERS)
    )
    fresh = store_ops.new_reviews(others, rows.drop("review_bucket"), as_of, order)
    top = durable(sinks.top_id(spark, path))
    numbered = number_rows(fresh, after=top)
    sinks.note_top(numbered, path, top)
    # the numbered rows are stored by now: the folders replaced are not read
    placed = numbered.select("*", _review_bucket(buckets)).hint("rebalance", F.col("review_bucket"))
    (
        placed.select("*", F.lit(stream).alias("stream_id"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_FOLDERS).parquet(path, compression="zstd")
    )


def compact_reviews(spark: SparkSession, path: str, target: str) -> None:
    """The table's rows in few files, in the layout of ``write_reviews``, at ``target``."""
    rows = read_reviews(spark, path)
    rows = rows.withColumn("stream_id", F.lit("base")).withColumn("batch_id", F.lit(-1).cast("bigint"))
    rows.hint("rebalance", F.col("review_bucket")).write.partitionBy(*_FOLDERS).parquet(target)
    sinks.note_top(rows, target, sinks.top_id(spark, path))


def stream_new_reviews(
    batches: DataFrame,
    path: str,
    as_of: dt.datetime,
    checkpoint: str,
    order: str = "seq",
    buckets: int = 64,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append unseen reviews to a table written by ``write_reviews`` with as many buckets.

    Duplicates at any distance are found in the table itself; no state grows with the
    stream. Any number of streams, one after the other, may write to one table.
    """
    stream = stream_id(batches.sparkSession, checkpoint)

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, stream, path, as_of, order, buckets)

    return _start(batches.writeStream.foreachBatch(append), checkpoint, trigger)


def append_rating_changes(batch: DataFrame, batch_id: int, stream: str, path: str) -> None:
    """Keep the rating changes of one micro-batch, ``(before, after)`` pairs of structs with
    ``category`` and ``rating``, in a folder of its own: a replay writes the same folder again."""
    before, after = (batch.filter(f"{side} is not null").select(f"{side}.*") for side in ("before", "after"))
    changes = histogram_changes(before, after)
    changes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/changes/{stream}-{batch_id:09d}")


def stream_rating_changes(
    batches: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep a stored rating histogram at the state of the products: every row of the stream is
    an insert (``before`` null), an update or a delete (``after`` null). The products are not
    read again."""
    stream = stream_id(batches.sparkSession, checkpoint)

    def append(batch: DataFrame, batch_id: int) -> None:
        append_rating_changes(batch, batch_id, stream, path)

    return _start(batches.writeStream.foreachBatch(append), checkpoint, trigger)


def write_histogram(hist: DataFrame, path: str) -> None:
    """The histogram that ``stream_rating_changes`` starts from."""
    hist.write.parquet(f"{path.rstrip('/')}/base")


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """The stored histogram with all changes added."""
    root = path.rstrip("/")
    hist = spark.read.parquet(f"{root}/base")
    if exists(spark, f"{root}/changes"):
        hist = hist.unionByName(spark.read.schema(hist.schema).parquet(f"{root}/changes/*"))
    return folded(hist)


def _replace(path: str):
    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(path)

    return write


def daily_activity(metrics: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Sessions and reviews per day of a metrics stream (tumbling windows)."""
    return (
        metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day").alias("w"))
        .agg(F.count("*").alias("sessions"), F.sum("total_reviews").alias("reviews"))
        .select(F.to_date("w.start").alias("date"), "sessions", "reviews")
    )


def success_rate(sessions: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Share of successful sessions per day and method of a session stream."""
    return (
        sessions.withColumn("created_at", F.col("created_at").cast("timestamp"))
        .withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", "1 day").alias("w"), "method_used")
        .agg(
            F.count("*").alias("sessions"),
            F.avg(F.when(F.col("success"), 100.0).otherwise(0.0)).alias("success_rate"),
        )
        .select(F.to_date("w.start").alias("date"), "method_used", "sessions", "success_rate")
    )


def stream_totals(
    totals: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "complete",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep ``path`` at the current totals of a windowed aggregate.

    ``complete`` rewrites all days after each micro-batch (the result has one row per
    day and key); ``append`` writes each day once, when the watermark closes it.
    """
    if mode == "append":
        writer = totals.writeStream.outputMode("append").format("parquet").option("path", path)
    else:
        writer = totals.writeStream.outputMode("complete").foreachBatch(_replace(path))
    return _start(writer, checkpoint, trigger)
