"""Streams over files that arrive in several micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from shelfscope.operators import sessions, store
from shelfscope.session import work_path
from shelfscope.sources import sinks
from shelfscope.streaming import streams
from shelfscope.views import view

NOW = dt.datetime(2024, 1, 31)


def files(spark, df, name, n):
    """``df`` as ``n`` Parquet files in arrival order."""
    path = work_path(spark, name)
    for i in range(n):
        df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def test_merge_in_several_batches(spark, sf_dir):
    products, batch = view(spark, sf_dir, "products"), view(spark, sf_dir, "product_batch")
    arriving = work_path(spark, "arriving")
    # later versions arrive later
    batch.filter("seq < 1000000000").coalesce(1).write.mode("append").parquet(arriving)
    batch.filter("seq >= 1000000000").coalesce(1).write.mode("append").parquet(arriving)
    table = work_path(spark, "table")
    sinks.write_products(products, table, buckets=4)
    stream = streams.file_stream(spark, arriving, batch.schema, files_per_trigger=1)
    query = streams.stream_merge_products(stream, table, NOW, work_path(spark, "o"), buckets=4)
    query.awaitTermination()
    assert len(query.recentProgress) >= 2
    columns = ["url", "title", "price", "rating", "created_at"]
    got = spark.read.parquet(table).select(*columns)
    want = store.merge_products(products, batch, NOW).select(*columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ids = spark.read.parquet(table).agg(F.count("id"), F.count_distinct("id")).first()
    assert ids[0] == ids[1]


def keyed_once(added):
    keyed = added.filter("review_id is not null")
    assert keyed.count() == keyed.select("review_id").distinct().count()
    ids = added.agg(F.count("id"), F.count_distinct("id")).first()
    assert ids[0] == ids[1]


def test_reviews_of_two_streams(spark, sf_dir):
    """A second stream with its own checkpoint and other files leaves the first one's rows."""
    reviews, batch = view(spark, sf_dir, "reviews"), view(spark, sf_dir, "review_batch")
    table = work_path(spark, "table")
    streams.write_reviews(reviews, table, buckets=4)

    def run(rows, n):
        stream = streams.file_stream(spark, files(spark, rows, "arriving", n), batch.schema, files_per_trigger=1)
        streams.stream_new_reviews(stream, table, NOW, work_path(spark, "o"), buckets=4).awaitTermination()
        return streams.read_reviews(spark, table).filter("batch_id >= 0")

    first, second = batch.filter("product_id % 2 = 0"), batch.filter("product_id % 2 = 1")
    added = run(first, 3)
    before = {tuple(r) for r in added.select("id", "review_id", "body").collect()}
    assert len(before) == store.new_reviews(reviews, first, NOW).count()
    added = run(second, 2)
    after = {tuple(r) for r in added.select("id", "review_id", "body").collect()}
    assert before < after and len(after) == store.new_reviews(reviews, batch, NOW).count()
    keyed_once(added)
    target = work_path(spark, "compact")
    streams.compact_reviews(spark, table, target)
    assert streams.read_reviews(spark, target).count() == streams.read_reviews(spark, table).count()


def test_a_replayed_micro_batch_changes_nothing(spark, sf_dir):
    reviews, batch = view(spark, sf_dir, "reviews"), view(spark, sf_dir, "review_batch")
    table = work_path(spark, "table")
    streams.write_reviews(reviews, table, buckets=4)
    for _ in range(2):
        streams.append_batch(batch, 0, "s", table, NOW, buckets=4)
        added = streams.read_reviews(spark, table).filter("batch_id >= 0")
        assert added.count() == store.new_reviews(reviews, batch, NOW).count()
    streams.append_batch(batch.filter("review_id is not null"), 1, "s", table, NOW, buckets=4)
    keyed_once(streams.read_reviews(spark, table).filter("batch_id >= 0"))


def test_products_without_url_are_inserted_once(spark, sf_dir):
    products, batch = view(spark, sf_dir, "products"), view(spark, sf_dir, "product_batch")
    table = work_path(spark, "table")
    sinks.write_products(products, table, buckets=4)
    rows = batch.limit(6).withColumn("url", F.when(F.col("seq") % 2 == 0, F.col("url")))
    none = rows.filter("url is null").count()
    for _ in range(2):
        sinks.upsert_products(spark, table, rows, NOW, buckets=4)
        assert spark.read.parquet(table).filter("url is null").count() == none > 0


def test_daily_totals_in_several_batches(spark, sf_dir):
    metrics = view(spark, sf_dir, "scraping_analytics")
    arriving = files(spark, metrics, "arriving", 3)
    stream = streams.daily_activity(streams.file_stream(spark, arriving, metrics.schema, 1))
    path = work_path(spark, "totals")
    streams.stream_totals(stream, path, work_path(spark, "o")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    want = sessions.recent_activity(metrics, dt.date(2024, 1, 31), days=60)
    assert got == sorted(tuple(r) for r in want.collect())


def test_append_mode_leaves_open_days_out(spark, sf_dir):
    metrics = view(spark, sf_dir, "scraping_analytics")
    arriving = files(spark, metrics, "arriving", 1)
    stream = streams.daily_activity(streams.file_stream(spark, arriving, metrics.schema, 1))
    path = work_path(spark, "totals")
    streams.stream_totals(stream, path, work_path(spark, "o"), mode="append").awaitTermination()
    days = [r["date"] for r in spark.read.parquet(path).collect()]
    assert len(days) == len(set(days)) == 28


def test_a_micro_batch_is_stored_once_before_its_numbers(spark, sf_dir, monkeypatch):
    reviews, batch = view(spark, sf_dir, "reviews"), view(spark, sf_dir, "review_batch")
    table, names = work_path(spark, "table"), []
    inner = streams.stored
    monkeypatch.setattr(streams, "stored", lambda df, *more: (names.append(more), inner(df, *more))[1])
    streams.write_reviews(reviews, table, buckets=4)
    streams.append_batch(batch, 0, "s", table, NOW, buckets=4)
    assert names == [("review-batch", "zstd")]
    keyed_once(streams.read_reviews(spark, table).filter("batch_id >= 0"))
