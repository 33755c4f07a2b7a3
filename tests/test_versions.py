"""Table versions, lookup layouts and the incrementally kept histogram."""

import pytest
from pyspark.sql import functions as F

from shelfscope.operators.category import category_stats
from shelfscope.operators.histogram import rating_histogram
from shelfscope.session import durable, exists, work_path
from shelfscope.sources import sinks, versions
from shelfscope.streaming import streams
from shelfscope.views import view


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_and_interrupted_writers(spark):
    path = work_path(spark, "table")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    assert versions.last_version(spark, path) == 0
    assert versions.replace(one, path) == 1
    # a writer stops between its data and its commit
    versions.write_folder(one.limit(0), path)
    assert rows(versions.read(spark, path)) == [(1, "a"), (2, "b")]
    # the new rows may come from the table itself
    assert versions.replace(versions.read(spark, path).withColumn("t", F.upper("t")), path) == 2
    assert rows(versions.read(spark, path)) == [(1, "A"), (2, "B")]
    assert rows(versions.read(spark, path, 1)) == [(1, "a"), (2, "b")]
    # a second writer of a number fails
    with pytest.raises(Exception, match="(?i)exist"):
        versions._commit(spark, path, 2, {"base": "x", "changes": []})
    assert rows(versions.read(spark, path)) == [(1, "A"), (2, "B")]


def test_changes_merge_on_read(spark):
    path, schema = work_path(spark, "table"), "id long, t string"
    versions.replace(spark.createDataFrame([(i, f"r{i}") for i in range(6)], schema), path)
    gone = spark.createDataFrame([(2,), (3,), (77,)], "id long")
    versions.change(path, spark.createDataFrame([(1, "x"), (3, "kept"), (9, "new")], schema), "id", gone)
    versions.change(path, spark.createDataFrame([(2, "back"), (9, "newer")], schema), "id", spark.createDataFrame([(0,)], "id long"))
    want = [(1, "x"), (2, "back"), (3, "kept"), (4, "r4"), (5, "r5"), (9, "newer")]
    assert rows(versions.read(spark, path)) == want
    assert rows(versions.read(spark, path, 2)) == [(0, "r0"), (1, "x"), (3, "kept"), (4, "r4"), (5, "r5"), (9, "new")]
    assert versions.compact(spark, path) == 4
    assert rows(versions.read(spark, path)) == want
    assert rows(versions.read(spark, path, 3)) == want


def files_read(df):
    """Files that the scan of an executed plan opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return leaves.apply(0).metrics().get("numFiles").get().value()


def test_lookups_read_one_bucket(spark, sf_dir):
    products, reviews = work_path(spark, "products"), work_path(spark, "reviews")
    sinks.write_products(view(spark, sf_dir, "products"), products, buckets=32)
    sinks.write_reviews_of_products(view(spark, sf_dir, "reviews"), reviews, buckets=32)
    every = files_read(spark.read.parquet(products))
    url = "https://shop.example/p/42"
    found = sinks.stored_product_by_url(spark, products, url, 32)
    assert rows(found.select("id")) == [(43,)] and files_read(found) == 1 < every
    assert sinks.stored_product_by_url(spark, products, "nowhere", 32).count() == 0
    assert rows(sinks.stored_product_by_id(spark, products, 43).select("url")) == [(url,)]
    own = sinks.stored_reviews_of(spark, reviews, 17, 32)
    assert rows(own.select("id")) == rows(view(spark, sf_dir, "reviews").filter("product_id = 17").select("id"))
    assert files_read(own) == 1


def test_histogram_follows_the_stream(spark):
    """Inserts, updates and deletes, a replayed micro-batch and a restarted stream."""
    path, arriving, offsets = (work_path(spark, n) for n in ("hist", "arriving", "offsets"))
    kind = "struct<category:string,rating:decimal(3,2)>"
    schema = f"before {kind}, after {kind}"

    def batch(*pairs):
        text = [tuple(None if x is None else {"category": x[0], "rating": x[1]} for x in p) for p in pairs]
        plain = "before struct<category:string,rating:double>, after struct<category:string,rating:double>"
        return spark.createDataFrame(text, plain).select(F.col("before").cast(kind), F.col("after").cast(kind))

    start = [("a", 4.0), ("a", 4.5), ("b", 1.0), (None, 2.0), ("b", None)]
    products = spark.createDataFrame(start, "category string, rating double")
    streams.write_histogram(rating_histogram(products), path)
    first = batch((None, ("a", 3.0)), (("a", 4.5), ("a", 5.0)), (("b", 1.0), None))
    first.write.mode("append").parquet(arriving)
    read = lambda: streams.file_stream(spark, arriving, schema)
    streams.stream_rating_changes(read(), path, offsets).awaitTermination()
    # the same micro-batch again: a crash after the write, before the commit of the stream
    streams.append_rating_changes(first, 0, streams.stream_id(spark, offsets), path)
    batch((("b", None), ("b", 2.5)), ((None, 2.0), ("a", 2.0))).write.mode("append").parquet(arriving)
    streams.stream_rating_changes(read(), path, offsets).awaitTermination()
    now = [("a", 4.0), ("a", 5.0), ("a", 3.0), ("b", 2.5), ("a", 2.0)]
    want = rating_histogram(spark.createDataFrame(now, "category string, rating double"))
    hist = durable(streams.read_histogram(spark, path))
    assert rows(hist) == rows(want)
    assert rows(category_stats(hist)) == rows(category_stats(want))


def test_expiry_reads_one_day(spark, monkeypatch):
    import datetime as dt

    path = work_path(spark, "sessions")
    now = dt.datetime(2024, 3, 31, 12)
    rows_ = [(i, now - dt.timedelta(hours=5 * i)) for i in range(400)] + [(1000, None), (1001, dt.datetime(1999, 1, 1))]
    df = spark.createDataFrame(rows_, "id long, created_at timestamp_ntz")
    sinks.write_sessions(df, path)
    read = []
    real = sinks.sessions_ops.expire_sessions
    monkeypatch.setattr(sinks.sessions_ops, "expire_sessions", lambda s, *a: read.append(s.select("day").distinct().count()) or real(s, *a))
    gone = sinks.expire_stored_sessions(spark, path, now, days=30)
    want = [r for r in rows_ if r[1] is None or r[1] >= now - dt.timedelta(days=30)]
    assert rows(sinks.read_sessions(spark, path)) == sorted(want, key=repr)
    assert len(gone) == len({r[1].date() for r in rows_ if r[1] and r[1].date() < dt.date(2024, 3, 1)})
    assert read == [1]
    # again: nothing more to drop
    assert sinks.expire_stored_sessions(spark, path, now, days=30) == []
    assert sinks.expire_stored_sessions(spark, path, now + dt.timedelta(days=400), days=1)
    assert rows(sinks.read_sessions(spark, path)) == [(1000, None)]
