"""Merges, numbering, pages and nested documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import imports, prices, quality, sessions, store
from shelfscope.operators.histogram import rating_histogram
from shelfscope.operators.numbering import number_rows
from shelfscope.schemas import METRICS, PRODUCTS, REVIEWS
from shelfscope.sources import sinks, tables
from shelfscope.session import work_path
from shelfscope.views import view

NOW = dt.datetime(2024, 5, 1)
OLD = dt.datetime(2024, 1, 1)
BATCH = (
    "title string, brand string, price double, rating double, review_count int, "
    "description string, url string, seq bigint"
)


def known(spark):
    return spark.createDataFrame(
        [(7, "a", "b", 1.0, 4.0, 3, "d", "u1", OLD, OLD, OLD), (9, "x", "b", 2.0, None, 3, "d", "u2", OLD, OLD, OLD)],
        PRODUCTS,
    )


def crawl(spark):
    return spark.createDataFrame(
        [
            ("a2", "b", 5.0, 4.0, 3, None, "u1", 1), ("a3", "b", 6.0, None, 3, None, "u1", 2),
            ("n", "b", 1.0, 4.0, 3, "d", "u9", 4), ("m", "b", 1.0, 4.0, 3, "d", "u8", 3),
            ("n2", "b", 1.5, 4.0, 3, "d", "u9", 5), ("none", "b", 1.0, 1.0, 1, "d", None, 6),
        ],
        BATCH,
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "url", "title", "price", "rating", "created_at", "updated_at").collect())


def test_merge(spark):
    got = {r["url"]: r for r in store.merge_products(known(spark), crawl(spark), NOW).collect()}
    assert got["u1"]["id"] == 7 and got["u1"]["title"] == "a3" and got["u1"]["rating"] is None
    assert got["u1"]["created_at"] == OLD and got["u1"]["updated_at"] == NOW
    assert got["u2"]["updated_at"] == OLD
    assert (got["u8"]["id"], got["u9"]["id"], got[None]["id"]) == (10, 11, 12)
    assert got["u9"]["title"] == "n2"


def test_merge_twice_is_merge_once(spark):
    batch = crawl(spark).filter(F.col("url").isNotNull())
    once = store.merge_products(known(spark), batch, NOW)
    assert rows(store.merge_products(once, batch, NOW)) == rows(once)


def test_upsert_table_rewrites_touched_buckets(spark):
    path = work_path(spark, "upsert")
    sinks.write_products(known(spark), path, buckets=4)
    sinks.upsert_products(spark, path, crawl(spark), NOW, buckets=4)
    stored = spark.read.parquet(path).drop("url_bucket")
    assert rows(stored.filter("url is not null")) == rows(
        store.merge_products(known(spark), crawl(spark), NOW).filter("url is not null")
    )


def test_new_reviews(spark):
    stored = spark.createDataFrame([], REVIEWS).unionByName(
        spark.createDataFrame(
            [(1, 1, "n", 4.0, "t", "b", OLD, False, 0, "k1", "u", OLD, OLD)], REVIEWS
        )
    )
    batch = spark.createDataFrame(
        [
            (1, "n", 4.0, "t", "b", "2024-01-02", True, "k1", "u", 1),
            (1, "n", 4.0, "t", "first", "2024-01-02T03:04:05Z", None, "k2", "u", 2),
            (1, "n", 4.0, "t", "again", "2024-01-02", True, "k2", "u", 3),
            (1, "n", 4.0, "t", "nokey", "soon", True, None, "u", 4),
            (1, "n", 4.0, "t", "nokey", "2024-02-30", True, None, "u", 5),
        ],
        "product_id bigint, reviewer_name string, rating double, title string, body string, "
        "date string, verified_purchase boolean, review_id string, product_url string, seq bigint",
    )
    got = store.new_reviews(stored, batch, NOW).collect()
    assert sorted((r["review_id"] or "", r["body"]) for r in got) == [
        ("", "nokey"), ("", "nokey"), ("k2", "first"),
    ]
    first = next(r for r in got if r["review_id"] == "k2")
    assert first["review_date"] == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert first["verified_purchase"] is False and first["helpful_count"] == 0
    merged = store.append_reviews(stored, batch, NOW)
    assert sorted(r["id"] for r in merged.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbering_is_consecutive_and_ordered(spark, partitions):
    df = spark.range(0, 1000, 1, partitions).select((F.col("id") * 7919 % 1000).alias("k"))
    got = number_rows(df, ["k"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))
    assert [r["k"] for r in got] == list(range(1000))
    loose = number_rows(df).select("id").distinct()
    assert loose.count() == 1000 and loose.agg(F.max("id")).first()[0] == 1000


def test_numbering_of_nothing(spark):
    assert number_rows(spark.range(0).toDF("k"), ["k"]).count() == 0


def test_nested_documents_hold_every_review(spark, sf_dir):
    products, reviews = view(spark, sf_dir, "products"), view(spark, sf_dir, "reviews")
    whole = store.products_nested(products, reviews)
    split = store.products_nested(products, reviews, per_document=10)
    total = reviews.count()
    for docs in (whole, split):
        assert docs.agg(F.sum(F.size("reviews"))).first()[0] == total
        assert docs.select("id").distinct().count() == products.count()
    assert split.agg(F.max("part")).first()[0] > 0
    assert split.agg(F.max(F.size("reviews"))).first()[0] < 30
    empty = whole.filter("id > 500000000").select(F.size("reviews").alias("n")).distinct().collect()
    assert [r["n"] for r in empty] == [0]


def test_one_product_with_most_reviews(spark):
    """A hot key: documents stay near the limit and nothing is lost."""
    products = known(spark)
    reviews = spark.range(0, 3000, 1, 8).select(
        "id", F.lit(7).cast("bigint").alias("product_id"), F.lit("n").alias("reviewer_name"),
        F.lit(3.0).alias("rating"), F.lit("t").alias("title"), F.lit("b").alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("review_date"), F.lit(True).alias("verified_purchase"),
    )
    docs = store.products_nested(products, reviews, per_document=100)
    sizes = [r[0] for r in docs.filter("id = 7").select(F.size("reviews")).collect()]
    assert sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) < 160


def test_pages_follow_each_other(spark, sf_dir):
    products = view(spark, sf_dir, "products")
    first = store.products_page(products, limit=20, offset=0).orderBy(F.desc("created_at"), "id").collect()
    second = store.products_page(products, limit=20, offset=20).orderBy(F.desc("created_at"), "id").collect()
    after = store.products_after(products, first[-1]["created_at"], first[-1]["id"], limit=20)
    assert [r["id"] for r in after.collect()] == [r["id"] for r in second]
    assert first[0]["total"] == products.count() and first[0]["has_more"]


def test_store_stats_of_an_empty_store(spark):
    empty = store.store_stats(
        known(spark).limit(0), spark.createDataFrame([], REVIEWS),
        spark.createDataFrame([], "success boolean"),
    ).first()
    assert empty["total_products"] == 0 and empty["average_review_rating"] is None
    assert empty["scraping_success_rate"] is None


def test_zero_success_rate_is_zero(spark):
    row = store.store_stats(
        known(spark), spark.createDataFrame([], REVIEWS),
        spark.createDataFrame([(False,)], "success boolean"),
    ).first()
    assert row["scraping_success_rate"] == 0.0


def test_metrics_of_nothing(spark):
    row = sessions.session_totals(spark.createDataFrame([], METRICS)).first()
    assert (row["total_sessions"], row["avg_time"], row["total_reviews"]) == (0, 0.0, 0)


def test_expiry_keeps_the_limit_day(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 4, 1)), (2, dt.datetime(2024, 3, 31, 23, 59)), (3, None)],
        "id bigint, created_at timestamp_ntz",
    )
    kept = sessions.expire_sessions(df, NOW, days=30)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]


def test_null_ids_stay_in_products_with_several_parts(spark):
    products = spark.createDataFrame([(1, "p")], "id long, title string")
    columns = "id long, product_id long, reviewer_name string, rating double, title string, body string, review_date timestamp, verified_purchase boolean"
    rows = [(None if i % 9 == 4 else i, 1, "n", 4.0, f"t{i}", "b", dt.datetime(2024, 1, 1 + i % 3), True) for i in range(25)]
    reviews = spark.createDataFrame(rows, columns)
    for size in (100, 7):
        got = store.products_nested(products, reviews, per_document=size).collect()
        assert sorted(r["title"] for row in got for r in row["reviews"]) == sorted(r[4] for r in rows)


def test_pages_go_on_past_the_dated_rows(spark):
    rows = [(i, None if i % 3 == 0 else dt.datetime(2024, 1, 1 + i % 4)) for i in range(1, 41)]
    products = spark.createDataFrame(rows, "id long, created_at timestamp_ntz")
    seen, last = [], None
    page = store.products_page(products, limit=7).select("id", "created_at").collect()
    while page:
        seen += [r["id"] for r in page]
        last = page[-1]
        page = store.products_after(products, last["created_at"], last["id"], limit=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -r[1].timestamp() if r[1] else 0, r[0]))
    assert seen == [r[0] for r in want]


def test_last_of_repeated_incoming_ids_wins(spark):
    schema = "id long, title string"
    held = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], schema)
    batch = spark.createDataFrame([(1, "late", 9), (1, "early", 2), (3, "x", 1), (None, "m", 1), (None, "m", 2)], schema + ", seq int")
    got = imports.replace_by_id(held, batch, "seq").collect()
    assert sorted(got, key=repr) == sorted([(1, "late"), (2, "b"), (3, "x"), (None, "n"), (None, "m"), (None, "m")], key=repr)
    assert imports.replace_by_id(held, batch.drop("seq")).filter("id = 1").collect() == [(1, "late")]


def test_first_review_of_a_key_by_place(spark):
    columns = "seq long, product_id long, reviewer_name string, rating double, title string, body string, date string, verified_purchase boolean, review_id string, product_url string"
    batch = spark.createDataFrame(
        [(3, 1, "c", 1.0, "t3", "b", None, True, "k", "u"), (1, 1, "a", 2.0, "t1", "b", None, None, "k", "u"),
         (1, 1, "a", 2.0, "t1", "b", None, None, "k", "u"), (2, 1, "x", 2.0, "t", "b", None, None, "old", "u"),
         (4, 1, "y", 2.0, "t4", "b", None, None, None, "u"), (4, 1, "y", 2.0, "t4", "b", None, None, "", "u")], columns,
    )
    known = spark.createDataFrame([("old",)], "review_id string")
    got = store.new_reviews(known, batch, dt.datetime(2024, 1, 1)).collect()
    assert sorted((r["review_id"] or "", r["title"]) for r in got) == [("", "t4"), ("", "t4"), ("k", "t1")]


def test_callers_view_survives_custom_sql(spark):
    spark.createDataFrame([(7,)], "mine int").createOrReplaceTempView("held_name")
    frame = spark.createDataFrame([(1,), (2,)], "x int")
    assert tables.custom_sql(spark, {"held_name": frame, "free_name": frame}, "select count(*) n from held_name").first()["n"] == 2
    assert spark.table("held_name").first()["mine"] == 7
    assert not spark.catalog.tableExists("free_name")
    spark.catalog.dropTempView("held_name")


def test_values_beyond_the_schema_count_as_missing(spark):
    rows = [("a", 12.5, 1e9), ("a", 4.5, 10.0), ("a", None, None), ("a", 3.5, 20.0)]
    df = spark.createDataFrame(rows, "category string, rating double, discounted_price double")
    hist = {r["cents"]: r["n"] for r in rating_histogram(df).collect()}
    assert hist == {None: 2, 450: 1, 350: 1}
    assert prices.price_stats(df).count() == 1
    assert tuple(quality.rejected_values(df).first()) == (4, 1, 1)


def test_nested_reviews_are_dealt_before_they_are_collected(spark, sf_dir, monkeypatch):
    """Collecting sorts the rows of a task: their number is bounded, whatever a file split holds."""
    from shelfscope.views import view

    tables = view(spark, sf_dir, "products"), view(spark, sf_dir, "reviews")
    want = sorted(store.products_nested(*tables, per_document=7).selectExpr("id", "part", "to_json(reviews)").collect())
    monkeypatch.setattr(store, "_TASK_ROWS", 500)
    docs = store.products_nested(*tables, per_document=7)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    rows = tables[1].count()
    dealt = -(-rows // 500)
    assert dealt > 2 and plan.count(f", {dealt}), REPARTITION_BY_NUM") >= 3
    for piece in plan.split("partial_collect_list")[1:]:
        assert "REPARTITION_BY_NUM" in piece.split("Scan parquet")[0]
    assert sorted(docs.selectExpr("id", "part", "to_json(reviews)").collect()) == want


def test_nested_reviews_travel_once(spark, sf_dir, monkeypatch):
    """Whole reviews are shuffled once, or twice for a product with many of them; however large
    the tables are, no other join or list moves them. Parts are the same either way."""
    tables = view(spark, sf_dir, "products"), view(spark, sf_dir, "reviews")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before, found = spark.conf.get(limit), []
    try:
        spark.conf.set(limit, "-1")
        for share in (store._TASK_SHARE, 30, 0):
            monkeypatch.setattr(store, "_TASK_SHARE", share)
            docs = store.products_nested(*tables, per_document=7)
            plan = docs._jdf.queryExecution().optimizedPlan().toString()
            steps = docs._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            ).split("\n\n")
            moved = [s for s in steps if ") Exchange\n" in s and ("body#" in s or "reviews#" in s)]
            assert len(moved) == 3 and all("REPARTITION_BY_NUM" in s for s in moved), plan
            found.append(sorted(docs.selectExpr("id", "part", "to_json(reviews)").collect()))
    finally:
        spark.conf.set(limit, before)
    assert found[0] == found[1] == found[2] and len(found[0]) > tables[0].count()


def test_nested_parts_of_repeated_and_missing_keys(spark, monkeypatch):
    """Products that come twice, have no id or no reviews, beside reviews without a product; one
    product has more reviews than a task takes of it."""
    products = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (2, "r"), (3, "s"), (None, "t")], "id long, title string")
    columns = "id long, product_id long, reviewer_name string, rating double, title string, body string, review_date timestamp, verified_purchase boolean"
    rows = [
        (None if i % 5 == 0 else i, p, "n", 4.0, f"{p}-{i}", "b", None if i % 4 == 0 else dt.datetime(2024, 1, 1 + i % 3), True)
        for p, n in ((1, 40), (2, 12), (9, 3), (None, 4)) for i in range(n)
    ]
    reviews = spark.createDataFrame(rows, columns)
    found = []
    for share in (1000, 20, 0):
        monkeypatch.setattr(store, "_TASK_SHARE", share)
        got = store.products_nested(products, reviews, per_document=5).collect()
        found.append(sorted((r["id"] or 0, r["title"], r["part"], [x["title"] for x in r["reviews"]]) for r in got))
    assert found[0] == found[1] == found[2]
    for key, title, times in ((1, "p", 1), (1, "q", 1), (2, "r", 2)):
        own = [x for k, t, _, xs in found[0] if (k, t) == (key, title) for x in xs]
        assert sorted(own) == sorted([r[4] for r in rows if r[1] == key] * times)
    assert [r for r in found[0] if r[0] in (0, 3)] == [(0, "t", 0, []), (3, "s", 0, [])]


def test_wide_review_rows_are_shuffled_once(spark, sf_dir):
    reviews, batch = view(spark, sf_dir, "reviews"), view(spark, sf_dir, "review_batch")
    new = store.new_reviews(reviews, batch, dt.datetime(2024, 1, 31))
    nodes = new._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ).split("\n\n")
    moved = [n for n in nodes if ") Exchange\n" in n and "product_url#" in n]
    assert len(moved) == 1
