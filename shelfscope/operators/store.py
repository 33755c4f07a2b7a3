"""The product and review store: merges, lookups, pages and summaries."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.functions.dates import parse_stored_date
from shelfscope.functions.numeric import round_half_away
from shelfscope.operators.numbering import number_rows
from shelfscope.session import durable

# fixed values: product fields a newer crawl overwrites
UPDATED_FIELDS = ("title", "brand", "price", "rating", "review_count", "description")
REVIEW_FIELDS = (
    "reviewer_name", "rating", "title", "body", "review_date", "verified_purchase",
)


# reviews that a task collects by product, and those of one product among them
_TASK_ROWS = 250_000
_TASK_SHARE = _TASK_ROWS // 10


def _moment(as_of: dt.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def known_keys(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The store's keys that occur in the batch. With a small batch that is a broadcast
    semi-join decided by Spark from its size, so the store is scanned once for one column
    and never shuffled."""
    return store.select(key).join(batch.select(key).distinct(), key, "left_semi")


def unseen(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` whose ``key`` is not in ``store``, by ``known_keys``."""
    return batch.join(known_keys(batch, store, key), key, "left_anti")


def latest_per_url(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each URL and ``first_seq``, when the URL first occurred.

    A partial aggregate keeps one row per URL and map task, so a URL crawled over and
    over does not travel.
    """
    fields = F.struct(*UPDATED_FIELDS)
    return (
        batch.filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max_by(fields, order).alias("new"), F.min(order).alias("first_seq"))
    )


def split_product_merge(
    store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(store rows with updates applied, new rows without an id)."""
    latest = latest_per_url(batch, order)
    hit = F.col("new").isNotNull()
    updated = store.join(latest.drop("first_seq"), "url", "left").select(
        *[
            F.when(hit, F.col(f"new.{c}")).otherwise(store[c]).alias(c)
            if c in UPDATED_FIELDS
            else F.when(hit, _moment(as_of)).otherwise(store[c]).alias(c)
            if c == "updated_at"
            else store[c]
            for c in store.columns
        ]
    )
    fresh = unseen(latest, store, "url").select("url", "first_seq", "new.*")
    no_url = batch.filter(F.col("url").isNull()).select(
        "url", F.col(order).alias("first_seq"), *UPDATED_FIELDS
    )
    inserted = fresh.unionByName(no_url)
    for c in ("scraped_at", "created_at", "updated_at"):
        inserted = inserted.withColumn(c, _moment(as_of))
    return updated, inserted


def merge_products(
    store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str = "seq"
) -> DataFrame:
    """The store after upserting the batch by ``url``.

    Known URLs keep their id and first-seen times; new ones are numbered behind the
    largest id in order of first occurrence. Merging the same batch twice changes
    nothing but ``updated_at``.
    """
    updated, inserted = split_product_merge(store, batch, as_of, order)
    numbered = number_rows(
        inserted, ["first_seq"], after=store.agg(F.max("id").alias("top"))
    )
    return updated.unionByName(numbered.drop("first_seq"))


def new_reviews(
    store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str = "seq"
) -> DataFrame:
    """The batch rows to append: the first row of each unseen ``review_id`` and every
    row without one.

    The first row of a key is a group limit: repeats go before the shuffle, so wide rows are
    shuffled once, by key, and meet the store's keys there. Rows with equal key and place are
    one row.
    """
    keyed = F.coalesce(F.col("review_id") != "", F.lit(False))
    columns = [c for c in batch.columns if c != order]
    place = F.struct(F.col(order), F.xxhash64(*columns)).alias("_place")
    own = batch.filter(keyed)
    ranked = own.select(*columns, place).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("review_id").orderBy("_place"))
    )
    rows = (
        ranked.filter("_rank = 1").select(*columns)
        .join(known_keys(own, store, "review_id"), "review_id", "left_anti").select(*columns)
        .unionByName(batch.filter(~keyed).select(*columns))
    )
    return rows.select(
        "product_id",
        "reviewer_name",
        "rating",
        "title",
        "body",
        parse_stored_date(F.col("date")).alias("review_date"),
        F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"),
        F.lit(0).alias("helpful_count"),
        "review_id",
        "product_url",
        _moment(as_of).alias("scraped_at"),
        _moment(as_of).alias("created_at"),
    )


def append_reviews(store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str = "seq") -> DataFrame:
    """The store with the batch's new reviews numbered behind it."""
    numbered = number_rows(
        new_reviews(store, batch, as_of, order),
        after=store.agg(F.max("id").alias("top")),
    )
    return store.unionByName(numbered)


def delete_products(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products whose id is not listed."""
    return products.join(ids.select("id").distinct(), "id", "left_anti")


def product_by_url(products: DataFrame, url: str) -> DataFrame:
    return products.filter(F.col("url") == url)


def product_by_id(products: DataFrame, product_id: int) -> DataFrame:
    return products.filter(F.col("id") == product_id)


def _with_page_info(rows: DataFrame, total: DataFrame, limit: int, offset: int) -> DataFrame:
    """Attach the one-row total and whether a further page exists."""
    return rows.crossJoin(F.broadcast(total)).withColumn(
        "has_more", F.lit(offset + limit) < F.col("total")
    )


def products_page(products: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of products, newest first, with the total and ``has_more``.

    Skipping is a top-(offset + limit); for deep pages use ``products_after``.
    """
    rows = (
        products.orderBy(F.desc_nulls_last("created_at"), "id").offset(offset).limit(limit)
    )
    return _with_page_info(rows, products.agg(F.count("*").alias("total")), limit, offset)


def products_after(
    products: DataFrame, created_at: dt.datetime | None, product_id: int, limit: int = 50
) -> DataFrame:
    """The page that follows the given last row, in the order of ``products_page``: a filter
    and a top-k at any depth. Products without a date come last; ``created_at`` is None when
    the last row is one of them."""
    at, below = F.col("created_at"), F.col("id") > product_id
    if created_at is None:
        later = at.isNull() & below
    else:
        moment = _moment(created_at)
        later = at.isNull() | (at < moment) | ((at == moment) & below)
    return products.filter(later).orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def reviews_page(
    reviews: DataFrame, product_id: int, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of a product's reviews, last stored first; ``date`` repeats the review date."""
    own = reviews.filter(F.col("product_id") == product_id)
    rows = (
        own.orderBy(F.desc_nulls_last("created_at"), "id")
        .offset(offset)
        .limit(limit)
        .withColumn("date", F.col("review_date"))
    )
    return _with_page_info(rows, own.agg(F.count("*").alias("total")), limit, offset)


def reviews_by_product(reviews: DataFrame, product_id: int) -> DataFrame:
    """All reviews of a product, latest review date first."""
    return reviews.filter(F.col("product_id") == product_id).orderBy(
        F.desc_nulls_last("review_date"), "id"
    )


def product_with_reviews(
    products: DataFrame, reviews: DataFrame, product_id: int, limit: int | None = None
) -> DataFrame:
    """A product beside its stored reviews, one row per review; with ``limit``, beside the
    latest ones only.

    Without reviews the product still appears, with NULL review fields.
    """
    own = reviews.filter(F.col("product_id") == product_id)
    if limit is not None:
        own = own.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)
    page = (
        own.select("product_id", *[F.col(c).alias(f"review_{c.removeprefix('review_')}") for c in REVIEW_FIELDS])
    )
    product = product_by_id(products, product_id)
    return product.join(page, product["id"] == page["product_id"], "left").drop("product_id")


def review_totals(reviews: DataFrame) -> DataFrame:
    """Count and mean rating per product, combined on the map side."""
    return reviews.groupBy("product_id").agg(
        F.count("id").alias("actual_review_count"),
        F.avg("rating").alias("avg_review_rating"),
    )


def products_summary(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every product with the number and mean of its stored reviews, in no order.

    Reviews are aggregated before the join: a product with a third of all reviews is one
    row by then.
    """
    totals = review_totals(reviews).withColumnRenamed("product_id", "_pid")
    return products.join(totals, products["id"] == totals["_pid"], "left").select(
        *[products[c] for c in products.columns],
        F.coalesce("actual_review_count", F.lit(0)).alias("actual_review_count"),
        "avg_review_rating",
    )


def review_counts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored reviews per product, 0 included."""
    counts = reviews.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"))
    return products.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("review_count")
    )


def products_nested(
    products: DataFrame, reviews: DataFrame, per_document: int = 10_000
) -> DataFrame:
    """Products with their reviews as arrays of structs, one row per (product, part).

    Parts are consecutive ranges in review order (day, then id): reviews are counted per
    product, day and range of ``per_document`` ids, and a running sum of these counts
    names the part. A part has fewer than
    twice ``per_document`` reviews; nothing is cut off (reviews without an id are one range
    of their day, however many they are). A product without reviews has
    part 0 with an empty array.

    Reviews travel once: they are dealt by product to tasks of about ``_TASK_ROWS``, where a rank
    by day and range is the running sum, and their products come to them. A product with more than
    ``_TASK_SHARE`` reviews (and more than ``per_document``) would crowd a task, and no window
    covers its reviews: they are dealt by day and range and then by part. The list of such products
    is at most a row per ``_TASK_SHARE`` reviews, so it is broadcast.
    """
    unit = F.to_date("review_date").alias("day"), F.floor(F.col("id") / per_document).alias("block")
    rows = reviews.select("id", "product_id", *REVIEW_FIELDS)
    totals = durable(reviews.groupBy("product_id").agg(F.count("*").alias("n")))
    tasks = math.ceil((totals.agg(F.sum("n")).first()[0] or 1) / _TASK_ROWS)
    # with fewer tasks than a join has by itself, it would deal the documents once more
    tasks = max(tasks, int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = totals.filter(F.col("n") > max(per_document, _TASK_SHARE)).select("product_id")
    entry = F.struct(F.col("review_date").alias("at"), "id", F.struct(*REVIEW_FIELDS).alias("r"))
    in_order = F.sort_array(F.collect_list(entry)).alias("sorted")

    def part(before: Column) -> Column:
        return F.floor(before / per_document).cast("int").alias("part")

    def documents(placed: DataFrame) -> DataFrame:
        docs = placed.groupBy("product_id", "part").agg(in_order)
        return docs.select("product_id", "part", F.col("sorted.r").alias("reviews"))

    def beside(own: DataFrame, docs: DataFrame, how: str) -> DataFrame:
        none = F.array().cast(docs.schema["reviews"].dataType)
        return own.join(docs, own["id"] == docs["product_id"], how).select(
            *[own[c] for c in products.columns],
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("reviews", none).alias("reviews"),
        )

    # the list names these few products
    listed, ids = F.broadcast(large), F.broadcast(large.withColumnRenamed("product_id", "id"))
    rank = F.rank().over(Window.partitionBy("product_id").orderBy(*unit))
    own = rows.join(listed, "product_id", "left_anti").repartition(tasks, "product_id")
    docs = documents(own.withColumn("part", part(rank - 1)))
    out = beside(products.join(ids, "id", "left_anti"), docs, "left")

    rows = rows.join(listed, "product_id", "left_semi").withColumn("unit", F.struct(*unit))
    counts = rows.groupBy("product_id", "unit").agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("product_id").orderBy("unit")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = counts.select(
        "product_id", "unit", part(F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    # a struct is never null, so a missing day or id joins as any other
    placed = rows.repartition(tasks, "product_id", "unit").join(parts.hint("merge"), ["product_id", "unit"])
    docs = documents(placed.repartition(tasks, "product_id", "part"))
    return out.unionByName(beside(F.broadcast(products.join(ids, "id", "left_semi")), docs, "inner"))


def store_overview(products: DataFrame, reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """Store sizes and rates beside every product's summary, as one frame: a row per
    product, the one-row totals repeated."""
    totals = store_stats(products, reviews, sessions)
    names = [F.col(c).alias(f"store_{c}") for c in totals.columns]
    return products_summary(products, reviews).join(F.broadcast(totals.select(*names)))


def store_stats(products: DataFrame, reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of store sizes, the mean review rating and the crawl success rate.

    NULL means there is nothing to average; a true 0 stays 0.
    """
    p = products.agg(F.count("*").alias("total_products"))
    r = reviews.agg(
        F.count("*").alias("total_reviews"),
        round_half_away(F.avg("rating"), 2).alias("average_review_rating"),
    )
    s = sessions.agg(
        F.count("*").alias("total_sessions"),
        round_half_away(
            F.avg(F.when(F.col("success"), 100.0).otherwise(0.0)), 2
        ).alias("scraping_success_rate"),
    )
    return p.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(s))


def search_products(
    products: DataFrame,
    text: str | None = None,
    category: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    """Products (of the store or of the catalogue) that meet every criterion given."""
    price = "price" if "price" in products.columns else "discounted_price"
    out = products
    if text is not None:
        out = out.filter(F.lower("title").contains(text.lower()))
    if category is not None:
        out = out.filter(F.col("category") == category)
    if min_price is not None:
        out = out.filter(F.col(price) >= min_price)
    if max_price is not None:
        out = out.filter(F.col(price) <= max_price)
    if min_rating is not None:
        out = out.filter(F.col("rating") >= min_rating)
    return out
