"""Moving the crawl store into the analytics schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfscope.functions.text import title_category


def import_products(products: DataFrame) -> DataFrame:
    """Store products in the analytics schema, with a category taken from the title."""
    return products.select(
        "id",
        "title",
        "brand",
        F.col("price").try_cast("decimal(10,2)").alias("price"),
        F.col("rating").try_cast("decimal(3,2)").alias("rating"),
        "review_count",
        "description",
        title_category(F.col("title")).alias("category"),
        "url",
        "scraped_at",
        "created_at",
    )


def import_reviews(reviews: DataFrame) -> DataFrame:
    """Store reviews in the analytics schema; sentiment is not known yet."""
    return reviews.select(
        "id",
        "product_id",
        "reviewer_name",
        F.col("rating").try_cast("decimal(3,2)").alias("rating"),
        "title",
        "body",
        F.to_date("review_date").alias("review_date"),
        "verified_purchase",
        "helpful_count",
        F.lit(None).cast("decimal(3,2)").alias("sentiment_score"),
        F.length("body").alias("review_length"),
        "scraped_at",
        "created_at",
    )


def replace_by_id(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Insert-or-replace by primary key: incoming rows win, and of those with one id the
    last by ``order`` (which is not stored). Without ``order``, or where it ties, the greatest
    row wins, so that the result is the same however the rows are dealt. Rows without an id
    replace nothing and all stay.
    """
    columns = stored.columns
    fields = F.struct(*[c for c in columns if c != "id"])
    place = F.struct(F.col(order), fields) if order else fields
    last = (
        incoming.filter("id is not null").groupBy("id").agg(F.max_by(fields, place).alias("_r"))
        .select("id", "_r.*").select(*columns)
    )
    kept = stored.join(incoming.select("id").distinct(), "id", "left_anti")
    return (
        kept.select(*columns).unionByName(last)
        .unionByName(incoming.filter("id is null").select(*columns))
    )
