"""Checks on a catalogue before and after loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions.numeric import round_half_away, share
from shelfscope.operators.histogram import rating_histogram

# fixed values: limits below which a catalogue earns an advice line
ADVICE = (
    ("rating_completeness", 70, "Low rating completeness - consider data cleaning"),
    ("unique_categories", 5, "Limited category diversity - verify category mapping"),
    ("dataset_size", 100000, "Small dataset size - statistical significance may be limited"),
)


def _profile(products: DataFrame) -> DataFrame:
    """One row of counts over the rating histogram (bounded, see ``rating_histogram``)."""
    hist = rating_histogram(products)
    n = F.col("n")
    cents = F.col("cents")
    per_category = hist.groupBy("category").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(cents.isNotNull(), n).otherwise(0)).alias("with_rating"),
        F.sum(F.when(cents > 0, n).otherwise(0)).alias("valid"),
        F.min(cents).alias("lo"),
        F.max(cents).alias("hi"),
        F.sum(cents.cast("decimal(19,0)") * n).alias("s1"),
    )
    missing = F.col("category").isNull() | (F.col("category") == "")
    return per_category.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("with_rating"), F.lit(0)).alias("with_rating"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("s1").alias("s1"),
        F.count("*").alias("labels"),
        F.count("category").alias("known_labels"),
        F.count_if((F.col("category") == "Unknown")).alias("unknown_labels"),
        F.count_if(F.col("category").isNull()).alias("null_labels"),
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("missing"),
    )


def _rating(name: str):
    return (F.col(name) / F.lit(100.0)).cast("decimal(3,2)")


def validate_dataset(products: DataFrame, approximate_titles: bool = False) -> DataFrame:
    """Size, ranges and completeness of a catalogue with advice lines.

    The exact title count is the one shuffle that grows with the data; pass
    ``approximate_titles`` to replace it by a sketch.
    """
    if approximate_titles:
        titles = products.agg(F.approx_count_distinct("title").alias("unique_products"))
    else:
        titles = (
            products.filter(F.col("title").isNotNull())
            .select("title")
            .distinct()
            .agg(F.count("*").alias("unique_products"))
        )
    # NULL categories count as 'Unknown', once
    categories = F.col("known_labels") + F.when(
        (F.col("null_labels") > 0) & (F.col("unknown_labels") == 0), 1
    ).otherwise(0)
    row = _profile(products).crossJoin(F.broadcast(titles)).select(
        F.col("rows").alias("dataset_size"),
        categories.alias("unique_categories"),
        F.col("valid").alias("valid_ratings"),
        _rating("lo").alias("min_rating"),
        _rating("hi").alias("max_rating"),
        F.col("missing").alias("missing_categories"),
        "unique_products",
        F.coalesce(
            round_half_away(share(F.col("valid"), F.col("rows")), 2), F.lit(0.0)
        ).alias("rating_completeness"),
    )
    advice = F.array_compact(
        F.array(*[F.when(F.col(c) < limit, F.lit(text)) for c, limit, text in ADVICE])
    )
    return row.withColumn("recommendations", advice)


def load_summary(loaded: DataFrame) -> DataFrame:
    """Rows, categories and rating range of a loaded catalogue."""
    return _profile(loaded).select(
        F.col("rows").alias("row_count"),
        F.col("known_labels").alias("unique_categories"),
        _rating("lo").alias("min_rating"),
        _rating("hi").alias("max_rating"),
        round_half_away(_mean(), 2).alias("avg_rating"),
    )


def _mean():
    return F.col("s1").cast("double") / F.nullif(F.col("with_rating") * F.lit(100.0), F.lit(0.0))


def dataset_info(products: DataFrame) -> DataFrame:
    """What is loaded now: size, rated rows, rating range and completeness."""
    return _profile(products).select(
        F.col("rows").alias("total_products"),
        F.col("known_labels").alias("unique_categories"),
        F.col("valid").alias("products_with_ratings"),
        _rating("lo").alias("min"),
        _rating("hi").alias("max"),
        round_half_away(_mean(), 2).alias("average"),
        F.coalesce(
            round_half_away(share(F.col("valid"), F.col("rows")), 1), F.lit(0.0)
        ).alias("rating_completeness"),
    )


def top_categories(products: DataFrame, limit: int = 10) -> DataFrame:
    return (
        products.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("product_count"))
        .orderBy(F.desc("product_count"), "category")
        .limit(limit)
    )


def rejected_values(products: DataFrame, price: str = "discounted_price") -> DataFrame:
    """One row: products whose rating or price is a value, but none that the analysis schema
    (DECIMAL(3,2), DECIMAL(10,2)) can hold. Everywhere else such a value counts as missing."""

    def rejected(column: str, kind: str) -> Column:
        return F.count_if(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull())

    return products.agg(
        F.count("*").alias("products"),
        rejected("rating", "decimal(3,2)").alias("ratings"),
        rejected(price, "decimal(10,2)").alias("prices"),
    )
