"""Statistics over all products, from the rating histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfscope.functions.numeric import cut_quantile, round_half_away, share
from shelfscope.operators.histogram import overall_moments, quantiles


def _by_rating(hist: DataFrame) -> DataFrame:
    """The histogram without its category: at most 1,000 rows."""
    return (
        hist.filter(F.col("cents").isNotNull())
        .groupBy("cents")
        .agg(F.sum("n").alias("n"))
    )


def overall_stats(hist: DataFrame) -> DataFrame:
    """One row: size, mean, deviation, median, mode, range, high and low shares.

    The mode is the most frequent rating, the lower one on a tie.
    """
    shape = _by_rating(hist).agg(
        quantiles(0.5),
        F.max_by("cents", F.struct(F.col("n"), -F.col("cents"))).alias("mode"),
    )
    labels = (
        hist.filter(F.col("cents").isNotNull() & F.col("category").isNotNull())
        .select("category")
        .distinct()
        .agg(F.count("*").alias("unique_categories"))
    )
    row = (
        overall_moments(hist)
        .crossJoin(F.broadcast(shape))
        .crossJoin(F.broadcast(labels))
    )

    def rating(cents):
        return (cents / F.lit(100.0)).cast("decimal(3,2)")

    return row.select(
        F.coalesce("n", F.lit(0)).alias("total_products"),
        "unique_categories",
        round_half_away(F.col("mean"), 3).alias("overall_average_rating"),
        round_half_away(F.col("stddev"), 3).alias("overall_stddev"),
        rating(cut_quantile(F.col("q")[0])).alias("median_rating"),
        rating(F.col("mode")).alias("mode_rating"),
        rating(F.col("lo")).alias("min_rating"),
        rating(F.col("hi")).alias("max_rating"),
        F.coalesce("n_high", F.lit(0)).alias("high_rated_products"),
        F.coalesce("n_low", F.lit(0)).alias("low_rated_products"),
        round_half_away(share(F.col("n_high"), F.col("n")), 2).alias("high_rated_percentage"),
        round_half_away(share(F.col("n_low"), F.col("n")), 2).alias("low_rated_percentage"),
    )


def rating_distribution_overall(hist: DataFrame) -> DataFrame:
    """Products per whole star with their share; at most ten rows."""
    stars = (
        hist.filter(F.col("cents").isNotNull())
        .groupBy(F.floor(F.col("cents") / 100).cast("int").alias("rating"))
        .agg(F.sum("n").alias("count"))
    )
    total = hist.filter(F.col("cents").isNotNull()).agg(F.sum("n").alias("total"))
    return (
        stars.crossJoin(F.broadcast(total))
        .select(
            "rating",
            "count",
            round_half_away(share(F.col("count"), F.col("total")), 2).alias("percentage"),
        )
        .orderBy("rating")
    )


def rating_distribution(hist: DataFrame) -> DataFrame:
    """Products per category and whole star with the share inside the category.

    The window runs over grouped rows, at most ten per category.
    """
    stars = (
        hist.filter(F.col("cents") > 0)
        .groupBy("category", F.floor(F.col("cents") / 100).cast("int").alias("rating_floor"))
        .agg(F.sum("n").alias("count"))
    )
    within = F.sum("count").over(Window.partitionBy("category"))
    return stars.select(
        "category",
        "rating_floor",
        "count",
        round_half_away(share(F.col("count"), within), 6).alias("percentage"),
    ).orderBy(F.asc_nulls_last("category"), "rating_floor")
