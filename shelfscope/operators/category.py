"""Statistics and rankings per category, all from the rating histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions.bands import P_VALUE_BANDS, SIGMA_BANDS, band
from shelfscope.functions.numeric import cut_quantile, round_half_away, share, tenths
from shelfscope.operators.histogram import category_moments, overall_moments, with_z

STATS_COLUMNS = (
    "category", "product_count", "avg_rating", "rating_stddev", "rating_variance",
    "min_rating", "max_rating", "median_rating", "high_rating_percentage",
    "q1_rating", "q3_rating", "iqr", "z_score", "significance_level",
)


def _rating(cents: Column) -> Column:
    return (cents / F.lit(100.0)).cast("decimal(3,2)")


def category_table(hist: DataFrame, min_count: int = 1) -> DataFrame:
    """Category statistics plus ``mean``, the unrounded average used for ordering."""
    stats = category_moments(hist, with_quantiles=True).filter(
        (F.col("n_named") > 0) & (F.col("n") >= min_count)
    )
    q1, q2, q3 = (cut_quantile(F.col("q")[i]) for i in range(3))
    return with_z(stats, overall_moments(hist)).select(
        "category",
        F.col("n").alias("product_count"),
        round_half_away(F.col("mean"), 3).alias("avg_rating"),
        round_half_away(F.col("stddev"), 3).alias("rating_stddev"),
        round_half_away(F.col("variance"), 3).alias("rating_variance"),
        _rating(F.col("lo")).alias("min_rating"),
        _rating(F.col("hi")).alias("max_rating"),
        tenths(q2).alias("median_rating"),
        round_half_away(share(F.col("n_high"), F.col("n")), 1).alias("high_rating_percentage"),
        tenths(q1).alias("q1_rating"),
        tenths(q3).alias("q3_rating"),
        tenths(q3 - q1).alias("iqr"),
        round_half_away(F.col("z"), 2).alias("z_score"),
        band(F.col("z"), SIGMA_BANDS).alias("significance_level"),
        "mean",
    )


def report_order() -> list[Column]:
    """Best average first, larger category first, then by name."""
    return [F.desc("mean"), F.desc("product_count"), F.asc("category")]


def reverse_report_order() -> list[Column]:
    return [F.asc("mean"), F.asc("product_count"), F.desc("category")]


def category_stats(hist: DataFrame, min_count: int = 1) -> DataFrame:
    """The category report: spread, quartiles, z-score and significance band."""
    table = category_table(hist, min_count)
    return table.orderBy(*report_order()).select(*STATS_COLUMNS)


def _labelled_with_z(hist: DataFrame, min_count: int) -> DataFrame:
    stats = category_moments(hist).filter(
        (F.col("n_labelled") > 0) & (F.col("n") >= min_count)
    )
    return with_z(stats, overall_moments(hist))


def category_significance(hist: DataFrame, limit: int = 20, min_count: int = 1) -> DataFrame:
    """The categories furthest from the overall mean, with p-value labels."""
    return (
        _labelled_with_z(hist, min_count)
        .orderBy(F.desc_nulls_last(F.abs("z")), "category")
        .limit(limit)
        .select(
            "category",
            F.col("n").alias("count"),
            round_half_away(F.col("mean"), 3).alias("avg_rating"),
            round_half_away(F.col("stddev"), 3).alias("stddev"),
            round_half_away(F.col("z"), 2).alias("z_score"),
            band(F.col("z"), P_VALUE_BANDS).alias("significance_level"),
        )
    )


def zscore_table(hist: DataFrame, min_count: int = 1) -> DataFrame:
    return _labelled_with_z(hist, min_count).select(
        "category",
        F.col("n").alias("sample_size"),
        round_half_away(F.col("mean"), 3).alias("avg_rating"),
        round_half_away(F.col("z"), 2).alias("z_score"),
        band(F.col("z"), SIGMA_BANDS).alias("significance_level"),
        "z",
    )


def zscore_categories(hist: DataFrame, min_count: int = 1) -> DataFrame:
    """Every category by distance from the overall mean."""
    return (
        zscore_table(hist, min_count)
        .orderBy(F.desc_nulls_last(F.abs("z")), "category")
        .drop("z")
    )


def variability(hist: DataFrame, highest: bool, limit: int = 5, min_count: int = 1) -> DataFrame:
    """The categories whose ratings vary most (or least)."""
    stats = category_moments(hist).filter(
        (F.col("n_labelled") > 0) & (F.col("n") >= min_count)
    )
    order = F.desc("variance") if highest else F.asc("variance")
    return (
        stats.orderBy(order, "category")
        .limit(limit)
        .select("category", round_half_away(F.col("variance"), 3).alias("variance"))
    )


# fixed values: name of each variability ranking, its measure and its direction
RANKINGS = (
    ("highest_variance_categories", "rating_variance", True),
    ("lowest_variance_categories", "rating_variance", False),
    ("highest_stddev_categories", "rating_stddev", True),
    ("most_consistent_categories", "rating_stddev", False),
    ("highest_coefficient_variation", "coefficient_of_variation", True),
)


def with_variation(table: DataFrame) -> DataFrame:
    """Add the coefficient of variation of the rounded columns."""
    ratio = F.col("rating_stddev") / F.nullif(F.col("avg_rating"), F.lit(0.0))
    return table.withColumn("coefficient_of_variation", ratio)


def variability_rankings(table: DataFrame, limit: int = 5) -> DataFrame:
    """Five rankings of ``limit`` rows each; ties keep the report order.

    Each ranking is a top-k (TakeOrderedAndProject), never a full sort.
    """
    varied = with_variation(table)
    parts = []
    for name, measure, largest in RANKINGS:
        first = F.desc_nulls_last(measure) if largest else F.asc_nulls_last(measure)
        top = (
            varied.filter(F.col(measure).isNotNull())
            .orderBy(first, *report_order())
            .limit(limit)
        )
        rows = top.agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (F.lit(-1.0) if largest else F.lit(1.0)) * F.col(measure),
                        (-F.col("mean")).alias("m"),
                        (-F.col("product_count")).alias("c"),
                        "category",
                        F.col(measure).alias("value"),
                    )
                )
            ).alias("top")
        )
        parts.append(
            rows.select(F.lit(name).alias("ranking"), F.posexplode("top").alias("p", "r")).select(
                "ranking",
                (F.col("p") + 1).alias("position"),
                F.col("r.category").alias("category"),
                round_half_away(F.col("r.value"), 6).alias("value"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variability_summary(table: DataFrame) -> DataFrame:
    return table.agg(
        round_half_away(F.avg("rating_variance"), 6).alias("mean_variance"),
        round_half_away(F.avg("rating_stddev"), 6).alias("mean_stddev"),
        F.min("rating_variance").alias("min_variance"),
        F.max("rating_variance").alias("max_variance"),
    )


def market_share(products: DataFrame) -> DataFrame:
    """Share of all products per category (missing categories included)."""
    sizes = products.groupBy("category").agg(F.count("*").alias("product_count"))
    total = sizes.agg(F.sum("product_count").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select(
        "category",
        "product_count",
        round_half_away(share(F.col("product_count"), F.col("total")), 2).alias("market_share"),
    )


def premium_categories(table: DataFrame, over: float = 80.0) -> DataFrame:
    """Categories whose share of products rated 4 or more exceeds ``over`` percent."""
    return table.filter(F.col("high_rating_percentage") > over).select(
        "category", "product_count", "avg_rating", "high_rating_percentage"
    )
