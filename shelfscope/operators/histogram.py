"""The rating histogram every rating statistic is computed from.

A rating is DECIMAL(3,2), so a category has at most 1,000 distinct values and the
histogram is bounded by categories x 1,000 whatever the number of products. It costs
one scan of two columns and one shuffle of map-side combined rows; a category that
holds a third of all products arrives at its reducer as at most 1,000 rows per map
task. All later work runs on the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rating_histogram(products: DataFrame) -> DataFrame:
    """``category, cents, n``: products per category and rating (in hundredths).

    Unrated products are kept under a NULL ``cents`` so that row counts come from
    the same pass. Double ratings are rounded to hundredths first, not cut; a rating that is
    no DECIMAL(3,2) counts as missing, as in the imports (``quality.rejected_values`` counts
    these).
    """
    cents = (F.col("rating").try_cast("decimal(3,2)") * 100).cast("int")
    return products.groupBy("category", cents.alias("cents")).agg(F.count("*").alias("n"))


def histogram_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``category, cents, n`` with signed counts: what the histogram gains when the rows of
    ``before`` (replaced and deleted products) give way to those of ``after``."""
    lost = rating_histogram(before).withColumn("n", -F.col("n"))
    return folded(lost.unionByName(rating_histogram(after)))


def folded(hist: DataFrame) -> DataFrame:
    """A histogram with changes added up; combinations without products are gone."""
    return hist.groupBy("category", "cents").agg(F.sum("n").alias("n")).filter("n <> 0")


def _moments() -> list[Column]:
    r = F.col("cents").cast("decimal(19,0)")
    n = F.col("n").cast("decimal(19,0)")
    return [
        F.sum("n").alias("n"),
        F.sum(n * r).cast("decimal(38,0)").alias("s1"),
        F.sum(n * r * r).cast("decimal(38,0)").alias("s2"),
        F.min("cents").alias("lo"),
        F.max("cents").alias("hi"),
        F.sum(F.when(F.col("cents") >= 400, F.col("n")).otherwise(0)).alias("n_high"),
        F.sum(F.when(F.col("cents") <= 200, F.col("n")).otherwise(0)).alias("n_low"),
    ]


def _with_mean_and_spread(df: DataFrame) -> DataFrame:
    """Mean, variance and deviation from exact integer sums, hence independent of
    row order and partitioning."""
    n = F.col("n").cast("decimal(19,0)")
    spread = (n * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")
    return df.withColumn(
        "mean", F.col("s1").cast("double") / (F.col("n") * F.lit(100.0))
    ).withColumn(
        "variance", spread / (F.col("n").cast("double") * F.col("n").cast("double")) / F.lit(10000.0)
    ).withColumn("stddev", F.sqrt("variance"))


def quantiles(*points: float) -> Column:
    wanted = F.array(*[F.lit(p) for p in points])
    return F.percentile(F.col("cents").cast("double"), wanted, F.col("n")).alias("q")


def category_moments(hist: DataFrame, with_quantiles: bool = False) -> DataFrame:
    """One row per category over the rated products.

    ``n_named`` counts products whose category is neither NULL nor empty. Filtering on
    that aggregate rather than on ``category`` keeps the predicate above the
    histogram's shuffle, so the overall row can reuse the same exchange.
    """
    named = F.col("category").isNotNull() & (F.col("category") != "")
    extra = [
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("n_named"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("n")).otherwise(0)).alias("n_labelled"),
    ]
    if with_quantiles:
        extra.append(quantiles(0.25, 0.5, 0.75))
    rated = hist.filter(F.col("cents").isNotNull())
    return _with_mean_and_spread(rated.groupBy("category").agg(*_moments(), *extra))


def overall_moments(hist: DataFrame) -> DataFrame:
    """One row over all rated products, whatever their category."""
    rated = hist.filter(F.col("cents").isNotNull())
    return _with_mean_and_spread(rated.agg(*_moments()))


def with_z(categories: DataFrame, overall: DataFrame) -> DataFrame:
    """Add ``z`` = (category mean - overall mean) / overall deviation of single ratings.

    ``overall`` has exactly one row, so broadcasting it is safe at any scale.
    """
    one = overall.select(
        F.col("mean").alias("all_mean"), F.col("stddev").alias("all_stddev")
    )
    z = (F.col("mean") - F.col("all_mean")) / F.nullif(F.col("all_stddev"), F.lit(0.0))
    return categories.crossJoin(F.broadcast(one)).withColumn("z", z)
