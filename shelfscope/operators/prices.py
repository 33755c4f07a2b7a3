"""Price statistics per category, with an exact median that never ranks raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelfscope.functions.numeric import round_half_away

# Prices are DECIMAL(10,2): at most 10**10 distinct values, so both the bins and the
# values inside one bin stay below 10**5 whatever the number of products.
_BIN = 100_000


def price_stats(products: DataFrame, price: str = "discounted_price") -> DataFrame:
    """Count, mean, median, deviation and range of prices per category.

    Products are first combined into (category, price, n) on the map side. The median
    is then found in two steps: cumulative counts over coarse price bins name the bin
    holding each middle rank, and only that bin is ranked value by value. No window
    ever covers more than 10**5 rows.
    """
    # a price that is no DECIMAL(10,2) counts as missing
    value = F.col(price).try_cast("decimal(10,2)")
    cents = (value * 100).cast("long").alias("cents")
    hist = (
        products.filter(value.isNotNull())
        .groupBy("category", cents)
        .agg(F.count("*").alias("n"))
        .withColumn("bin", F.floor(F.col("cents") / _BIN))
    )
    n, c = F.col("n").cast("decimal(19,0)"), F.col("cents").cast("decimal(19,0)")
    bins = hist.groupBy("category", "bin").agg(
        F.sum("n").alias("n"),
        F.sum(n * c).cast("decimal(38,0)").alias("s1"),
        F.sum(n * c * c).cast("decimal(38,0)").alias("s2"),
        F.min("cents").alias("lo"),
        F.max("cents").alias("hi"),
    )
    total = bins.groupBy("category").agg(
        F.sum("n").alias("total"),
        F.sum("s1").cast("decimal(38,0)").alias("s1"),
        F.sum("s2").cast("decimal(38,0)").alias("s2"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    # the two middle ranks of each category (equal when the count is odd)
    before = Window.partitionBy("category").orderBy("bin")
    whole = Window.partitionBy("category")
    placed = bins.select(
        "category",
        "bin",
        (F.sum("n").over(before) - F.col("n")).alias("seen"),
        F.sum("n").over(whole).alias("total"),
        "n",
    ).select(
        "category",
        "bin",
        "seen",
        F.floor((F.col("total") + 1) / 2).alias("rank_a"),
        F.floor((F.col("total") + 2) / 2).alias("rank_b"),
        (F.col("seen") + F.col("n")).alias("upto"),
    )
    middle_bins = placed.filter(
        ((F.col("rank_a") > F.col("seen")) & (F.col("rank_a") <= F.col("upto")))
        | ((F.col("rank_b") > F.col("seen")) & (F.col("rank_b") <= F.col("upto")))
    ).select(
        F.col("category").alias("m_category"), F.col("bin").alias("m_bin"),
        "seen", "rank_a", "rank_b",
    )
    same = F.col("category").eqNullSafe(F.col("m_category")) & (F.col("bin") == F.col("m_bin"))
    inside = Window.partitionBy("category", "bin").orderBy("cents")
    ranked = (
        hist.join(middle_bins, same)
        .withColumn("upto", F.col("seen") + F.sum("n").over(inside))
        .withColumn("from", F.col("upto") - F.col("n"))
    )

    def at(rank: str):
        hit = (F.col(rank) > F.col("from")) & (F.col(rank) <= F.col("upto"))
        return F.max(F.when(hit, F.col("cents")))

    middle = (
        ranked.groupBy("category")
        .agg(at("rank_a").alias("a"), at("rank_b").alias("b"))
        .withColumnRenamed("category", "m_category")
    )
    spread = (
        F.col("total").cast("decimal(19,0)") * F.col("s2") - F.col("s1") * F.col("s1")
    ).cast("double")
    count = F.col("total").cast("double")
    return (
        total.join(middle, F.col("category").eqNullSafe(F.col("m_category")))
        .select(
            "category",
            F.col("total").alias("product_count"),
            round_half_away(F.col("s1").cast("double") / (count * 100.0), 2).alias("avg_price"),
            round_half_away((F.col("a") + F.col("b")) / 200.0, 3).alias("median_price"),
            round_half_away(F.sqrt(spread / (count * count)) / 100.0, 2).alias("price_stddev"),
            (F.col("lo") / 100.0).alias("min_price"),
            (F.col("hi") / 100.0).alias("max_price"),
            ((F.col("hi") - F.col("lo")) / 100.0).alias("price_range"),
        )
    )
