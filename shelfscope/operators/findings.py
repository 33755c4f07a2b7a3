"""Plain-language findings and reports from the category table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions.bands import SIGMA_BANDS
from shelfscope.functions.numeric import round_half_away
from shelfscope.operators.category import (
    category_table,
    report_order,
    reverse_report_order,
    zscore_table,
)
from shelfscope.operators.numbering import number_rows
from shelfscope.operators.overall import overall_stats

# fixed values: all sentences, titles and labels of the findings and reports below, apart from
# the reports' neutral titles
_SIGNIFICANT = SIGMA_BANDS[0][1]


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals and thousands separators.

    ``format_number`` rounds the exact binary value, ties to even.
    """
    return F.format_number(value, digits)


def _text(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def _pick(*keys: Column) -> Column:
    """The category row that comes first by ``keys``; report order breaks ties."""
    row = F.struct(
        "category", "avg_rating", "product_count", "rating_stddev", "rating_variance"
    )
    tie = [-F.col("mean"), -F.col("product_count"), F.col("category")]
    return F.min_by(row, F.struct(*keys, *tie))


def category_extremes(table: DataFrame) -> DataFrame:
    """One row naming the first, last, most and least variable categories.

    Every pick is a mergeable aggregate, so nothing is sorted or collected.
    """
    row = F.struct(
        "category", "avg_rating", "product_count", "rating_stddev", "rating_variance"
    )
    order = F.struct(-F.col("mean"), -F.col("product_count"), F.col("category"))
    return table.agg(
        F.count("*").alias("categories"),
        F.count_if(F.col("significance_level") == _SIGNIFICANT).alias("significant"),
        F.min_by(row, order).alias("best"),
        F.max_by(row, order).alias("worst"),
        _pick(-F.col("avg_rating")).alias("highest_rated"),
        _pick(F.col("avg_rating")).alias("lowest_rated"),
        _pick(-F.col("rating_variance")).alias("most_variance"),
        _pick(F.col("rating_variance")).alias("least_variance"),
        _pick(-F.col("rating_stddev")).alias("most_stddev"),
        _pick(F.col("rating_stddev")).alias("least_stddev"),
    )


def _facts(hist: DataFrame) -> DataFrame:
    return category_extremes(category_table(hist)).crossJoin(
        F.broadcast(overall_stats(hist))
    )


def _finding_list() -> Column:
    """At most six sentences, in their fixed order."""
    several = F.col("categories") > 1
    high = F.col("high_rated_percentage")
    mean = F.col("overall_average_rating")
    sentences = [
        _text(
            "'%s' is the top-performing category with %s average rating from %s products",
            F.col("best.category"), fixed(F.col("best.avg_rating"), 2),
            fixed(F.col("best.product_count"), 0),
        ),
        F.when(
            several,
            _text(
                "'%s' shows the lowest performance with %s average rating",
                F.col("worst.category"), fixed(F.col("worst.avg_rating"), 2),
            ),
        ),
        F.when(
            several,
            _text(
                "'%s' shows highest rating variability (σ²=%s), indicating inconsistent product quality",
                F.col("most_variance.category"), fixed(F.col("most_variance.rating_variance"), 3),
            ),
        ),
        F.when(
            several,
            _text(
                "'%s' demonstrates most consistent quality (σ²=%s)",
                F.col("least_variance.category"), fixed(F.col("least_variance.rating_variance"), 3),
            ),
        ),
        F.when(
            F.col("significant") > 0,
            _text(
                "%s categories show statistically significant performance differences from the dataset mean",
                F.col("significant").cast("string"),
            ),
        ),
        F.when(
            high > 0, _text("%s%% of all products receive high ratings (4.0+)", fixed(high, 1))
        )
        .when(
            mean >= 4.0,
            _text("Overall dataset shows strong performance with %s average rating", fixed(mean, 2)),
        )
        .otherwise(_text("Dataset average rating is %s", fixed(mean, 2))),
    ]
    return F.array_compact(F.array(*sentences))


def key_findings(hist: DataFrame) -> DataFrame:
    """``position, finding``: what stands out, at most six sentences."""
    facts = _facts(hist).filter(F.col("categories") > 0)
    return facts.select(F.posexplode(_finding_list()).alias("p", "finding")).select(
        (F.col("p") + 1).alias("position"), "finding"
    )


def _recommendation_row(hist: DataFrame, most: int | None = None) -> DataFrame:
    """One row with the ordered list of recommendations, the first ``most`` if given."""
    mean = overall_stats(hist).select(F.col("overall_average_rating").alias("m"))
    table = category_table(hist).crossJoin(F.broadcast(mean))
    order = F.struct(-F.col("mean"), -F.col("product_count"), F.col("category"))
    row = F.struct("category", "avg_rating", "rating_stddev")

    def where(condition: Column, pick) -> Column:
        return pick(F.when(condition, row), F.when(condition, order))

    picks = table.agg(
        where(F.col("avg_rating") > F.col("m") + 0.2, F.min_by).alias("top"),
        where(F.col("avg_rating") < F.col("m") - 0.2, F.max_by).alias("low"),
        where(F.col("rating_stddev") > 1.0, F.min_by).alias("loose"),
        where(F.col("rating_stddev") < 0.5, F.min_by).alias("tight"),
    )
    # the two significant categories furthest from the mean
    outliers = (
        zscore_table(hist)
        .filter(F.col("significance_level") == _SIGNIFICANT)
        .orderBy(F.desc(F.abs("z")), "category")
        .limit(2)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.abs("z")).alias("far"), "category", F.col("z_score").alias("score"))
                )
            ).alias("far")
        )
    )

    def outlier(i: int) -> Column:
        name, score = F.get("far", i)["category"], F.get("far", i)["score"]
        return F.when(
            score > 2,
            _text("'%s' significantly outperforms average (z-score: %s)", name, fixed(score, 2)),
        ).when(
            score < -2,
            _text("'%s' significantly underperforms average (z-score: %s)", name, fixed(score, 2)),
        )

    sentences = [
        F.when(
            F.col("top").isNotNull(),
            _text(
                "Focus on '%s' category - consistently high ratings (%s)",
                F.col("top.category"), fixed(F.col("top.avg_rating"), 2),
            ),
        ),
        F.when(
            F.col("low").isNotNull(),
            _text(
                "Investigate '%s' category - below average ratings (%s)",
                F.col("low.category"), fixed(F.col("low.avg_rating"), 2),
            ),
        ),
        F.when(
            F.col("loose").isNotNull(),
            _text(
                "Review quality control for '%s' - high rating variability (σ=%s)",
                F.col("loose.category"), fixed(F.col("loose.rating_stddev"), 2),
            ),
        ),
        F.when(
            F.col("tight").isNotNull(),
            _text(
                "'%s' shows consistent quality - good benchmark for other categories",
                F.col("tight.category"),
            ),
        ),
        outlier(0),
        outlier(1),
    ]
    found = F.array_compact(F.array(*sentences))
    if most is not None:
        found = F.slice(found, 1, most)
    return picks.crossJoin(F.broadcast(outliers)).select(found.alias("recommendations"))


def recommendations(hist: DataFrame, most: int | None = None) -> DataFrame:
    """``position, recommendation``: all that apply, or the first ``most``."""
    return (
        _recommendation_row(hist, most)
        .select(F.posexplode("recommendations").alias("p", "recommendation"))
        .select((F.col("p") + 1).alias("position"), "recommendation")
    )


def analysis_summary(table: DataFrame) -> DataFrame:
    """Four rows: the best and worst rated and the most and least variable category."""
    roles = (
        ("highest_rated", "highest_rated"), ("lowest_rated", "lowest_rated"),
        ("highest_variability", "most_stddev"), ("lowest_variability", "least_stddev"),
    )
    rows = F.array(
        *[F.struct(F.lit(role).alias("role"), F.col(pick).alias("r")) for role, pick in roles]
    )
    return (
        category_extremes(table)
        .filter(F.col("categories") > 0)
        .select(F.explode(rows).alias("x"))
        .select("x.role", "x.r.*")
    )


def performance_summary(hist: DataFrame) -> DataFrame:
    """Scale of the analysed data in one row."""
    sizes = category_table(hist).agg(
        F.count("*").alias("categories_analyzed"),
        F.count_if(F.col("significance_level") == _SIGNIFICANT).alias("significant_categories"),
        round_half_away(F.avg("product_count"), 1).alias("average_products_per_category"),
        F.max("product_count").alias("largest_category_size"),
        F.min("product_count").alias("smallest_category_size"),
    )
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_products"))
    return total.crossJoin(F.broadcast(sizes))


def performance_extremes(table: DataFrame, limit: int = 3) -> DataFrame:
    """The first and last ``limit`` categories of the report, in report order."""
    columns = ("category", "avg_rating", "product_count")

    def block(name: str, rows: DataFrame) -> DataFrame:
        key = F.struct(
            (-F.col("mean")).alias("m"), (-F.col("product_count")).alias("c"), *columns
        )
        return rows.agg(F.sort_array(F.collect_list(key)).alias("rows")).select(
            F.lit(name).alias("block"), F.posexplode("rows").alias("p", "r")
        ).select("block", (F.col("p") + 1).alias("position"), *[F.col(f"r.{c}").alias(c) for c in columns])

    first = table.orderBy(*report_order()).limit(limit)
    last = table.orderBy(*reverse_report_order()).limit(limit)
    return block("top", first).unionByName(block("bottom", last))


def analysis_metadata(hist: DataFrame) -> DataFrame:
    """Size of the data set and number of categories analysed."""
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dataset_size"))
    found = category_table(hist).agg(F.count("*").alias("categories_analyzed"))
    return total.crossJoin(F.broadcast(found))


def quick_summary(hist: DataFrame) -> DataFrame:
    """Rows, categories, best category and the three fixed headline figures."""
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dataset_scale"))
    facts = _facts(hist).crossJoin(F.broadcast(total))
    return facts.select(
        "dataset_scale",
        F.col("categories").alias("categories_count"),
        F.lit(0).alias("analysis_duration"),
        F.col("best.category").alias("top_category"),
        F.col("best.avg_rating").alias("top_category_rating"),
        F.lit(3).alias("key_insights_count"),
        _text(
            "Analyzing %s products across %s categories",
            fixed(F.col("dataset_scale"), 0), F.col("categories").cast("string"),
        ).alias("insight_1"),
        _text(
            "Overall average rating: %s", fixed(F.col("overall_average_rating"), 2)
        ).alias("insight_2"),
        _text(
            "High-rated products: %s%%", fixed(F.col("high_rated_percentage"), 1)
        ).alias("insight_3"),
    )


def _numbered(lines: Column) -> Column:
    """``1. first``, ``2. second`` ... for a list of sentences."""
    return F.transform(lines, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))


def _lines(df: DataFrame, blocks: list[Column], section: int) -> DataFrame:
    return (
        df.select(F.posexplode(F.flatten(F.array(*blocks))).alias("p", "text"))
        .select(F.lit(section).alias("section"), F.col("p").cast("bigint").alias("line"), "text")
    )


def executive_summary(
    hist: DataFrame,
    analysis_date: str,
    duration_seconds: float = 0.0,
    title: str = "PRODUCT CATALOGUE - LARGE-SCALE ANALYSIS EXECUTIVE SUMMARY",
) -> DataFrame:
    """``line_no, text``: the summary report of one analysis run."""
    table = category_table(hist)
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dataset_size"))
    best = (
        performance_extremes(table)
        .filter(F.col("block") == "top")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("position", "category", "avg_rating", "product_count"))
            ).alias("best_rows")
        )
    )
    facts = _facts(hist).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(best))

    def text(*lines) -> Column:
        return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])

    size = fixed(F.col("dataset_size"), 0)
    blocks = [
        text(
            title, "=" * 70, "",
            f"Analysis Date: {analysis_date}",
            _text("Dataset Size: %s products", size),
            f"Analysis Duration: {duration_seconds} seconds",
            _text("Categories Analyzed: %s", F.col("categories").cast("string")),
            "", "KEY FINDINGS", "-" * 20,
        ),
        _numbered(_finding_list()),
        text("", "TOP PERFORMING CATEGORIES", "-" * 25),
        F.transform(
            "best_rows",
            lambda r: _text(
                "• %s: %s avg rating (%s products)",
                r["category"], fixed(r["avg_rating"], 2), fixed(r["product_count"], 0),
            ),
        ),
        text(
            "", "SCALABILITY PERFORMANCE", "-" * 22,
            _text(f"Query Performance: {duration_seconds:.2f}s for %s rows", size),
            "Memory Efficiency: Optimized for large datasets",
            "Indexing Strategy: Rating histogram per category",
        ),
    ]
    return _lines(facts, blocks, 0).select((F.col("line") + 1).alias("line_no"), "text")


def category_report(
    hist: DataFrame,
    analysis_date: str,
    title: str = "PRODUCT CATALOGUE - CATEGORY ANALYSIS REPORT",
    most: int | None = None,
) -> DataFrame:
    """``section, line, text``: the full category report, to be written in that order.

    The table section has one line per category and is numbered with ``number_rows``,
    so it never gathers in one task.
    """
    table = category_table(hist)
    top = (
        zscore_table(hist)
        .orderBy(F.desc_nulls_last(F.abs("z")), "category")
        .limit(5)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.abs("z")).alias("far"), "category", "z_score", "significance_level")
                )
            ).alias("outliers")
        )
    )
    facts = (
        _facts(hist)
        .crossJoin(F.broadcast(_recommendation_row(hist, most)))
        .crossJoin(F.broadcast(top))
    )

    def text(*lines) -> Column:
        return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])

    def profile(pick: str) -> list:
        return [
            _text("Category: %s", F.col(f"{pick}.category")),
            _text("Average Rating: %s", fixed(F.col(f"{pick}.avg_rating"), 3)),
            _text("Product Count: %s", fixed(F.col(f"{pick}.product_count"), 0)),
            "",
        ]

    def spread(label: str, pick: str) -> Column:
        return _text(
            f"{label}: %s (σ=%s)", F.col(f"{pick}.category"), fixed(F.col(f"{pick}.rating_stddev"), 3)
        )

    head = [
        text("=" * 60, title, "=" * 60, "", f"Analysis Date: {analysis_date}", ""),
        text(
            "EXECUTIVE SUMMARY", "-" * 20,
            _text("Total Categories Analyzed: %s", F.col("categories").cast("string")),
            _text("Overall Average Rating: %s", fixed(F.col("overall_average_rating"), 3)),
            "",
            "TOP PERFORMING CATEGORY", *profile("highest_rated"),
            "LOWEST PERFORMING CATEGORY", *profile("lowest_rated"),
            "RATING VARIABILITY", "-" * 20,
            spread("Most Variable", "most_stddev"),
            spread("Most Consistent", "least_stddev"),
            "",
        ),
        F.when(
            F.size("recommendations") > 0,
            F.concat(
                text("KEY RECOMMENDATIONS", "-" * 20), _numbered(F.col("recommendations")), text("")
            ),
        ).otherwise(F.array().cast("array<string>")),
        text(
            "STATISTICAL ANALYSIS", "-" * 20,
            _text("Total Products: %s", fixed(F.col("total_products"), 0)),
            _text("Overall Standard Deviation: %s", fixed(F.col("overall_stddev"), 3)),
            "", "Z-Score Analysis (Categories vs. Overall Mean):",
        ),
        F.transform(
            "outliers",
            lambda r: _text(
                "  %s: z=%s (%s)",
                r["category"], F.coalesce(fixed(r["z_score"], 2), F.lit("0.00")), r["significance_level"],
            ),
        ),
        text(
            "", "=" * 60, "DETAILED CATEGORY STATISTICS", "=" * 60,
            f"{'Category':<20} {'Count':<8} {'Avg':<6} {'StdDev':<8} {'Min':<6} {'Max':<6} {'High%':<8}",
            "-" * 70,
        ),
    ]

    def cell(value: Column, width: int) -> Column:
        return F.when(F.length(value) >= width, value).otherwise(F.rpad(value, width, " "))

    body = number_rows(
        table, [F.desc("avg_rating"), *report_order()], id_col="line"
    ).select(
        F.lit(1).alias("section"),
        "line",
        F.concat_ws(
            " ",
            cell(F.col("category"), 20),
            cell(fixed(F.col("product_count"), 0), 8),
            cell(fixed(F.col("avg_rating"), 2), 6),
            cell(fixed(F.col("rating_stddev"), 3), 8),
            cell(fixed(F.col("min_rating").cast("double"), 1), 6),
            cell(fixed(F.col("max_rating").cast("double"), 1), 6),
            cell(fixed(F.col("high_rating_percentage"), 1), 8),
        ).alias("text"),
    )
    tail = [text("", "=" * 60, "End of Report", "=" * 60)]
    return (
        _lines(facts, head, 0).unionByName(body).unionByName(_lines(hist.sparkSession.range(1), tail, 2))
    )
