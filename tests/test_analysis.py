"""Edge tables, invariants and plans of the category analysis."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import category, findings, overall, prices, quality
from shelfscope.operators.histogram import rating_histogram
from shelfscope.plans import analysis
from shelfscope.plans.registry import QUERIES
from shelfscope.views import view

SCHEMA = "title string, category string, rating decimal(3,2), discounted_price decimal(10,2)"


def products(spark, rows):
    return spark.createDataFrame(
        [
            (t, c, None if r is None else Decimal(str(r)), None if p is None else Decimal(str(p)))
            for t, c, r, p in rows
        ],
        SCHEMA,
    )


def test_statistics_against_plain_python(spark):
    rng = random.Random(7)
    rows = [
        (f"t{i}", rng.choice("abc"), rng.choice([1.0, 2.25, 3.5, 4.0, 4.75]), rng.randint(1, 99999) / 100)
        for i in range(400)
    ]
    hist = rating_histogram(products(spark, rows))
    got = {r["category"]: r for r in category.category_stats(hist).collect()}
    every = [r for _, _, r, _ in rows]
    for name in "abc":
        own = [r for _, c, r, _ in rows if c == name]
        assert got[name]["product_count"] == len(own)
        assert got[name]["avg_rating"] == pytest.approx(statistics.fmean(own), abs=6e-4)
        assert got[name]["rating_stddev"] == pytest.approx(statistics.pstdev(own), abs=6e-4)
        z = (statistics.fmean(own) - statistics.fmean(every)) / statistics.pstdev(every)
        assert got[name]["z_score"] == pytest.approx(z, abs=6e-3)
    priced = {r["category"]: r for r in prices.price_stats(products(spark, rows)).collect()}
    for name in "abc":
        own = [p for _, c, _, p in rows if c == name]
        assert priced[name]["median_price"] == pytest.approx(statistics.median(own), abs=1e-6)


def test_equal_ratings_have_no_z(spark):
    hist = rating_histogram(products(spark, [("a", "x", 4, 1), ("b", "x", 4, 1), ("c", "y", 4, 2)]))
    for row in category.category_stats(hist).collect():
        assert row["z_score"] is None and row["significance_level"] == "Normal"
        assert row["rating_stddev"] == 0.0


@pytest.mark.parametrize(
    "rows", [[], [("a", "x", None, None)], [("a", "", 3, 1)], [("a", None, 3, 1)]]
)
def test_tables_without_a_category_to_report(spark, rows):
    hist = rating_histogram(products(spark, rows))
    assert category.category_stats(hist).count() == 0
    assert findings.key_findings(hist).count() == 0
    rated = sum(r[2] is not None for r in rows)
    assert overall.overall_stats(hist).first()["total_products"] == rated
    assert quality.validate_dataset(products(spark, rows)).first()["dataset_size"] == len(rows)
    assert findings.performance_summary(hist).first()["total_products"] == len(rows)


def test_one_row(spark):
    hist = rating_histogram(products(spark, [("a", "x", 4.5, 10)]))
    found = [r["finding"] for r in findings.key_findings(hist).orderBy("position").collect()]
    assert found == [
        "'x' is the top-performing category with 4.50 average rating from 1 products",
        "100.0% of all products receive high ratings (4.0+)",
    ]


def test_mode_tie_takes_the_lower_rating(spark):
    hist = rating_histogram(
        products(spark, [("a", "x", 4, 1), ("b", "x", 3, 1), ("c", "x", 4, 1), ("d", "x", 3, 1)])
    )
    assert overall.overall_stats(hist).first()["mode_rating"] == Decimal("3.00")


def test_min_count(spark):
    hist = rating_histogram(products(spark, [("a", "x", 4, 1), ("b", "x", 3, 1), ("c", "y", 4, 1)]))
    assert [r["category"] for r in category.category_stats(hist, min_count=2).collect()] == ["x"]


def test_invariants(spark, sf_dir):
    hist = rating_histogram(view(spark, sf_dir, "amazon_products"))
    stats = category.category_stats(hist).collect()
    assert all(r["q1_rating"] <= r["median_rating"] <= r["q3_rating"] for r in stats)
    per_category = (
        overall.rating_distribution(hist)
        .groupBy("category")
        .agg(F.sum("percentage").alias("p"))
        .collect()
    )
    assert all(abs(r["p"] - 100) < 1e-4 for r in per_category)
    shares = overall.rating_distribution_overall(hist).agg(F.sum("percentage")).first()[0]
    assert abs(shares - 100) < 0.1


def test_products_are_scanned_once(spark, sf_dir):
    df = category.category_stats(rating_histogram(view(spark, sf_dir, "amazon_products")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("l_linenumber#") > 0
    assert plan.count("FileScan parquet [l_partkey") == 1
    assert "ReusedExchange" in plan
    scan = next(line for line in plan.splitlines() if "FileScan parquet [l_partkey" in line)
    assert "l_extendedprice" not in scan


def test_comprehensive_run(spark, sf_dir):
    results = analysis.comprehensive_analysis(view(spark, sf_dir, "amazon_products"))
    first = results["category_stats"].first()
    assert first["coefficient_of_variation"] == pytest.approx(
        first["rating_stddev"] / first["avg_rating"]
    )
    counts = {name: df.count() for name, df in results.items()}
    assert all(counts.values())
    assert counts["variability_rankings"] == 25


def test_approximate_titles(spark, sf_dir):
    df = view(spark, sf_dir, "amazon_products")
    exact = quality.validate_dataset(df).first()["unique_products"]
    rough = quality.validate_dataset(df, approximate_titles=True).first()["unique_products"]
    assert abs(rough - exact) <= 0.2 * exact


def test_double_ratings_and_prices_are_not_cut(spark):
    rows = [("a", 4.35, 1.15), ("a", 1.15, 19.99), ("a", 2.3, 8.41)]
    df = spark.createDataFrame(rows, "category string, rating double, price double")
    assert sorted(r["cents"] for r in rating_histogram(df).collect()) == [115, 230, 435]
    row = prices.price_stats(df, "price").first()
    assert (row["min_price"], row["median_price"], row["max_price"]) == (1.15, 8.41, 19.99)


@pytest.mark.parametrize(
    "name", ["key_findings", "recommendations", "executive_summary", "category_report", "overall_stats", "dataset_info"]
)
def test_products_are_read_once(spark, sf_dir, name):
    """The histogram is durable, so nothing of a report's plan reads a file."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    reads = plan.count("lineitem.parquet")
    assert reads <= (1 if name == "dataset_info" else 0)


def test_all_recommendations_by_default(spark, sf_dir):
    hist = rating_histogram(view(spark, sf_dir, "amazon_products"))
    every = findings.recommendations(hist).count()
    assert findings.recommendations(hist, most=2).count() == min(2, every)
