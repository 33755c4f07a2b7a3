"""Whole analysis runs: load, analyse, export."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession

from shelfscope.operators import category, findings, overall, prices, quality
from shelfscope.operators.histogram import rating_histogram
from shelfscope.session import durable, stored
from shelfscope.sources import catalog, sinks


def category_analysis(products: DataFrame, as_of: str = "") -> dict[str, DataFrame]:
    """The smaller run: statistics, distribution, summary and recommendations.

    The histogram is made durable once (it is bounded by categories x 1,000 rows), so
    the products are read a single time for all results.
    """
    hist = durable(rating_histogram(products))
    table = category.category_table(hist)
    return {
        "category_stats": category.category_stats(hist),
        "rating_distribution": overall.rating_distribution(hist),
        "overall_stats": overall.overall_stats(hist),
        "zscore_categories": category.zscore_categories(hist),
        "rating_distribution_overall": overall.rating_distribution_overall(hist),
        "variability_top": category.variability(hist, highest=True),
        "variability_bottom": category.variability(hist, highest=False),
        "analysis_summary": findings.analysis_summary(table),
        "recommendations": findings.recommendations(hist),
    }


def comprehensive_analysis(products: DataFrame) -> dict[str, DataFrame]:
    """The full run. Every result is lazy; only the histogram has been computed.

    ``category_stats`` carries the coefficient of variation, as the variability step
    adds it to the shared report.
    """
    hist = durable(rating_histogram(products))
    table = durable(category.category_table(hist))
    ordered = category.with_variation(table).orderBy(*category.report_order())
    return {
        "analysis_metadata": findings.analysis_metadata(hist),
        "category_stats": ordered.select(*category.STATS_COLUMNS, "coefficient_of_variation"),
        "overall_stats": overall.overall_stats(hist),
        "zscore_categories": category.zscore_categories(hist),
        "category_significance": category.category_significance(hist),
        "rating_distribution_overall": overall.rating_distribution_overall(hist),
        "rating_distribution": overall.rating_distribution(hist),
        "variability_top": category.variability(hist, highest=True),
        "variability_bottom": category.variability(hist, highest=False),
        "variability_rankings": category.variability_rankings(table),
        "variability_summary": category.variability_summary(table),
        "performance_summary": findings.performance_summary(hist),
        "performance_extremes": findings.performance_extremes(table),
        "key_findings": findings.key_findings(hist),
    }


def market_analysis(products: DataFrame) -> dict[str, DataFrame]:
    """Size, price and quality per category."""
    return {
        "market_share": category.market_share(products),
        "price_stats": prices.price_stats(products),
        "premium_categories": category.premium_categories(
            category.category_table(rating_histogram(products))
        ),
    }


def load_checked(
    spark: SparkSession, path: str, target: str, aliases: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Validate a CSV catalogue, then load it: (validation row, loaded table).

    The text is parsed once; both halves read the typed rows.
    """
    rows = stored(catalog.typed(catalog.csv_scan(spark, path, aliases, with_broken=True)), "typed", "zstd")
    validation = quality.validate_dataset(rows.drop("rejected"))
    catalog.number_rows(catalog.usable(rows)).write.mode("overwrite").parquet(target, compression="zstd")
    return validation, spark.read.parquet(target)


def run(spark: SparkSession, source: str, output: str, run_ts: str) -> dict[str, str]:
    """CSV in, one result folder per run out: JSON and CSV results, the reports and
    ``run_metrics`` (time stamp, rows read, rejected and kept, seconds per block and in all)."""
    began = time.perf_counter()
    counts = Observation("load")
    loaded = catalog.load_catalog(spark, source, f"{output}/catalog", counts=counts)
    seconds = {"load": time.perf_counter() - began}
    results = comprehensive_analysis(loaded)
    folder = f"{output}/run_ts={run_ts}"
    written = {}
    for block, df in results.items():
        start = time.perf_counter()
        written |= sinks.export_analysis({block: df}, folder)
        seconds[block] = time.perf_counter() - start
    hist = durable(rating_histogram(loaded))
    reports = {
        "executive_summary": (findings.executive_summary(hist, run_ts), ("line_no",)),
        "category_report": (findings.category_report(hist, run_ts), ("section", "line")),
    }
    for name, (lines, order) in reports.items():
        written[name] = f"{folder}/{name}"
        start = time.perf_counter()
        sinks.write_text(lines, written[name], order)
        seconds[name] = time.perf_counter() - start
    row = counts.get | {"run_ts": run_ts, "seconds": time.perf_counter() - began, "block_seconds": seconds}
    written["run_metrics"] = f"{folder}/run_metrics"
    metrics = spark.createDataFrame(
        [row],
        "run_ts string, read bigint, rejected bigint, kept bigint, seconds double, block_seconds map<string,double>",
    )
    sinks.write_json(metrics, written["run_metrics"])
    return written
