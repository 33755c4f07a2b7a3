"""Crawl sessions and crawl metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions.numeric import clean_records, round_half_away
from shelfscope.operators.numbering import number_rows


def _mean_time() -> Column:
    """Mean of the DECIMAL(10,3) times from an exact sum."""
    total = F.sum((F.col("scraping_time") * 1000).cast("decimal(38,0)")).cast("double")
    known = F.count("scraping_time") * F.lit(1000.0)
    return round_half_away(total / F.nullif(known, F.lit(0.0)), 6)


def method_performance(metrics: DataFrame) -> DataFrame:
    """Sessions, mean time and reviews per crawl method."""
    return (
        metrics.groupBy("scraping_method")
        .agg(
            F.count("*").alias("total_scraping_sessions"),
            _mean_time().alias("avg_scraping_time"),
            F.sum("total_reviews").alias("total_reviews_scraped"),
            F.count("*").alias("method_count"),
        )
        .orderBy(F.asc_nulls_last("scraping_method"))
    )


def recent_activity(metrics: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Sessions and reviews per day over the ``days`` before ``as_of`` and since."""
    start = F.lit(str(as_of - dt.timedelta(days=days))).cast("timestamp_ntz")
    return (
        metrics.filter(F.col("timestamp") >= start)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.count("*").alias("sessions"), F.sum("total_reviews").alias("reviews"))
        .orderBy(F.desc("date"))
    )


def session_totals(metrics: DataFrame) -> DataFrame:
    """One row over all metrics, 0 where there is nothing to report."""
    return metrics.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(_mean_time(), F.lit(0.0)).alias("avg_time"),
        F.coalesce(F.min("scraping_time"), F.lit(0).cast("decimal(10,3)")).alias("min_time"),
        F.coalesce(F.max("scraping_time"), F.lit(0).cast("decimal(10,3)")).alias("max_time"),
        F.coalesce(F.sum("total_reviews"), F.lit(0)).alias("total_reviews"),
    )


def analytics_summary(metrics: DataFrame, as_of: dt.date) -> dict[str, DataFrame]:
    """The three blocks of the crawl summary, with NaN and infinities cleaned."""
    return {
        "overall_stats": clean_records(session_totals(metrics)),
        "method_performance": clean_records(method_performance(metrics)),
        "recent_activity": clean_records(recent_activity(metrics, as_of)),
    }


def append_metrics(store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str) -> DataFrame:
    """The batch with defaults filled and numbered behind the largest stored id."""
    filled = batch.select(
        F.col(order).alias("_order"),
        F.col("product_id").cast("bigint").alias("product_id"),
        F.coalesce(F.col("total_reviews").cast("bigint"), F.lit(0).cast("bigint")).alias("total_reviews"),
        F.coalesce("scraping_method", F.lit("unknown")).alias("scraping_method"),
        F.coalesce(F.col("scraping_time").cast("decimal(10,3)"), F.lit(0).cast("decimal(10,3)")).alias("scraping_time"),
        F.coalesce("timestamp", F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")).alias("timestamp"),
    )
    top = store.agg(F.max("id").alias("top"))
    return number_rows(filled, ["_order"], after=top).drop("_order")


def append_sessions(store: DataFrame, batch: DataFrame, as_of: dt.datetime, order: str) -> DataFrame:
    """Session records with defaults filled and numbered behind the largest stored id."""
    filled = batch.select(
        F.col(order).alias("_order"),
        "url",
        "method_used",
        F.coalesce("success", F.lit(False)).alias("success"),
        "error_message",
        F.coalesce(F.col("total_reviews_extracted").cast("int"), F.lit(0)).alias("total_reviews_extracted"),
        F.col("duration_seconds").cast("double").alias("duration_seconds"),
        F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz").alias("created_at"),
    )
    numbered = number_rows(filled, ["_order"], after=store.agg(F.max("id").alias("top")))
    return numbered.drop("_order")


def expire_sessions(sessions: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Sessions to keep: those not older than ``days`` before ``as_of``.

    On a table partitioned by day the filter drops whole partitions before reading.
    """
    limit = F.lit((as_of - dt.timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")
    return sessions.filter(F.col("created_at").isNull() | (F.col("created_at") >= limit))
