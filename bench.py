"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Every query runs once to warm up and then ``BENCH_RUNS`` times (default 1) into the
``noop`` sink; the mean is reported, with building and planning the query included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfscope.plans.analysis import comprehensive_analysis  # noqa: E402
from shelfscope.plans.registry import QUERIES  # noqa: E402
from shelfscope.session import build_session, use_local_folder  # noqa: E402
from shelfscope.views import view  # noqa: E402

HEADLINE = (
    "category_stats", "overall_stats", "category_significance", "zscore_categories",
    "rating_distribution", "variability_rankings", "key_findings", "recommendations",
    "validate_dataset", "dataset_info", "price_stats", "market_share", "load_catalog",
    "merge_products", "new_reviews", "products_summary", "products_nested", "store_stats",
    "method_performance", "clean_text", "parse_rating", "parse_date",
    "extract_products", "reviews_from_pages", "standardize_reviews",
)
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _full_analysis(spark, sf_dir: str) -> None:
    """The whole comprehensive run: every result block is computed."""
    for df in comprehensive_analysis(view(spark, sf_dir, "amazon_products")).values():
        _run(df)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    use_local_folder(spark)
    jobs = {"comprehensive_analysis": _full_analysis}
    for name in HEADLINE:
        jobs[name] = lambda s, d, q=QUERIES[name]: _run(q(s, d))
    seconds = {}
    for name, job in jobs.items():
        job(spark, sf_dir)
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job(spark, sf_dir)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.fmean(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "sum of mean query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
