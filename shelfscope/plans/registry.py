"""Every query by name: ``(spark, sf_dir) -> DataFrame`` over the raw tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DateType, DecimalType, StringType

from shelfscope.functions import dates, text, urls
from shelfscope.functions.text import title_category
from shelfscope.operators import (
    category, findings, imports, overall, pages, prices, quality, review_json, sessions, store,
)
from shelfscope.operators.histogram import rating_histogram
from shelfscope.plans import analysis
from shelfscope.session import durable, work_path
from shelfscope.sources import catalog, sinks, tables, versions
from shelfscope.streaming import streams
from shelfscope.views import dealt_view, stream_view, table, view

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = "2024-01-31"
_DAY = dt.date(2024, 1, 31)
_MOMENT = dt.datetime(2024, 1, 31)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and text arrays as text: easy to compare anywhere."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            c = F.array_join(c, "; ")
        out.append(c.alias(f.name))
    return df.select(*out)


def _on_hist(fn: Callable[[DataFrame], DataFrame], several: bool = False) -> Query:
    """``fn`` over the rating histogram. Where its plan uses the histogram in ``several``
    ways, the histogram is made durable, so that the products are read once."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        hist = rating_histogram(view(spark, sf, "amazon_products"))
        return plain(fn(durable(hist) if several else hist))

    return query


def _on_table(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_hist(lambda hist: fn(category.category_table(hist)))


def _on_view(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: plain(fn(view(spark, sf, name)))


def _on_lines(name: str, fn: Callable[[DataFrame], DataFrame]) -> Query:
    """``fn`` over a view that has a row per line of ``lineitem``."""
    return lambda spark, sf: plain(fn(dealt_view(spark, sf, name, "lineitem")))


def _custom_sql(spark: SparkSession, sf: str) -> DataFrame:
    frames = {"amazon_products": view(spark, sf, "amazon_products")}
    return plain(
        tables.custom_sql(
            spark,
            frames,
            "select about_product, count(*) as products, max(actual_price) as top_price "
            "from amazon_products where rating_count > 10 group by about_product",
        )
    )


ANALYSIS: dict[str, Query] = {
    "category_stats": _on_hist(category.category_stats),
    "overall_stats": _on_hist(overall.overall_stats, several=True),
    "category_significance": _on_hist(category.category_significance),
    "zscore_categories": _on_hist(category.zscore_categories),
    "rating_distribution_overall": _on_hist(overall.rating_distribution_overall),
    "rating_distribution": _on_hist(overall.rating_distribution),
    "variability_top": _on_hist(lambda h: category.variability(h, highest=True)),
    "variability_bottom": _on_hist(lambda h: category.variability(h, highest=False)),
    "variability_rankings": _on_table(category.variability_rankings),
    "variability_summary": _on_table(category.variability_summary),
    "performance_summary": _on_hist(findings.performance_summary),
    "performance_extremes": _on_table(findings.performance_extremes),
    "analysis_summary": _on_table(findings.analysis_summary),
    "key_findings": _on_hist(findings.key_findings, several=True),
    "recommendations": _on_hist(lambda h: findings.recommendations(h, most=5), several=True),
    "analysis_metadata": _on_hist(findings.analysis_metadata),
    "quick_summary": _on_hist(findings.quick_summary),
    "executive_summary": _on_hist(lambda h: findings.executive_summary(h, AS_OF), several=True),
    "category_report": _on_hist(lambda h: findings.category_report(h, AS_OF, most=5), several=True),
    "validate_dataset": _on_view("amazon_products", quality.validate_dataset),
    "dataset_info": _on_view("amazon_products", quality.dataset_info),
    "top_categories": _on_view("amazon_products", quality.top_categories),
    "market_share": _on_view("amazon_products", category.market_share),
    "price_stats": _on_view("amazon_products", prices.price_stats),
    "premium_categories": _on_table(lambda t: category.premium_categories(t, over=50.0)),
    "custom_sql": _custom_sql,
}



# --- catalogue files ---------------------------------------------------------------


def _clean_file(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "catalog-csv")
    catalog.write_csv(view(spark, sf, "amazon_products"), path, packed=True)
    return path


def _dirty_file(spark: SparkSession, sf: str) -> str:
    """The catalogue as CSV with unreadable ratings, fractional counts and short rows."""
    products = view(spark, sf, "amazon_products")
    n = F.col("rating_count")

    def quoted(name: str):
        text = F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(text, F.lit(""))

    def bare(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    rating = F.when(n == 13, F.lit("n/a")).otherwise(bare("rating"))
    count = F.when(n == 17, F.lit("17.5")).otherwise(bare("rating_count"))
    head = F.concat_ws(
        ",", quoted("title"), quoted("category"), bare("discounted_price"), bare("actual_price"),
        bare("discount_percentage"), rating, count,
    )
    names = products.columns
    rest = F.concat_ws(",", *[quoted(c) for c in names[7:]])
    line = F.when(n == 11, head).otherwise(F.concat_ws(",", head, rest))
    path = work_path(spark, "dirty-csv")
    (
        products.select(line.alias(",".join(names)))
        .write.options(header="true", sep="\x01", quote="", escapeQuotes="false", **catalog.PACKED)
        .csv(path)
    )
    return path


def _csv_line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue from CSV with line breaks, quotes and blank lines inside quoted texts."""
    products = view(spark, sf, "amazon_products")
    broken = F.concat(F.col("review_content"), F.lit('\nsecond, "line"\n\n\r\n'), F.col("review_id"))
    path = work_path(spark, "breaks-csv")
    catalog.write_csv(products.withColumn("review_content", broken), path, packed=True)
    rows = catalog.typed(catalog.csv_scan(spark, path, multi_line=True, with_broken=True))
    return plain(rows.select("review_id", "title", "category", "rating", "rating_count", "review_content", "rejected"))


def _load_catalog(spark: SparkSession, sf: str) -> DataFrame:
    target = work_path(spark, "catalog")
    loaded = catalog.load_catalog(spark, _clean_file(spark, sf), target, order_by=["review_id"])
    return plain(loaded)


def _load_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that the load itself reports."""
    counts = Observation("load")
    catalog.load_catalog(spark, _dirty_file(spark, sf), order_by=["review_id"], counts=counts)
    return spark.createDataFrame([counts.get], "read bigint, rejected bigint, kept bigint")


def _load_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The validation row beside the loaded rows."""
    validation, loaded = analysis.load_checked(spark, _dirty_file(spark, sf), work_path(spark, "checked"))
    totals = loaded.agg(
        F.count("*").alias("loaded"), F.max("id").alias("last_id"), F.countDistinct("id").alias("ids")
    )
    return plain(validation.drop("recommendations").join(F.broadcast(totals)))


def _replace_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products of the batch's parts replace stored ones by id, unseen ones are added."""
    held = imports.import_products(view(spark, sf, "products"))
    newer = held.filter(F.col("review_count") > 25).withColumns(
        {"id": F.col("id") * 2, "title": F.concat(F.lit("new "), F.col("title")), "seq": F.col("id") % 3}
    )
    # every third id comes again, earlier in the batch
    again = newer.filter(F.col("seq") == 0).withColumns({"seq": F.lit(-1), "title": F.lit("old")})
    return plain(imports.replace_by_id(held, newer.unionByName(again), "seq"))


def _load_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.load_counts(catalog.typed(catalog.csv_scan(spark, _dirty_file(spark, sf))))


def _load_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.usable(catalog.typed(catalog.csv_scan(spark, _clean_file(spark, sf))))
    return plain(quality.load_summary(rows))


def _export_results(spark: SparkSession, sf: str) -> DataFrame:
    """Run the smaller analysis, write its files and read the category CSV back."""
    folder = work_path(spark, "export")
    results = analysis.category_analysis(view(spark, sf, "amazon_products"))
    written = sinks.export_analysis(results, folder)
    return spark.read.options(header="true", inferSchema="false").csv(written["category_stats"])


def _rejected_values(products: DataFrame) -> DataFrame:
    """Ratings and prices as doubles, some of them beyond the analysis schema."""
    odd = products.withColumns(
        {
            "rating": F.col("rating").cast("double") * F.when(F.col("rating_count") % 5 == 0, 4.0).otherwise(1.0),
            "discounted_price": F.col("discounted_price").cast("double")
            * F.when(F.col("rating_count") % 7 == 0, 1e6).otherwise(1.0),
        }
    )
    return quality.rejected_values(odd)


SOURCES: dict[str, Query] = {
    "csv_scan": lambda spark, sf: catalog.csv_scan(spark, _dirty_file(spark, sf)),
    "csv_line_breaks": _csv_line_breaks,
    "load_catalog": _load_catalog,
    "load_counts": _load_counts,
    "load_summary": _load_summary,
    "load_rejects": _load_rejects,
    "load_checked": _load_checked,
    "import_products": _on_view("products", imports.import_products),
    "import_reviews": _on_view("reviews", imports.import_reviews),
    "replace_products": _replace_products,
    "imported_category_stats": lambda spark, sf: plain(
        category.category_stats(
            durable(rating_histogram(imports.import_products(view(spark, sf, "products"))))
        )
    ),
    "rejected_values": _on_view("amazon_products", _rejected_values),
    "table_info": lambda spark, sf: tables.table_info(view(spark, sf, "products")),
    "export_results": _export_results,
}

# --- product and review store ------------------------------------------------------


def _on_views(names: tuple[str, ...], fn: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: plain(fn(*[view(spark, sf, n) for n in names]))


def _nested(products: DataFrame, reviews: DataFrame) -> DataFrame:
    docs = store.products_nested(products, reviews)
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd"}
    return docs.withColumn("reviews", F.to_json("reviews", options))


def _nested_parts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Short parts, so that every product has several; some reviews have no id."""
    reviews = reviews.withColumn("id", F.when(F.col("id") % 13 != 0, F.col("id")))
    docs = store.products_nested(products, reviews, per_document=7)
    ids = F.transform("reviews", lambda r: F.concat_ws(" ", r["title"], r["body"]))
    return docs.select("id", "part", F.array_join(ids, ";").alias("reviews"))


def _some_undated(products: DataFrame) -> DataFrame:
    """Every seventh product without a date."""
    return products.withColumn("created_at", F.when(F.col("id") % 7 != 0, F.col("created_at")))


def _expire_stored(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "sessions")
    sinks.write_sessions(view(spark, sf, "scraping_sessions"), path)
    sinks.expire_stored_sessions(spark, path, dt.datetime(2024, 1, 31, 13, 30), days=14)
    return plain(sinks.read_sessions(spark, path))


def _table_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of the product table, the second by changes, the third compacted."""
    path = work_path(spark, "versions")
    products = view(spark, sf, "products").select("id", "title", "price")
    first = sinks.replace_table(products, path)
    newer = products.filter("id % 10 = 3").withColumn("title", F.upper("title"))
    added = products.filter("id % 10 = 4").withColumn("id", -F.col("id"))
    second = versions.change(path, newer.unionByName(added), "id", gone=products.filter("id % 10 = 5"))
    # a writer that stops before its commit changes nothing
    versions.write_folder(products.limit(0), path)
    third = versions.compact(spark, path)
    rows = [versions.read(spark, path, v).withColumn("version", F.lit(v)) for v in (first, second, third)]
    return plain(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def _stored_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """A product by URL, one by id, and a product's reviews from tables laid out for it."""
    products, reviews = work_path(spark, "products"), work_path(spark, "by-product")
    sinks.write_products(view(spark, sf, "products"), products, buckets=64)
    sinks.write_reviews_of_products(view(spark, sf, "reviews"), reviews, buckets=64)
    by_url = sinks.stored_product_by_url(spark, products, "https://shop.example/p/42", 64)
    by_id = sinks.stored_product_by_id(spark, products, 44)
    own = sinks.stored_reviews_of(spark, reviews, 17, 64)
    return (
        by_url.select(F.lit("url").alias("way"), "id", "title")
        .unionByName(by_id.select(F.lit("id").alias("way"), "id", "title"))
        .unionByName(own.select(F.lit("reviews").alias("way"), "id", F.col("body").alias("title")))
    )


def _delete(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").filter(
        (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    )
    ids = returned.select((F.col("l_partkey") + 1).alias("id"))
    return store.delete_products(view(spark, sf, "products"), ids)


def _search(products: DataFrame) -> DataFrame:
    labelled = products.withColumn("category", title_category(F.col("title")))
    return store.search_products(
        labelled, category="Memory", min_price=900, max_price=1200, min_rating=2.5
    )


def _analytics_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The three blocks of the crawl summary as (block, key, sessions, reviews, mean time),
    over metrics with gaps: NaN, infinite and missing means are 0."""
    metrics = view(spark, sf, "scraping_analytics")
    blocks = sessions.analytics_summary(
        metrics.withColumn("scraping_time", F.when(F.col("scraping_method") != "error", F.col("scraping_time"))), _DAY
    )
    whole, methods, days = (blocks[k] for k in ("overall_stats", "method_performance", "recent_activity"))

    def rows(block: str, df: DataFrame, key, sessions_, reviews, mean) -> DataFrame:
        return df.select(
            F.lit(block).alias("block"), key.cast("string").alias("key"), F.col(sessions_).alias("sessions"),
            F.col(reviews).alias("reviews"), mean.cast("double").alias("mean_time"),
        )

    return (
        rows("all", whole, F.lit(None), "total_sessions", "total_reviews", F.col("avg_time"))
        .unionByName(rows("method", methods, F.col("scraping_method"), "total_scraping_sessions", "total_reviews_scraped", F.col("avg_scraping_time")))
        .unionByName(rows("day", days, F.col("date"), "sessions", "reviews", F.lit(0.0)))
    )


def _append_metrics(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("product_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 40).alias("total_reviews"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("scraping_method"),
        F.col("o_totalprice").alias("scraping_time"),
        F.col("o_orderdate").alias("timestamp"),
    )
    metrics = view(spark, sf, "scraping_analytics")
    return plain(sessions.append_metrics(metrics, batch, _MOMENT, "o_orderkey"))


def _append_sessions(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    batch = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("https://shop.example/p/"), F.col("o_custkey").cast("string")).alias("url"),
        F.col("o_orderpriority").alias("method_used"),
        F.when(done, F.lit(True)).alias("success"),
        F.when(~done, F.lit("timeout")).alias("error_message"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 40).alias("total_reviews_extracted"),
        F.col("o_totalprice").alias("duration_seconds"),
    )
    known = view(spark, sf, "scraping_sessions")
    return sessions.append_sessions(known, batch, _MOMENT, "o_orderkey")


STORE: dict[str, Query] = {
    "categorize_titles": _on_view(
        "products",
        lambda p: p.select("id", "title", title_category(F.col("title")).alias("category")),
    ),
    "merge_products": _on_views(
        ("products", "product_batch"), lambda p, b: store.merge_products(p, b, _MOMENT)
    ),
    "new_reviews": _on_views(
        ("reviews", "review_batch"), lambda r, b: store.new_reviews(r, b, _MOMENT)
    ),
    "delete_products": _delete,
    "table_versions": _table_versions,
    "stored_lookups": _stored_lookups,
    "product_by_url": _on_view(
        "products", lambda p: store.product_by_url(p, "https://shop.example/p/42")
    ),
    "product_by_id": _on_view("products", lambda p: store.product_by_id(p, 43)),
    "reviews_page": _on_view("reviews", lambda r: store.reviews_page(r, 17, limit=10, offset=5)),
    "reviews_by_product": _on_view("reviews", lambda r: store.reviews_by_product(r, 17)),
    "product_with_reviews": _on_views(
        ("products", "reviews"), lambda p, r: store.product_with_reviews(p, r, 17)
    ),
    "products_summary": _on_views(("products", "reviews"), store.products_summary),
    "review_counts": _on_views(("products", "reviews"), store.review_counts),
    "products_nested": _on_views(("products", "reviews"), _nested),
    "products_nested_parts": _on_views(("products", "reviews"), _nested_parts),
    "store_overview": _on_views(("products", "reviews", "scraping_sessions"), store.store_overview),
    "products_page": _on_view(
        "products", lambda p: store.products_page(_some_undated(p), limit=50, offset=20)
    ),
    "products_after": _on_view(
        "products", lambda p: store.products_after(_some_undated(p), dt.datetime(1990, 1, 1), 40, limit=30)
    ),
    "products_after_undated": _on_view(
        "products", lambda p: store.products_after(_some_undated(p), None, 40, limit=30)
    ),
    "search_catalogue": _on_view(
        "amazon_products",
        lambda p: store.search_products(p, text="BRAND#1", max_price=30000, min_rating=2).select(
            "review_id", "title", "discounted_price", "rating"
        ),
    ),
    "store_stats": _on_views(("products", "reviews", "scraping_sessions"), store.store_stats),
    "search_products": _on_view("products", _search),
    "products_in_category": _on_view(
        "amazon_products",
        lambda p: store.search_products(p, category="Brand#7").select(
            "title", "discounted_price", "rating", "product_link"
        ),
    ),
    "expire_sessions": _on_view(
        "scraping_sessions", lambda s: sessions.expire_sessions(s, _MOMENT, days=14)
    ),
    "expire_stored_sessions": _expire_stored,
    "method_performance": _on_view("scraping_analytics", sessions.method_performance),
    "recent_activity": _on_view(
        "scraping_analytics", lambda m: sessions.recent_activity(m, _DAY)
    ),
    "analytics_summary": _analytics_summary,
    "session_totals": _on_view("scraping_analytics", sessions.session_totals),
    "append_metrics": _append_metrics,
    "append_sessions": _append_sessions,
}


# --- text, date and URL rules ------------------------------------------------------


def _field(rule: Callable, column: str, out: str) -> Query:
    return _on_lines("field_texts", lambda t: t.select("line_id", rule(F.col(column)).alias(out)))


def _clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.clean_text(F.col("text")).alias("text"))


def _case(key: str, n: int, *branches, default):
    """A value chosen by ``key`` modulo ``n``: every row gets one of the spellings."""
    kind = F.col(key) % n
    out = default
    for i, value in branches:
        out = F.when(kind == i, value).otherwise(out)
    return out


def _valid_urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    target = _case(
        "page_id", 5,
        (1, F.expr("substring(url, 8)")),
        (2, F.concat(F.lit("mailto:"), url)),
        (4, F.replace(url, F.lit("://"), F.lit(":/"))),
        default=url,
    )
    pages = table(spark, sf, "pages").select("page_id", target.alias("target"))
    return pages.select(
        "page_id",
        "target",
        urls.is_valid_url(F.col("target")).alias("valid"),
        urls.is_shop_url(F.col("target"), "example.com").alias("shop"),
    )


def _normalize_urls(spark: SparkSession, sf: str) -> DataFrame:
    page_id = F.col("page_id").cast("string")
    links = F.concat(
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1),
        F.array(
            "url",
            F.concat(F.lit("//cdn.example.org/"), page_id),
            F.concat(F.lit("item/"), page_id, F.lit(".html")),
            F.concat(F.lit("?page="), page_id),
            F.concat(F.lit("../../up/./"), page_id, F.lit("/../x/..")),
            F.concat(F.lit("#at-"), page_id),
            F.concat(F.lit("/a/./b/../c/"), page_id, F.lit("?q=/../")),
            F.concat(F.lit("mailto:"), page_id, F.lit("@example.org")),
        ),
    )
    found = table(spark, sf, "pages").select("page_id", "url", F.explode(links).alias("link"))
    absolute = urls.normalize_url(F.col("link"), F.col("url"))
    return found.select("page_id", "link", absolute.alias("absolute"))


def _brands(products: DataFrame) -> DataFrame:
    brand, title = F.col("brand"), F.col("title")
    stated = _case(
        "id", 6,
        (0, F.concat(F.lit("Brand: "), brand)), (1, F.concat(F.lit("manufacturer:  "), brand)), (2, brand),
        default=F.lit(None).cast("string"),
    )
    name = _case(
        "id", 6,
        (3, F.concat(F.lit("intel "), title)), (4, F.concat(F.lit("Fast G.Skill Ryzen 7 "), title)),
        (5, F.concat(F.lit("AMDock "), title)),
        default=title,
    )
    return products.select("id", text.brand_of(stated, name).alias("brand"))


def _challenges(spark: SparkSession, sf: str) -> DataFrame:
    html = _case(
        "page_id", 9,
        (1, F.replace("html", F.lit("</body>"), F.lit("<p>Checking your browser</p></body>"))),
        (2, F.replace("html", F.lit("<title>"), F.lit("<title>Just a moment"))),
        default=F.col("html"),
    )
    url = _case(
        "page_id", 9, (0, F.lit("https://challenge.CloudFlare.example/x")), default=F.col("url")
    )
    pages = table(spark, sf, "pages").select("page_id", url.alias("url"), html.alias("html"))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages.select(
        "page_id",
        text.is_challenge(F.col("html"), title, F.col("url")).alias("challenge"),
        text.is_loaded(F.col("html")).alias("loaded"),
    )


TEXT: dict[str, Query] = {
    "clean_text": _clean_documents,
    "parse_price": _field(text.parse_price, "price_text", "price"),
    "parse_rating": _field(text.parse_rating, "rating_text", "rating"),
    "parse_review_count": _field(text.parse_review_count, "count_text", "review_count"),
    "parse_date": _field(dates.parse_date, "date_text", "parsed"),
    "parse_review_date": _field(dates.parse_review_date, "review_date_text", "parsed"),
    "parse_review_date_text": _field(dates.parse_review_date_text, "date_text", "parsed"),
    "verified_flag": _field(text.is_verified_purchase, "verified_text", "verified"),
    "review_key": _on_view(
        "field_texts",
        lambda t: t.select(
            "line_id",
            text.review_key(F.col("reviewer_name"), F.col("body"), F.col("review_day")).alias("review_id"),
        ),
    ),
    "valid_urls": _valid_urls,
    "normalize_urls": _normalize_urls,
    "extract_brand": _on_view("products", _brands),
    "flag_challenge_pages": _challenges,
    "review_like": lambda spark, sf: table(spark, sf, "conversations").select(
        "conv_id", "turn", text.looks_like_review(F.col("text")).alias("review_like")
    ),
}


# --- crawled pages -----------------------------------------------------------------


def _on_shop_pages(fn: Callable[[DataFrame], DataFrame], parse: bool = True) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        shop = view(spark, sf, "shop_pages").drop("url")
        return plain(fn(pages.parse_pages(shop) if parse else shop))

    return query


def _page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_titles(pages.parse_pages(table(spark, sf, "pages").drop("url")))


def _document_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")
    )
    return pages.dedup_blocks(lines, key="doc_id")


def _parse_blocks(parsed: DataFrame) -> DataFrame:
    blocks = pages.dedup_blocks(pages.review_blocks(parsed), key="page_id")
    return pages.parse_review_text(blocks)


def _records(shop: DataFrame) -> DataFrame:
    """Page records with the reviews as text, to compare them anywhere."""
    line = lambda r: F.concat_ws(
        "|", r["reviewer_name"], r["rating"].cast("int"), r["title"], r["body"], r["date"], r["verified_purchase"]
    )
    rows = review_json.pages_to_records(shop)
    return rows.select(
        "page_id", "product.title", "product.brand", "product.price", "method", "total",
        F.array_join(F.transform("reviews", line), ";").alias("reviews"),
    )


PAGES: dict[str, Query] = {
    "page_titles": _page_titles,
    "extract_products": _on_shop_pages(pages.extract_products),
    "extract_products_full": _on_shop_pages(pages.extract_products_full),
    "extract_reviews": _on_shop_pages(pages.extract_reviews),
    "jsonld_reviews": _on_shop_pages(review_json.jsonld_reviews),
    "embedded_reviews": _on_shop_pages(review_json.embedded_reviews, parse=False),
    "embedded_json_reviews": _on_shop_pages(review_json.embedded_json_reviews),
    "standardize_reviews": _on_lines("review_records", review_json.standardize_reviews),
    "parse_review_text": _on_shop_pages(_parse_blocks),
    "reviews_from_pages": _on_shop_pages(review_json.reviews_from_pages, parse=False),
    "pages_to_records": _on_shop_pages(_records, parse=False),
    "dedup_blocks": _document_lines,
    "cap_reviews": _on_view(
        "reviews",
        lambda r: pages.cap_reviews(
            r.select("product_url", F.col("id").alias("pos"), "reviewer_name", "body"), 5, "product_url"
        ),
    ),
}


# --- streams -----------------------------------------------------------------------


def _stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "products")
    sinks.write_products(view(spark, sf, "products"), path, buckets=16)
    batches = stream_view(spark, sf, "product_batch", "part")
    streams.stream_merge_products(
        batches, path, _MOMENT, work_path(spark, "offsets"), buckets=16
    ).awaitTermination()
    return spark.read.parquet(path).drop("url_bucket")


def _stream_reviews(spark: SparkSession, sf: str) -> DataFrame:
    path = work_path(spark, "reviews")
    streams.write_reviews(view(spark, sf, "reviews"), path)
    batches = stream_view(spark, sf, "review_batch", "lineitem")
    streams.stream_new_reviews(
        batches, path, _MOMENT, work_path(spark, "offsets")
    ).awaitTermination()
    added = streams.read_reviews(spark, path).filter(F.col("batch_id") >= 0)
    return added.drop("review_bucket", "stream_id", "batch_id", "id")


def _stream_category_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Category statistics from a stored histogram: it begins with two thirds of the products,
    a stream then inserts the rest with ratings that it corrects, and deletes some rows."""
    path, arriving = work_path(spark, "histogram"), work_path(spark, "changes")
    products = view(spark, sf, "amazon_products").select("category", "rating", "rating_count")
    third = F.col("rating_count") % 3 == 0
    wrong = F.struct("category", F.lit(1).cast(products.schema["rating"].dataType).alias("rating"))
    right = F.struct("category", "rating")
    none = F.lit(None).cast(products.select(right.alias("r")).schema["r"].dataType)
    # inserted with a wrong rating, then corrected; and some inserted only to be deleted
    steps = F.array(
        F.struct(none.alias("before"), wrong.alias("after")), F.struct(wrong.alias("before"), right.alias("after")),
        F.struct(none.alias("before"), wrong.alias("after")), F.struct(wrong.alias("before"), none.alias("after")),
    )
    late = products.filter(third)
    streams.write_histogram(rating_histogram(products.filter(~third | third.isNull())), path)
    late.select(F.explode(steps).alias("x")).select("x.*").repartition(6).write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    stream = streams.file_stream(spark, arriving, schema, files_per_trigger=2)
    streams.stream_rating_changes(stream, path, work_path(spark, "offsets")).awaitTermination()
    return plain(category.category_stats(durable(streams.read_histogram(spark, path))))


def _stream_totals(view_name: str, totals: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = work_path(spark, "totals")
        stream = totals(stream_view(spark, sf, view_name, "events"))
        streams.stream_totals(stream, path, work_path(spark, "offsets")).awaitTermination()
        return plain(spark.read.parquet(path))

    return query


def _rounded(df: DataFrame) -> DataFrame:
    return streams.success_rate(df).withColumn("success_rate", F.round("success_rate", 6))


STREAMS: dict[str, Query] = {
    "stream_merge_products": _stream_merge,
    "stream_new_reviews": _stream_reviews,
    "stream_category_stats": _stream_category_stats,
    "stream_daily_activity": _stream_totals("scraping_analytics", streams.daily_activity),
    "stream_success_rate": _stream_totals("scraping_sessions", _rounded),
}

QUERIES: dict[str, Query] = {**ANALYSIS, **SOURCES, **STORE, **TEXT, **PAGES, **STREAMS}
