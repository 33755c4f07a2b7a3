"""Text, date and URL rules on hand-written rows and random text."""

import datetime as dt
import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import dates, text, urls
from shelfscope.functions.numeric import clean_records, round_half_away


def column(spark, values, rule, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_price(spark):
    values = ["$1,299.99", "1,299.9", "£94.26", "from 5 to 7", "", None, "free"]
    assert column(spark, values, text.parse_price) == [1299.99, 1299.0, 94.26, 5.0, None, None, None]


def test_rating(spark):
    values = ["4.5 out of 5", "4.5/5", "3 eggs", "rating: 4", "9 stars then 4.2", "7", None]
    assert column(spark, values, text.parse_rating) == [4.5, 4.5, 3.0, 4.0, None, None, None]


def test_review_count(spark):
    values = ["(1,234 reviews)", "12 ratings", "88", "none", None]
    assert column(spark, values, text.parse_review_count) == [1234, 12, 88, None, None]


def test_date(spark):
    values = [
        "12/25/2023", "on 2023-12-25.", "December 25, 2023", "25 december 2023", "Dec 25, 2023",
        "2023-02-30", None, "",
    ]
    day = dt.date(2023, 12, 25)
    assert column(spark, values, dates.parse_date) == [day, day, day, day, None, None, None, None]


def test_review_date(spark):
    values = [
        "2022-10-28T11:59:08.95", "2022-10-28T11:59:08-05:00", "2022-10-28T11:59:08Z",
        "2022-10-28", "10/28/2022", "28/10/2022", "2022-10-28 01:02:03", "Tuesday", None, "02/03/2022",
    ]
    noon = dt.datetime(2022, 10, 28, 11, 59, 8)
    day = dt.datetime(2022, 10, 28)
    assert column(spark, values, dates.parse_review_date) == [
        noon.replace(microsecond=950000), noon, noon, day, day, day,
        dt.datetime(2022, 10, 28, 1, 2, 3), None, None, dt.datetime(2022, 2, 3),
    ]


def test_review_date_text(spark):
    values = ["2023-1-5", "2023-01-05x", "1/5/2023", "13/5/2023", "on Jan 5 2023", "May 7, 2020", "soon", None]
    assert column(spark, values, dates.parse_review_date_text) == [
        "2023-1-5", "2023-01-05x", "2023-01-05", "13/5/2023", "2023-01-05", "2020-05-07", "soon", None,
    ]


def plain_clean(value):
    if not value:
        return ""
    value = re.sub(r"\s+", " ", value.strip())
    return re.sub(r"[^\w\s\-.,!?()$%&@#]", "", value)


def test_clean_text(spark):
    rng = random.Random(3)
    pool = "ab Z9_²½é́ \t\n\r\x1c\x85 –—·©\"'<>&%$#@!?.,()-+=*/\\~^|ßжま字٣"
    values = ["a – b", "  x  ", "", None, "\x1cx\x1f"] + [
        "".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)
    ]
    assert column(spark, values, text.clean_text) == [plain_clean(v) for v in values]


def test_category_rules_in_order(spark):
    values = ["CPU cooler", "graphics", "Mobo", "picture frame", "SSD", "hdd", "desk", "cpu memory", None]
    assert column(spark, values, text.title_category) == [
        "CPU", "GPU", "Motherboard", "Memory", "Storage", "Storage", "Other", "CPU", "Other",
    ]


def test_review_key(spark):
    df = spark.createDataFrame(
        [("n", "b", None), ("n", "b", "2024"), ("", "b", None), ("n", None, None)], "n string, b string, d string"
    )
    keys = [r[0] for r in df.select(text.review_key(F.col("n"), F.col("b"), F.col("d"))).collect()]
    import hashlib

    assert keys == [
        hashlib.md5(b"nbNone").hexdigest()[:16], hashlib.md5(b"nb2024").hexdigest()[:16], None, None,
    ]


def test_verified(spark):
    values = ["VERIFIED BUYER", "unverified", None, "a confirmed purchase"]
    assert column(spark, values, text.is_verified_purchase) == [True, False, False, True]


def test_looks_like_review(spark):
    values = ["I recommend it", "plain words", "verified " + "summary", None]
    assert column(spark, values, text.looks_like_review) == [True, False, False, False]


def test_urls(spark):
    values = ["http://a.b/c", "ftp://x", "mailto:a@b", "//a/b", "http:///x", "", None, "http://[::1/x"]
    assert column(spark, values, urls.is_valid_url) == [True, True, False, False, False, False, False, False]


@pytest.mark.parametrize("base", ["https://a.b/c/d?x=1#y", ""])
def test_join(spark, base):
    links = ["../e", "/f", "?q=2", "#z", "g/h", "//o.p/q", "http://x.y", "", "./../../k"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(links)], "i int, v string")
    got = df.orderBy("i").select(urls.normalize_url(F.col("v"), F.lit(base)).alias("u")).collect()
    want = [v if v.startswith("http") or not base else urljoin(base, v) if v else "" for v in links]
    assert [r["u"] for r in got] == want


def test_rounding(spark):
    values = [1.005, 2.5, -2.5, 0.0005, 1.0]
    assert column(spark, values, lambda c: round_half_away(c, 2), "double") == [1.0, 2.5, -2.5, 0.0, 1.0]


def test_clean_records(spark):
    df = spark.createDataFrame(
        [(float("nan"), 1, "a"), (float("inf"), None, None), (1.5, 2, "b")], "x double, n int, s string"
    )
    got = sorted(clean_records(df).collect(), key=lambda r: (r["x"], r["n"]))
    assert [tuple(r) for r in got] == [(0.0, 0, None), (0.0, 1, "a"), (1.5, 2, "b")]


def test_stored_date(spark):
    values = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04", "2024-01-02T03:04:05+02:00", "2024-02-30", "soon", None]
    assert column(spark, values, dates.parse_stored_date) == [
        dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4),
        dt.datetime(2024, 1, 2, 1, 4, 5), None, None, None,
    ]


# RFC 3986, section 5.4, base http://a/b/c/d;p?q; strict
RFC_EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
    "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_resolve_as_the_rfc_says(spark):
    rows = [("http://a/b/c/d;p?q", k, v) for k, v in RFC_EXAMPLES.items()]
    rows += [
        ("http://a", "g", "http://a/g"), ("http://a?x", "../g", "http://a/g"), ("http://a/b#f", "?y", "http://a/b?y"),
        ("http://a//b//c", "../d", "http://a//b/d"), ("http://a/b", "x//../y\n", "http://a/x/y\n"),
        ("http://a/b?q", "//h?z", "http://h?z"), ("http://a/b/", "", "http://a/b/"), ("http://é/ü/x", "../ö", "http://é/ö"),
    ]
    df = spark.createDataFrame(rows, "base string, link string, want string")
    got = df.select("link", "want", urls.resolve(F.col("link"), F.col("base")).alias("got"))
    assert [(r.link, r.got) for r in got.collect()] == [(r[1], r[2]) for r in rows]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_normalized_links(spark):
    rows = [(None, "http://a/", ""), ("", "http://a/", ""), ("x", None, "x"), ("x", "", "x"), ("https://b/../c", "http://a/", "https://b/../c")]
    df = spark.createDataFrame(rows, "link string, base string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", urls.normalize_url(F.col("link"), F.col("base"))).collect())
