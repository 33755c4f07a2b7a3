"""Page extraction on hand-written HTML."""

import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import selectors
from shelfscope.functions.html import (
    Matcher, _Flattener, flatten, number_of, raw_text, select_all, stripped_text,
)
from shelfscope.functions.json_scan import balanced, objects_with
from shelfscope.operators import pages, review_json


def page(spark, *htmls):
    return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(htmls)], "url string, html string")


def texts_of(spark, html, selector, rule=stripped_text):
    parsed = pages.parse_pages(page(spark, html), selectors=(selector,))
    found = F.transform(select_all(F.col("elements"), selector), lambda e: rule(F.col("texts"), e))
    return parsed.select(found).first()[0]


HTML = """<html><body><div id="top" class="a b"><p>One <b>two</b><br> three</p><!-- no -->
<script>var x = "<p>hidden</p>";</script><span data-testid='t' class="review-item big">R&amp;D</span></div>
<div class="b"><p>Four<p>five</div><h1>Tail</h1></body>"""


@pytest.mark.parametrize(
    "selector, want",
    [
        ("p", ["Onetwothree", "Fourfive", "five"]),
        (".a p", ["Onetwothree"]),
        ("div.b p", ["Onetwothree", "Fourfive", "five"]),
        ("#top b", ["two"]),
        ("[data-testid='t']", ["R&D"]),
        ("[class*='review']:not([class*='summary'])", ["R&D"]),
        (".review-item:not(.big)", []),
        ("b:first-child", ["two"]),
        ("span:first-child", []),
        ("div div", []),
        ("h1", ["Tail"]),
    ],
)
def test_selectors(spark, selector, want):
    assert texts_of(spark, HTML, selector) == want


def test_raw_text_keeps_spacing_and_skips_scripts(spark):
    text = texts_of(spark, HTML, "#top", raw_text)[0]
    assert "One two three" in text and "hidden" not in text


def test_null_and_odd_pages(spark):
    df = page(spark, None, "", "<p", "</div><p>x", "<p>&am &bogus; &#65;")
    got = pages.parse_pages(df).collect()
    assert got[0]["elements"] is None
    assert got[1]["elements"] == []
    assert got[3]["texts"] == ["x"]
    assert got[4]["texts"] == ["&am &bogus; A"]
    assert pages.extract_products(pages.parse_pages(df)).count() == 5


def test_product_precedence_and_compat(spark):
    html = """<h1>Other</h1><h1 class="product-title"> Big&nbsp;<i>Box</i> </h1>
    <div class="price">$9.99</div><div class="price-current">$1,<b>299</b>.50</div>
    <div class="product-rating"><span class="rating">4.5/5</span></div>
    <div class="item-rating-num">(1,234 reviews)</div><div class="product-brand"><a>Brand: Acme</a></div>"""
    parsed = pages.parse_pages(page(spark, html))
    row = pages.extract_products(parsed).first()
    assert (row["price"], row["rating"], row["review_count"]) == (1299.5, 4.5, 1234)
    assert row["brand"] == "Brand Acme" and row["description"] is None
    assert pages.extract_products(parsed, compat=True).first()["rating"] == 4.55
    full = pages.extract_products_full(parsed).first()
    assert full["brand"] == "Acme"


def test_full_rules_fall_back(spark):
    html = """<title>AMD Ryzen 7 box</title><span class="star filled"></span><span class="star filled"></span>
    <div class="product-details">%s</div><div class="product-bullets">%s</div>""" % ("x" * 60, "y" * 60)
    row = pages.extract_products_full(pages.parse_pages(page(spark, html))).first()
    assert row["title"] == "AMD Ryzen 7 box" and row["brand"] == "AMD"
    assert row["rating"] == 2.0 and row["description"] == "y" * 60
    shop = pages.extract_products_full(pages.parse_pages(page(spark, html)), shop_name="Ryzen").first()
    assert shop["title"] is None


def ld(*documents):
    return "".join(
        f'<script type="application/ld+json">{d if isinstance(d, str) else json.dumps(d)}</script>'
        for d in documents
    )


def test_jsonld_forms(spark):
    review = {"@type": "Review", "author": {"name": "Ann"}, "reviewRating": {"ratingValue": 4},
              "headline": "", "name": "Good", "reviewBody": "Works – well", "datePublished": "2022-10-28T11:59:08Z"}
    htmls = [
        ld({"@type": "Product", "review": [review, "junk", {"author": "x"}]}),
        ld({"@type": "Product", "review": review}),
        ld("{broken", [review, {"@type": "Offer"}]),
        ld({"@type": "WebPage", "review": [dict(review, author="Bob", reviewRating=None)]}),
        ld({"@type": "Product"}),
        "<p>none</p>",
        ld(dict(review, author=["x"], reviewRating={"ratingValue": "n/a"}, reviewBody=None, description="D")),
    ]
    got = review_json.jsonld_reviews(pages.parse_pages(page(spark, *htmls))).orderBy("url", "pos").collect()
    assert [r["url"] for r in got] == ["u0", "u1", "u2", "u3", "u6"]
    assert [r["reviewer_name"] for r in got] == ["Ann", "Ann", "Ann", "Bob", "Anonymous"]
    assert [r["rating"] for r in got] == [4.0, 4.0, 4.0, None, None]
    assert got[0]["title"] == "Good" and got[0]["body"] == "Works  well"
    assert str(got[0]["date"]) == "2022-10-28 11:59:08" and got[4]["body"] == "D"


def test_embedded_blobs(spark):
    comments = '{"Comments": "c1","Rating": 4,"NickName": "n1"},{"Comments":"c2","Rating":5,"NickName":"n2"}'
    ratings = '{"Rating": 3,"NickName": "n3","Comments": "c3"}'
    got = review_json.embedded_reviews(page(spark, comments, ratings, "x")).orderBy("url", "pos").collect()
    assert [(r["url"], r["reviewer_name"], r["rating"], r["body"]) for r in got] == [
        ("u0", "n1", 4, "c1"), ("u0", "n2", 5, "c2"), ("u1", "n3", 3, "c3"),
    ]


def test_embedded_blobs_stay_apart(spark):
    """A field is never taken from a neighbour, whatever the order of the fields."""
    one = ['"Rating": %d', '"NickName": "n%d"', '"Comments": "c%d"']
    html = ""
    for k, order in enumerate(itertools.permutations(range(3)), 1):
        html += "{" + ",".join(one[i] % k for i in order) + "}, {p{margin:0}} {\"Rating\": 9}"
    got = review_json.embedded_reviews(page(spark, html)).orderBy("pos").collect()
    assert [(r["reviewer_name"], r["rating"], r["body"]) for r in got] == [(f"n{k}", k, f"c{k}") for k in range(1, 7)]


def test_embedded_blobs_with_braces_and_nested_objects(spark):
    """Braces in a text and nested objects cost no review, wherever they stand."""
    fields = ['"Comments":"fits {well} in a } slot"', '"Rating":%d', '"NickName":"n%d"']
    extra = ['"Image":{"u":1,"Rating":9}', '"Replies":[{"by":"x {","n":[1,{}]}]', '"Note":"it\'s \\\\ \\" ok"']
    blobs = []
    for k, where in enumerate(range(4), 1):
        own = fields[:where] + extra + fields[where:]
        blobs.append("{" + ",".join(f % k if "%d" in f else f for f in own) + "}")
    html = '<p>15" wide, don\'t { worry</p><script>var a = "x";function f(){if(a){b=\'"\'}}\nvar r = [' + ",\n".join(blobs) + "];</script>"
    trial = '[{"Comments":"fits {well}","Rating":1,"NickName":"a"},{"Comments":"b","Rating":2,"NickName":"b","Image":{"u":1}},{"Comments":"c","Rating":3,"NickName":"c"}]'
    got = review_json.embedded_reviews(page(spark, html, trial)).orderBy("url", "pos").collect()
    assert [(r["rating"], r["reviewer_name"], r["body"]) for r in got] == [
        *[(k, f"n{k}", "fits {well} in a } slot") for k in range(1, 5)],
        (1, "a", "fits {well}"), (2, "b", "b"), (3, "c", "c"),
    ]
    best = review_json.reviews_from_pages(page(spark, html, trial)).groupBy("url", "total").count().orderBy("url")
    assert [tuple(r) for r in best.collect()] == [("u0", 4, 4), ("u1", 3, 3)]


def test_balanced_ranges_against_json(spark):
    import random

    rng = random.Random(3)

    def value(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([1, None, True, "a", "b}", "[{", 'q"\\', "it's", ""])
        if rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {f"k{i}{{": value(depth - 1) for i in range(rng.randrange(4))}

    def count(v):
        inner = v if isinstance(v, list) else v.values() if isinstance(v, dict) else ()
        return isinstance(v, (list, dict)) + sum(map(count, inner))

    for _ in range(300):
        documents = [value(5) for _ in range(3)]
        text = " ] x } ".join(json.dumps(d) if isinstance(d, (list, dict)) else "-" for d in documents)
        found = balanced(text)
        assert len(found) == sum(count(d) for d in documents if isinstance(d, (list, dict)))
        assert [r.start for r in found] == sorted(r.start for r in found)
        for r in found:
            json.loads(text[r.start : r.end])
    assert [(r.start, r.end) for r in balanced("{ [ } ] { a")] == [(0, 5)]
    assert [r.height for r in balanced("[[],[[]]]")] == [3, 1, 2, 1]


@pytest.mark.parametrize(
    "unit",
    ['{"a":', "[", '{"', '\\"', "{'", '"Reviews":[{"Rating":1,', '[{"Rating":', "reviews: ", "{[}", '{"Comments":"NickName"Rating"'],
)
def test_hostile_scripts_end_quickly(unit):
    text = "{" + unit * (100_000 // len(unit))
    names = ('"Comments"', '"Rating"', '"NickName"')
    start = time.perf_counter()
    assert review_json._review_records([text, text + "]}" * 20_000]) == []
    assert objects_with("".join(names) + text, names) == []
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize(
    "unit", ["<b>x", "</p>", "<a ", "<a b='", '<a b="c" ', "<!--", "<", "</", "&amp", "<div class='product-wrap'>", "<h1>", "<pre> "],
)
def test_large_pages_are_read_once(unit):
    """100,000 elements, open, unfinished or unmatched, take seconds at most."""
    start = time.perf_counter()
    _Flattener(Matcher(selectors.ALL)).page(unit * 100_000)
    assert time.perf_counter() - start < 10


def test_matcher_against_a_plain_one():
    """Chains of compounds, by every ancestor of every element."""
    import random

    rng = random.Random(8)
    simple = ["p", "b", ".x", ".y", "#i", "p.x", "[data-a]", "[class*='x']:not(.y)", "b:first-child"]
    chains = list({" ".join(rng.choice(simple) for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    for _ in range(40):
        html = "".join(
            rng.choice(["<p>", "<p class='x'>", "<b>", "<b class='y x'>", "<p id=i>", "<b data-a>", "</p>", "</b>", "t"])
            for _ in range(80)
        )
        elements = _Flattener(Matcher(chains)).page(html)["elements"]
        for chain in chains:
            *outer, own = chain.split()

            def fits(e, one):
                return number_of(one) in plain[e["pos"]]

            plain = {e["pos"]: e["marks"] for e in _Flattener(Matcher(simple)).page(html)["elements"]}

            def inside(e, path):
                return not path or any(
                    a["pos"] < e["pos"] <= a["last"] and fits(a, path[-1]) and inside(a, path[:-1]) for a in elements
                )

            want = [e["pos"] for e in elements if fits(e, own) and inside(e, outer)]
            assert [e["pos"] for e in elements if number_of(chain) in e["marks"]] == want, (chain, html)


def test_markup_forms(spark):
    html = """<!DOCTYPE html><?x y?><P Title='a>b' data-x="1 > 2" hidden CLASS=q>One<br/>two<a href=/u?a=1&amp;b=2>l</a>
    <![CDATA[<b>no</b>]]><!-- <b>no</b> --><script type=x>if (a</b) "</scr"</script ><i title=it's>3 < 4 &lt; 5</i></p><b"""
    row = pages.parse_pages(page(spark, html)).first()
    found = [(e["tag"], dict(e["attrs"])) for e in row["elements"]]
    assert found == [
        ("p", {"title": "a>b", "data-x": "1 > 2", "hidden": "", "class": "q"}), ("br", {}),
        ("a", {"href": "/u?a=1&b=2"}), ("script", {"type": "x"}), ("i", {"title": "it's"}),
    ]
    assert row["elements"][3]["script"] == 'if (a</b) "</scr"'
    assert row["texts"] == ["One", "two", "l", "\n", "3 < 4 < 5", "<b"]


def test_unknown_selectors_are_refused(spark):
    with pytest.raises(ValueError, match="not flattened"):
        select_all(F.col("elements"), ".never-named p")
    with pytest.raises(ValueError, match="unsupported"):
        flatten(F.col("html"), ("p > b",))


def test_embedded_documents(spark):
    record = {"NickName": "n", "Rating": 0, "rating": "5", "Comments": "c", "Pros": "p", "TotalVoting": 2,
              "InDate": "10/28/2022", "HasPurchased": 1}
    nested = "window.__initialState__ = " + json.dumps({"x": {"y": [{"list": [record]}]}}) + ";"
    direct = '"ReviewList": ' + json.dumps([record, {"Title": "0"}, {"Title": 0}])
    htmls = [f"<script>{nested}</script>", f"<script>var x;</script><script>{direct}</script>", "{}", f"<p>{direct}</p>"]
    parsed = pages.parse_pages(page(spark, *htmls))
    got = review_json.embedded_json_reviews(parsed).orderBy("url", "pos").collect()
    assert [(r["url"], r["pos"], r["title"], r["body"]) for r in got] == [
        ("u0", 1, None, "c\n\nPros: p"), ("u1", 1, None, "c\n\nPros: p"), ("u1", 2, "0", None),
    ]
    assert got[0]["rating"] == 5.0 and got[0]["verified_purchase"] and got[0]["helpful_count"] == 2
    assert str(got[0]["date"]) == "2022-10-28 00:00:00"


def test_review_list_search_order():
    hit = [{"Rating": 1}]
    assert review_json.find_review_list({"z": [{"Title": "late"}], "Reviews": hit}) == hit
    assert review_json.find_review_list({"z": [{"Title": "late"}], "data": {"q": hit}}) == hit
    assert review_json.find_review_list({"Reviews": [], "a": {"b": [[hit]]}}) == hit
    assert review_json.find_review_list({"a": [1, {"b": "c"}]}) is None


@pytest.mark.parametrize("depth", [200, 100_000])
def test_deep_documents_end_quickly(depth):
    start = time.perf_counter()
    tree = {"Rating": 1}
    for _ in range(depth):
        tree = {"data": tree}
    assert review_json.find_review_list(tree) is None
    text = '{"data":' * depth + '"x"' + "}" * depth
    assert review_json._review_records([f"window.__initialState__ = {text};"]) == []
    assert time.perf_counter() - start < 10


def test_markup_reviews(spark):
    html = """<div class="review-item product-vs-review"><p>skip</p></div>
    <div class="review-item"><strong>Ann Lee</strong><span class="stars">4 eggs</span><h3>Fine</h3>
    <p class="date-line">December 25, 2023</p><p>Body</p><em class="verified-x">Verified Buyer</em></div>
    <div class="review-item"><span class="stars">3</span></div>"""
    got = pages.extract_reviews(pages.parse_pages(page(spark, html))).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["reviewer_name"], row["rating"], row["title"], row["body"]) == ("Ann Lee", 4.0, "Fine", "Body")
    assert str(row["date"]) == "2023-12-25" and row["verified_purchase"] and len(row["review_id"]) == 16


def test_plain_text_reviews(spark):
    blocks = spark.createDataFrame(
        [
            (1, "By Ann Lee\nVerified Owner\n4 out of 5\nGreat little box\nIt has been running for weeks\n12/25/2023"),
            (2, "too short"),
            (3, "Just one single line of content here"),
            (4, "9 stars rating\nverified"),
            (5, "A line that is long enough\nAnother line of content 2023-01-05"),
            (6, "A line that is long enough\nAnother line of content\nJanuary  5, 2023"),
        ],
        "i int, text string",
    )
    got = {r["i"]: r for r in pages.parse_review_text(blocks).collect()}
    assert set(got) == {1, 3, 5, 6}
    assert got[1]["reviewer_name"] == "Ann" and got[1]["rating"] == 4
    assert got[1]["title"] == "Great little box" and got[1]["body"] == "It has been running for weeks"
    assert str(got[1]["date"]) == "2023-12-25" and got[1]["verified_purchase"]
    assert str(got[5]["date"]) == str(got[6]["date"]) == "2023-01-05"
    assert got[3]["title"] == "" and got[3]["reviewer_name"] == "Anonymous"


def test_best_strategy_and_caps(spark):
    review = {"@type": "Review", "author": "A", "headline": "T", "reviewBody": "B"}
    blob = '{"Comments": "c1","Rating": 4,"NickName": "n1"}'
    block = '<div class="comments">By Ann Lee\nSomething useful number %d\nThe second line of it</div>'
    df = page(
        spark, ld([review] * 5) + blob, "<script>" + blob + "</script>" + block % 1,
        block % 1 + block % 2 + block % 1, "<p>none</p>",
    )
    got = review_json.reviews_from_pages(df, max_reviews=3).orderBy("url", "pos").collect()
    assert [(r["url"], r["method"], r["pos"], r["total"]) for r in got] == [
        ("u0", "json_ld", 1, 5), ("u0", "json_ld", 2, 5), ("u0", "json_ld", 3, 5),
        ("u1", "embedded", 1, 1), ("u2", "blocks", 1, 2), ("u2", "blocks", 2, 2),
    ]
    assert review_json.reviews_from_pages(df).filter("url = 'u0'").count() == 5


def test_many_reviews_and_long_equal_starts_are_all_kept(spark):
    review = {"@type": "Review", "author": "A", "headline": "T", "reviewBody": "B"}
    block = '<div class="comments">By Ann Lee\n' + "The same start of many words. " * 20 + "\nEnding number %d here</div>"
    df = page(spark, ld([dict(review, headline=f"T{i}") for i in range(150)]), "".join(block % i for i in range(120)))
    got = review_json.reviews_from_pages(df).groupBy("url", "total").count().orderBy("url").collect()
    assert [tuple(r) for r in got] == [("u0", 150, 150), ("u1", 120, 120)]
    lines = spark.createDataFrame([("u", i, "x" * 300 + str(i % 2)) for i in range(6)], "url string, pos int, text string")
    assert sorted(r["pos"] for r in pages.dedup_blocks(lines).collect()) == [0, 1]
    assert [r["pos"] for r in pages.dedup_blocks(lines, prefix=200).collect()] == [0]


def test_a_record_for_every_page(spark):
    review = {"@type": "Review", "author": "A", "headline": "T", "reviewBody": "B"}
    df = page(spark, "<h1>Box</h1>" + ld([review] * 2), "<h1>Lone</h1>", "", None)
    got = review_json.pages_to_records(df).orderBy("url").collect()
    assert [(r["url"], r["product"]["title"], r["total"], len(r["reviews"]), r["method"]) for r in got[:2]] == [
        ("u0", "Box", 2, 2, "json_ld"), ("u1", "Lone", 0, 0, None),
    ]
    assert [(r["total"], r["reviews"], r["method"]) for r in got[2:]] == [(0, [], None)] * 2


def test_extraction_does_not_shuffle(spark, sf_dir):
    from shelfscope.views import view

    shop = view(spark, sf_dir, "shop_pages")
    plan = review_json.reviews_from_pages(shop)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_repeated_blocks_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("u", 2, "x"), ("u", 1, "x"), ("u", 3, ""), ("v", 1, "x")], "url string, pos int, text string")
    kept = pages.dedup_blocks(df)
    assert sorted((r["url"], r["pos"]) for r in kept.collect()) == [("u", 1), ("v", 1)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_batch_in_pieces(monkeypatch):
    """A batch has any number of pages; only a few are Python objects at a time."""
    import pyarrow as pa
    from types import SimpleNamespace

    from shelfscope.functions import html

    pages = pa.array([f"<p class='a{i}'>text {i}<b>x</b></p>" if i % 4 else None for i in range(11)])
    matcher = html._matcher(html.known.ALL)
    whole = html._doms(pages, matcher)
    sizes = []

    def array(rows, **kind):
        sizes.append(len(rows))
        return pa.array(rows, **kind)

    monkeypatch.setattr(html, "_PAGES", 3)
    monkeypatch.setattr(html, "pa", SimpleNamespace(array=array, concat_arrays=pa.concat_arrays))
    assert html._doms(pages, matcher).equals(whole)
    assert sizes == [3, 3, 3, 2]
    assert len(html._doms(pages.slice(0, 0), matcher)) == 0


def test_records_of_all_forms_in_short_methods(spark):
    """The rows are those of ``record_array``, and no generated method is too long (8,000
    bytes) for the JVM to compile."""
    values = ["0", 0, 0.0, -0.0, "0.0", "", None, False, True, "false", [], {}, [1], {"a": 1}, "[]", "{}", 5, "5", "a  b", " é x*"]
    records = [{name: v, "Pros": v, "body": "text"} for v in values for name in ("NickName", "Rating", "Title", "TotalVoting", "HasPurchased", "InDate")]
    records += [{"Title": a, "title": b, "headline": "h"} for a in values for b in values]
    texts = [json.dumps(r) for r in records] + ["", "[]", "no json", None, '{"Title": "a", "Title": "b"}']
    df = spark.createDataFrame(list(enumerate(texts)), "k long, record string")
    got = review_json.standardize_reviews(df)
    want = df.select("k", F.inline(review_json.record_array(F.array("record"))))
    assert got.count() == want.count() > 400
    same = [str(r) for r in got.orderBy("k").collect()], [str(r) for r in want.orderBy("k").collect()]
    assert same[0] == same[1]
    rows = spark.range(1).select("id", F.col("id").cast("string").alias("record"))
    plan = review_json.standardize_reviews(rows)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    )
    sizes = [int(x.split(";")[0]) for x in plan.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) <= 8000
