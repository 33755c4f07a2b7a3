"""Reviews from JSON inside crawled pages, as VARIANT expressions."""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from shelfscope.functions import dates, text
from shelfscope.functions.bind import let
from shelfscope.functions.html import select_all
from shelfscope.functions.json_scan import Range, balanced, objects_with
from shelfscope.operators import pages as page_ops


def _part(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$['{name}']", kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column) -> Column:
    """The elements of an array, or the value itself as the only element."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _filled(v: Column) -> Column:
    """A value's text unless it is missing, empty, zero or false."""

    def worth(text_and_kind: Column) -> Column:
        value, kind = text_and_kind["value"], text_and_kind["kind"]
        nothing = (
            F.when(kind == "STRING", value == "")
            .when(kind == "BOOLEAN", value == "false")
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), value.isin("[]", "{}"))
            .otherwise(value.try_cast("double") == 0)
        )
        return F.when(~F.coalesce(nothing, F.lit(False)), value)

    pair = F.struct(
        F.try_variant_get(v, "$", "string").alias("value"), _kind(v).alias("kind")
    )
    return let(pair, worth)


def _first_filled(v: Column, names) -> Column:
    return F.coalesce(*[_filled(_part(v, n)) for n in names])


def _cleaned(value: Column) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), text.clean_text(v)))


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _no_variants() -> Column:
    return F.array().cast("array<variant>")


def _reviews_of(entity: Column) -> Column:
    """The review values of one JSON-LD entity."""
    nested = _part(entity, "review")
    kind = F.coalesce(_part(entity, "@type", "string"), F.lit(""))
    return (
        F.when(kind == "Review", F.array(entity))
        .when(nested.isNotNull(), _items(nested))
        .otherwise(_no_variants())
    )


def _jsonld_review(r: Column) -> Column:
    author = _part(r, "author")
    author_kind = _kind(author)
    name = (
        F.when(
            author_kind.startswith("OBJECT"),
            F.coalesce(_part(author, "name", "string"), F.lit("Anonymous")),
        )
        .when(author_kind == "STRING", F.try_variant_get(author, "$", "string"))
        .otherwise(F.lit("Anonymous"))
    )
    rating = F.try_variant_get(r, "$.reviewRating.ratingValue", "string")
    return F.struct(
        text.clean_text(name).alias("reviewer_name"),
        rating.try_cast("double").alias("rating"),
        _cleaned(_first_filled(r, ("headline", "name"))).alias("title"),
        _cleaned(_first_filled(r, ("reviewBody", "description", "text"))).alias("body"),
        let(_filled(_part(r, "datePublished")), dates.parse_review_date).alias("date"),
        F.lit(False).alias("verified_purchase"),
    )


def _with_content(reviews: Column) -> Column:
    return F.filter(
        reviews,
        lambda r: F.coalesce(F.length(r["body"]) > 0, F.lit(False))
        | F.coalesce(F.length(r["title"]) > 0, F.lit(False)),
    )


def jsonld_array(elements: Column) -> Column:
    """The reviews of a page's JSON-LD scripts as an array of structs.

    A script holds one object or a list. A Product or any object with ``review`` yields
    that list (or single object), a Review yields itself; broken scripts yield nothing.
    """
    scripts = select_all(elements, "script[type='application/ld+json']")
    documents = F.filter(
        F.transform(scripts, lambda e: F.try_parse_json(e["script"])), lambda d: d.isNotNull()
    )
    entities = F.filter(F.flatten(F.transform(documents, _items)), _is_object)
    found = F.filter(F.flatten(F.transform(entities, _reviews_of)), _is_object)
    return _with_content(F.transform(found, _jsonld_review))


def _exploded(df: DataFrame, keep: list[str], reviews: Column) -> DataFrame:
    return df.select(*keep, F.posexplode(reviews).alias("_p", "_r")).select(
        *keep, (F.col("_p") + 1).alias("pos"), "_r.*"
    )


def jsonld_reviews(parsed: DataFrame) -> DataFrame:
    """One row per review in the pages' JSON-LD scripts."""
    return _exploded(parsed, page_ops.other_columns(parsed), jsonld_array(F.col("elements")))


# fixed values: fields of a review written into a script
EMBEDDED_FIELDS = {
    "body": r'"Comments":\s*"([^"]+)"', "rating": r'"Rating":\s*(\d+)', "name": r'"NickName":\s*"([^"]+)"',
}
_EMBEDDED_NAMES = ('"Comments"', '"Rating"', '"NickName"')


@F.arrow_udf(ArrayType(StringType()))
def _embedded_objects(pages: pa.Array) -> pa.Array:
    rows = [objects_with(p, _EMBEDDED_NAMES) for p in pages.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.string()))


def embedded_objects(html: Column) -> Column:
    """The objects of a page's source that hold all of ``EMBEDDED_FIELDS``, in whatever order,
    with whatever else, as texts without what nested objects and arrays hold. Braces in
    quoted texts are text. Only pages that name all fields are scanned."""
    named = [html.contains(n) for n in _EMBEDDED_NAMES]
    return _embedded_objects(F.when(named[0] & named[1] & named[2], html))


def embedded_array(objects: Column) -> Column:
    """The reviews in ``embedded_objects``."""
    body, rating, name = EMBEDDED_FIELDS.values()
    objects = F.filter(objects, lambda m: m.rlike(rating) & m.rlike(name) & m.rlike(body))
    return F.transform(
        objects,
        lambda m: F.struct(
            F.regexp_extract(m, name, 1).alias("reviewer_name"),
            F.regexp_extract(m, rating, 1).try_cast("int").alias("rating"),
            F.lit("").alias("title"),
            F.regexp_extract(m, body, 1).alias("body"),
            F.lit(False).alias("verified_purchase"),
        ),
    )


def embedded_reviews(pages: DataFrame) -> DataFrame:
    """One row per review blob in the page source."""
    keep = page_ops.other_columns(pages)
    found = pages.select(*keep, embedded_objects(F.col("html")).alias("objects"))
    return _exploded(found, keep, embedded_array(F.col("objects")))


# fixed values: names a field of a raw review record may have, in order of preference
RECORD_ALIASES = {
    "reviewer_name": ("NickName", "DisplayName", "reviewer_name", "author"),
    "rating": ("Rating", "rating"),
    "title": ("Title", "title", "headline"),
    "body": ("Comments", "body", "text", "content", "review_text"),
    "date": ("InDate", "date", "review_date", "created_at"),
    "verified_purchase": ("HasPurchased", "verified_purchase"),
    "helpful_count": ("TotalVoting", "TotalConsented", "helpful_count", "upvotes"),
}


def _number(value: Column) -> Column:
    """A number or NULL; text that is none is not even tried, failed casts are slow."""
    return let(value, lambda x: F.when(x.rlike(r"^\s*[-+]?[0-9.]"), x.try_cast("double")))


# values whose text alone does not tell an absent value from a text like "0"
_DOUBTFUL = r"^(-?[0.]+(E[+-]?\d+)?|false|\[\]|\{\})$"


# what ``clean_text`` changes is in texts that hold one of these; most texts are clean already
_UNCLEAN = r"[^A-Za-z0-9 \-_.,!?()$%&@#]|^ | $|  "


def _record_review(v: Column) -> Column:
    """A raw review record (a JSON object) as a typed struct.

    Empty, zero and false values count as missing when aliases are tried. Pros and cons
    are appended to the body.
    """
    # all fields as text in one pass; the JSON type is asked for only in doubt
    return let(
        F.try_variant_get(v, "$", "map<string,string>"), lambda fields: _typed_record(v, fields)
    )


def _typed_record(v: Column, fields: Column) -> Column:
    def filled(name: str) -> Column:
        return let(
            fields[name],
            lambda x: F.when(x == "", None)
            .when(x.rlike(_DOUBTFUL), F.when(_kind(_part(v, name)) == "STRING", x))
            .otherwise(x),
        )

    value = {
        field: F.coalesce(*[filled(n) for n in names]) for field, names in RECORD_ALIASES.items()
    }
    extra = F.concat_ws(
        " | ",
        F.concat(F.lit("Pros: "), filled("Pros")),
        F.concat(F.lit("Cons: "), filled("Cons")),
    )

    def body(parts: Column) -> Column:
        main, more = parts["main"], parts["more"]
        return (
            F.when(more == "", main)
            .when(F.length(main) > 0, F.concat(main, F.lit("\n\n"), more))
            .otherwise(more)
        )

    parts = F.struct(_cleaned(value["body"]).alias("main"), extra.alias("more"))
    return F.struct(
        text.clean_text(F.coalesce(value["reviewer_name"], F.lit("Anonymous"))).alias("reviewer_name"),
        _number(value["rating"]).alias("rating"),
        _cleaned(value["title"]).alias("title"),
        let(parts, body).alias("body"),
        let(value["date"], dates.parse_review_date).alias("date"),
        value["verified_purchase"].isNotNull().alias("verified_purchase"),
        _number(value["helpful_count"]).try_cast("int").alias("helpful_count"),
    )


def record_array(records: Column) -> Column:
    """Typed reviews from an array of JSON texts; those without content are left out."""
    objects = F.filter(F.transform(records, F.try_parse_json), _is_object)
    return _with_content(F.transform(objects, _record_review))


def standardize_reviews(records: DataFrame, record: str = "record") -> DataFrame:
    """Typed review rows from raw JSON records (text); other columns are kept.

    The rules of ``record_array`` for rows: each step is a select, so that it is evaluated
    once and inside generated code. Rows are dropped by generators over no or one element:
    a filter would be pushed through all steps and repeat their expressions.
    """
    keep = [c for c in records.columns if c != record]
    parsed = records.select(*keep, F.try_parse_json(record).alias("_v"))
    objects = parsed.select(*keep, F.explode(F.when(_is_object(F.col("_v")), F.array("_v"))).alias("_v"))
    read = objects.select(
        *keep, F.try_variant_get("_v", "$", "map<string,string>").alias("_f"),
        F.try_variant_get("_v", "$", "map<string,variant>").alias("_d"),
    )
    # one function over the fields, not a branch for each alias: the generated method of these
    # would be too long to be compiled to machine code
    filled = F.map_filter(
        "_f", lambda k, x: (x != "") & (~x.rlike(_DOUBTFUL) | (_kind(F.col("_d")[k]) == "STRING"))
    )
    fields = read.select(*keep, filled.alias("_f"))

    def first(names) -> Column:
        found = F.transform(F.array(*map(F.lit, names)), lambda n: F.col("_f")[n])
        return F.get(F.filter(found, lambda x: x.isNotNull()), 0)

    values = fields.select(
        *keep,
        *[first(names).alias(f"_{field}") for field, names in RECORD_ALIASES.items()],
        F.concat_ws(
            " | ", F.concat(F.lit("Pros: "), first(["Pros"])), F.concat(F.lit("Cons: "), first(["Cons"]))
        ).alias("_more"),
    )

    def cleaned(name: str) -> Column:
        x = F.col(name)
        return F.when(x.rlike(_UNCLEAN), text.clean_text(x)).otherwise(x)

    def number(name: str) -> Column:
        return F.when(F.col(name).rlike(r"^\s*[-+]?[0-9.]"), F.col(name).try_cast("double"))

    clean = values.select(
        *keep, "_reviewer_name", "_rating", "_date", "_verified_purchase", "_helpful_count", "_more",
        cleaned("_title").alias("title"), cleaned("_body").alias("_main"),
    )
    body = (
        F.when(F.col("_more") == "", F.col("_main"))
        .when(F.length("_main") > 0, F.concat("_main", F.lit("\n\n"), "_more"))
        .otherwise(F.col("_more"))
    )
    typed = clean.select(
        *keep,
        F.coalesce(cleaned("_reviewer_name"), F.lit("Anonymous")).alias("reviewer_name"),
        number("_rating").alias("rating"),
        "title",
        body.alias("body"),
        dates.parse_review_date(F.col("_date")).alias("date"),
        F.col("_verified_purchase").isNotNull().alias("verified_purchase"),
        number("_helpful_count").try_cast("int").alias("helpful_count"),
    )
    filled_in = (F.length("body") > 0) | (F.length("title") > 0)
    fields_ = [c for c in typed.columns if c not in keep]
    return typed.select(*keep, F.inline(F.when(filled_in, F.array(F.struct(*fields_)))))


# fixed values: what stands before review lists in scripts, in order of preference, and the
# fields that tell an array of reviews by its first record
LIST_PLACES = (
    (r"window\.__initialState__\s*=\s*", "{"),
    (r'"ReviewList":\s*', "["),
    (r'"CustomerReviews":\s*', "["),
    (r'"Reviews":\s*', "["),
    (r"reviewData\s*=\s*", "{"),
    (r"reviews:\s*", "["),
)
FIRST_RECORDS = (('"Rating"', '"NickName"', '"Comments"'), ('"Rating"', '"Comments"'), ('"Title"', '"Rating"'))
LIST_KEYS = (
    "ReviewList", "CustomerReviews", "Reviews", "reviewList", "reviews", "Review",
    "ProductReviews", "ItemReviews",
)
SECTION_KEYS = (
    "ReviewInfo", "ProductDetail", "ItemDetail", "ReviewData", "ProductReviews", "data",
    "content",
)
RECORD_KEYS = ("Rating", "Comments", "NickName", "Title", "reviewer")


def _is_review_list(value) -> bool:
    return (
        isinstance(value, list)
        and bool(value)
        and isinstance(value[0], dict)
        and any(k in value[0] for k in RECORD_KEYS)
    )


def find_review_list(document) -> list | None:
    """The first review list in a JSON tree: known keys, then known sections, then all.

    Each node is visited once, so the search is linear in the tree.
    """
    waiting = [document]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            if _is_review_list(node):
                return node
            waiting.extend(reversed(node))
        elif isinstance(node, dict):
            named = next((node[k] for k in LIST_KEYS if _is_review_list(node.get(k))), None)
            if named is not None:
                return named
            first = [k for k in SECTION_KEYS if isinstance(node.get(k), dict)]
            rest = [v for k, v in node.items() if k not in first]
            waiting.extend(reversed([node[k] for k in first] + rest))
    return None


#: deeper documents are beyond the JSON reader
MAX_DEPTH = 500


class _Script:
    """The balanced ranges of a script, and which of them have been read in vain."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ranges = balanced(text)
        self.at = {r.start: r for r in self.ranges}
        self.done: list[tuple[int, int]] = []  # documents that hold no list

    def named(self, place: str, bracket: str) -> list[Range]:
        ends = (m.end() for m in re.finditer(place, self.text))
        return [self.at[e] for e in ends if e in self.at and self.text[e] == bracket]

    def arrays_of(self, names: tuple[str, ...]) -> list[Range]:
        """Arrays whose first value is an object that holds ``names``."""
        out = []
        for r in self.ranges:
            first = r.inner[0] if r.inner else None
            if self.text[r.start] != "[" or first is None or self.text[first.start] != "{":
                continue
            if not self.text[r.start + 1 : first.start].strip() and all(n in first.own(self.text) for n in names):
                out.append(r)
        return out

    def read(self, r: Range) -> list | None:
        """The review list in a range that is a JSON document."""
        k = bisect_right(self.done, (r.start, len(self.text)))
        if r.height > MAX_DEPTH or k and self.done[k - 1][1] >= r.end:
            return None
        try:
            found = find_review_list(json.loads(self.text[r.start : r.end]))
        except (ValueError, RecursionError):
            return None
        if not found:
            insort(self.done, (r.start, r.end))
        return found


def _review_records(scripts: list[str]) -> list[str]:
    """The records of the first review list in a page's scripts.

    Named places come first, then arrays whose first record has the fields of a review.
    Documents that are no JSON, or nested deeper than ``MAX_DEPTH``, are passed over.
    """
    read = [_Script(s) for s in scripts]
    ways = [lambda s, p=p: s.named(*p) for p in LIST_PLACES]
    ways += [lambda s, n=n: s.arrays_of(n) for n in FIRST_RECORDS]
    for way in ways:
        for script in read:
            for r in way(script):
                if found := script.read(r):
                    return [json.dumps(x, ensure_ascii=False) for x in found if isinstance(x, dict)]
    return []


@F.arrow_udf(ArrayType(StringType()))
def _records(pages: pa.Array) -> pa.Array:
    rows = [None if s is None else _review_records([x for x in s if x]) for s in pages.to_pylist()]
    return pa.array(rows, type=pa.list_(pa.string()))


def embedded_json_reviews(parsed: DataFrame) -> DataFrame:
    """Reviews from JSON documents in the pages' scripts, standardised.

    Only the search for a review list inside a JSON tree of unknown shape runs in
    Python; the records come back as JSON text and are typed by expressions.
    """
    keep = page_ops.other_columns(parsed)
    scripts = F.transform(select_all(F.col("elements"), "script"), lambda e: e["script"])
    found = parsed.select(*keep, scripts.alias("scripts")).select(*keep, _records("scripts").alias("records"))
    return _exploded(found, keep, record_array(F.col("records")))


def _uniform(reviews: Column, date) -> Column:
    """Reviews of any strategy in one struct type."""
    return F.transform(
        reviews,
        lambda r: F.struct(
            r["reviewer_name"].alias("reviewer_name"),
            r["rating"].cast("double").alias("rating"),
            r["title"].alias("title"),
            r["body"].alias("body"),
            date(r).alias("date"),
            r["verified_purchase"].alias("verified_purchase"),
        ),
    )


def _with_objects(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pages with ``elements``, ``texts`` and ``objects``, and their other columns."""
    parsed = page_ops.parse_pages(pages, keep_html=True)
    keep = page_ops.other_columns(parsed)
    return parsed.select(*keep, "elements", "texts", embedded_objects(F.col("html")).alias("objects")), keep


def _chosen(objects: Column, elements: Column, texts: Column, max_blocks: int | None) -> Column:
    """``struct<method, reviews>`` by the first strategy that finds any, NULL if none does.

    The strategies are chained, so a later one runs only where the earlier ones failed.
    """

    def or_else(name: str, reviews: Column, other: Column | None) -> Column:
        def pick(found: Column) -> Column:
            hit = F.when(
                F.size(found) > 0, F.struct(F.lit(name).alias("method"), found.alias("reviews"))
            )
            return hit if other is None else hit.otherwise(other)

        return let(reviews, pick)

    blocks = page_ops.review_array(
        page_ops.distinct_blocks(page_ops.block_array(elements, texts)), max_blocks
    )
    in_blocks = _uniform(blocks, lambda r: r["date"].cast("string"))
    embedded = _uniform(embedded_array(objects), lambda r: F.lit(None).cast("string"))
    json_ld = _uniform(jsonld_array(elements), lambda r: r["date"].cast("string"))
    return or_else(
        "json_ld", json_ld, or_else("embedded", embedded, or_else("blocks", in_blocks, None))
    )


def reviews_from_pages(
    pages: DataFrame, max_blocks: int | None = None, max_reviews: int | None = None
) -> DataFrame:
    """The reviews of each page by the best strategy that finds any.

    JSON-LD is preferred to embedded blobs, those to text blocks. ``method`` names the
    strategy and ``total`` the number of reviews found on the page; ``max_blocks`` and
    ``max_reviews`` limit what is read and returned, by default nothing is left out.
    Everything works on the arrays of one page row, so the job has no shuffle and a URL
    crawled many times is no hot key.
    """
    parsed, keep = _with_objects(pages)
    best = _chosen(F.col("objects"), F.col("elements"), F.col("texts"), max_blocks)
    found = parsed.select(*keep, best.alias("_best")).filter("_best is not null")
    reviews = F.col("_best.reviews")
    rows = reviews if max_reviews is None else F.slice(reviews, 1, max_reviews)
    return found.select(
        *keep, F.col("_best.method").alias("method"), F.size(reviews).alias("total"),
        F.posexplode(rows).alias("_p", "_r"),
    ).select(*keep, "method", "total", (F.col("_p") + 1).alias("pos"), "_r.*")


def pages_to_records(
    pages: DataFrame, shop_name: str | None = None, max_blocks: int | None = None
) -> DataFrame:
    """One record for every page: product, reviews, their number and how they were found.

    A page without reviews has an empty array, 0 and no method; one without a product has
    NULL fields. No shuffle.
    """
    parsed, keep = _with_objects(pages)
    elements, texts = F.col("elements"), F.col("texts")
    best = _chosen(F.col("objects"), elements, texts, max_blocks)
    found = parsed.select(
        *keep, page_ops.full_product(elements, texts, shop_name).alias("product"), best.alias("_best")
    )
    none = F.array().cast(found.schema["_best"].dataType["reviews"].dataType)
    reviews = F.coalesce("_best.reviews", none)
    return found.select(
        *keep, "product", reviews.alias("reviews"), F.size(reviews).alias("total"),
        F.col("_best.method").alias("method"),
    )
