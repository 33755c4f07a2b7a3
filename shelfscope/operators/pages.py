"""Product and review rows from crawled pages.

Input is ``(url, html)``. Extraction is narrow: one row per page goes in, arrays are
worked on inside the row and exploded at the end. Only ``dedup_blocks`` and
``cap_reviews``, for blocks that are already rows, shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.functions import dates, selectors, text
from shelfscope.functions.bind import let
from shelfscope.functions.html import (
    clean_field, field_text, flatten, raw_text, select_all, select_any,
    select_first, stripped_text,
)


# fixed values: lengths (in characters) that the page rules compare with. They tell a
# description, a review block, a name, a content line, a title and a review from other
# text; none of them cuts a text
DESCRIPTION_OVER = 50
BLOCK_OVER = 100
NAME_BELOW = 50
LINE_OVER = 10
TITLE_BELOW = 100
MIN_REVIEW = 20


def other_columns(df: DataFrame) -> list[str]:
    """The columns of a page frame besides the page itself."""
    return [c for c in df.columns if c not in ("html", "elements", "texts")]


def parse_pages(pages: DataFrame, keep_html: bool = False, selectors: tuple[str, ...] = ()) -> DataFrame:
    """Replace ``html`` by ``elements`` and ``texts`` (see ``functions.html``).

    ``selectors`` may be selected besides those of the library's own rules."""
    keep = other_columns(pages) + (["html"] if keep_html else [])
    return pages.select(*keep, flatten(F.col("html"), selectors).alias("dom")).select(
        *keep, F.col("dom.elements").alias("elements"), F.col("dom.texts").alias("texts")
    )


def page_titles(parsed: DataFrame) -> DataFrame:
    """Cleaned title, language attribute and first link of each page."""
    elements, texts = F.col("elements"), F.col("texts")
    return parsed.select(
        *other_columns(parsed),
        clean_field(field_text(elements, texts, selectors.PRODUCT["title"])).alias("title"),
        select_first(elements, ("html",))["attrs"]["lang"].alias("lang"),
        select_first(elements, ("a[href]",))["attrs"]["href"].alias("first_link"),
    )


def _flat(df: DataFrame, keep: list[str], record: Column) -> DataFrame:
    return df.select(*keep, record.alias("_r")).select(*keep, "_r.*")


def extract_products(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """One product row per page by the static rules.

    Numbers are read from the raw text. ``compat`` cleans the text first, which deletes
    ``/`` and so turns ``4.5/5`` into ``4.55``.
    """
    elements, texts = F.col("elements"), F.col("texts")
    found = F.struct(
        *[field_text(elements, texts, s).alias(n) for n, s in selectors.PRODUCT.items()]
    )

    def product(raw: Column) -> Column:
        def number(name: str, rule) -> Column:
            return rule(clean_field(raw[name]) if compat else raw[name]).alias(name)

        return F.struct(
            clean_field(raw["title"]).alias("title"),
            clean_field(raw["brand"]).alias("brand"),
            number("price", text.parse_price),
            number("rating", text.parse_rating),
            number("review_count", text.parse_review_count),
            clean_field(raw["description"]).alias("description"),
        )

    return _flat(parsed, other_columns(parsed), let(found, product))


def full_product(elements: Column, texts: Column, shop_name: str | None = None) -> Column:
    """The product of a page as a struct, by the fuller rules.

    Title falls back to the page title unless that names the shop; the brand's label is
    removed or the brand taken from the title; the rating may come from an attribute or
    from counting filled stars; the description is the longest candidate over 50
    characters.
    """
    filled = [F.size(select_all(elements, s)) for s in selectors.FILLED_RATING]
    candidates = F.flatten(
        F.array(*[select_all(elements, s) for s in selectors.PRODUCT["description"]])
    )
    long_texts = F.filter(
        F.transform(candidates, lambda e: stripped_text(texts, e)), lambda t: F.length(t) > DESCRIPTION_OVER
    )
    rating_mark = let(
        select_first(elements, selectors.PRODUCT["rating"]),
        lambda e: F.struct(e["attrs"].alias("attrs"), stripped_text(texts, e).alias("text")),
    )
    found = F.struct(
        *[
            field_text(elements, texts, selectors.PRODUCT[n]).alias(n)
            for n in ("title", "brand", "price", "review_count")
        ],
        field_text(elements, texts, ("title",)).alias("page_title"),
        rating_mark.alias("mark"),
        F.coalesce(*[F.when(n > 0, n) for n in filled]).cast("double").alias("filled"),
        long_texts.alias("descriptions"),
    )

    def longest(all_texts: Column) -> Column:
        """The longest text, the earliest of equal ones."""
        top = F.array_max(F.transform(all_texts, F.length))
        return F.get(F.filter(all_texts, lambda t: F.length(t) == top), 0)

    def product(raw: Column) -> Column:
        page_title = raw["page_title"]
        if shop_name:
            page_title = F.when(~page_title.contains(shop_name), page_title)
        title = F.coalesce(
            F.nullif(clean_field(raw["title"]), F.lit("")), clean_field(page_title)
        )
        stated = [raw["mark"]["attrs"][a].try_cast("double") for a in selectors.RATING_ATTRIBUTES]
        read = let(text.parse_rating(raw["mark"]["text"]), lambda n: F.when(n != 0, n))
        return F.struct(
            title.alias("title"),
            let(title, lambda t: text.brand_of(raw["brand"], t)).alias("brand"),
            text.parse_price(raw["price"]).alias("price"),
            F.coalesce(*stated, read, raw["filled"]).alias("rating"),
            text.parse_review_count(raw["review_count"]).alias("review_count"),
            clean_field(longest(raw["descriptions"])).alias("description"),
        )

    return let(found, product)


def extract_products_full(parsed: DataFrame, shop_name: str | None = None) -> DataFrame:
    """One product row per page by the fuller rules (``full_product``)."""
    record = full_product(F.col("elements"), F.col("texts"), shop_name)
    return _flat(parsed, other_columns(parsed), record)


def markup_array(elements: Column, texts: Column, compat: bool = False) -> Column:
    """The review items of a page's markup as an array of structs.

    Each item is cut out as its own slice of elements and texts before its fields are
    looked up.
    """

    def review(scope: Column) -> Column:
        found = F.struct(
            *[
                field_text(scope["elements"], scope["texts"], s, scope["base"]).alias(n)
                for n, s in selectors.REVIEW.items()
            ]
        )

        def typed(raw: Column) -> Column:
            def source(name: str) -> Column:
                return clean_field(raw[name]) if compat else raw[name]

            return F.struct(
                clean_field(raw["reviewer_name"]).alias("reviewer_name"),
                let(source("rating"), text.parse_rating).alias("rating"),
                clean_field(raw["title"]).alias("title"),
                clean_field(raw["body"]).alias("body"),
                let(source("date"), dates.parse_date).alias("date"),
                text.is_verified_purchase(raw["verified"]).alias("verified_purchase"),
            )

        return let(found, typed)

    scopes = F.transform(
        select_any(elements, selectors.REVIEW_ITEM),
        lambda it: F.struct(
            F.slice(elements, it["pos"] + 1, it["last"] - it["pos"]).alias("elements"),
            F.slice(texts, it["text_at"] + 1, it["text_n"]).alias("texts"),
            it["text_at"].alias("base"),
        ),
    )

    def known(r: Column) -> Column:
        return F.coalesce(F.length(r["reviewer_name"]) > 0, F.lit(False)) | F.coalesce(
            F.length(r["body"]) > 0, F.lit(False)
        )

    return F.filter(F.transform(scopes, review), known)


def extract_reviews(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """One row per review item in a page's markup, with its position and key."""
    keep = other_columns(parsed)
    rows = parsed.select(
        *keep,
        F.posexplode(markup_array(F.col("elements"), F.col("texts"), compat)).alias("_p", "_r"),
    ).select(*keep, (F.col("_p") + 1).alias("pos"), "_r.*")
    key = text.review_key(F.col("reviewer_name"), F.col("body"), F.col("date").cast("string"))
    return rows.withColumn("review_id", key)


def block_array(elements: Column, texts: Column) -> Column:
    """Texts that may be reviews: first the ``comments`` blocks, then every ``div`` over
    100 characters that has a review phrase and is no summary."""

    def texts_of(found: Column) -> Column:
        return F.transform(found, lambda e: raw_text(texts, e))

    def likely(t: Column) -> Column:
        return let(
            F.lower(t),
            lambda lower: text.mentions(lower, text.BLOCK_PHRASES)
            & (F.length(lower) > BLOCK_OVER)
            & ~lower.contains("summary"),
        )

    return F.concat(
        texts_of(select_all(elements, "div.comments")),
        F.filter(texts_of(select_all(elements, "div")), likely),
    )


def distinct_blocks(blocks: Column, prefix: int | None = None) -> Column:
    """Each block once, in order of first occurrence.

    With ``prefix``, blocks that share their first ``prefix`` characters count as equal.
    """
    filled = F.filter(blocks, lambda t: F.length(t) > 0)
    if prefix is None:
        return F.array_distinct(filled)

    def keep_first(found: Column) -> Column:
        heads = F.transform(found, lambda t: F.substring(t, 1, prefix))
        return let(
            heads,
            lambda hs: F.filter(
                found, lambda t, i: F.array_position(hs, F.substring(t, 1, prefix)) == i + 1
            ),
        )

    return let(filled, keep_first)


def review_blocks(parsed: DataFrame) -> DataFrame:
    """``pos, text`` of the blocks of each page that may be reviews."""
    blocks = block_array(F.col("elements"), F.col("texts"))
    return parsed.select(*other_columns(parsed), F.posexplode(blocks).alias("pos", "text"))


def dedup_blocks(blocks: DataFrame, key: str = "url", prefix: int | None = None) -> DataFrame:
    """The first of the equal blocks of a page; whole texts are compared.

    With ``prefix``, blocks that share their first ``prefix`` characters count as equal.
    Spark turns the rank-1 filter into a group limit before the shuffle, so repeated
    blocks do not travel.
    """
    head = F.col("text") if prefix is None else F.substring("text", 1, prefix)
    # the hash first: texts are compared only where it is equal
    same = Window.partitionBy(key, F.xxhash64(head), head).orderBy("pos")
    return (
        blocks.filter(F.length("text") > 0)
        .withColumn("_nr", F.row_number().over(same))
        .filter(F.col("_nr") == 1)
        .drop("_nr")
    )


def cap_reviews(reviews: DataFrame, limit: int, key: str = "url") -> DataFrame:
    """The first ``limit`` reviews of each page; a group limit runs before the shuffle."""
    first = Window.partitionBy(key).orderBy("pos")
    return (
        reviews.withColumn("_nr", F.row_number().over(first))
        .filter(F.col("_nr") <= limit)
        .drop("_nr")
    )


# fixed values: patterns for the parts of a review written as plain text
NAME_PATTERNS = (
    r"By\s+([A-Za-z\s\.]+?)(?:\s|$)",
    r"([A-Za-z\s\.]+?)\s+(?:Verified|verified|Owner|owner)",
    r"^([A-Za-z\s\.]+?)(?:\s{2,}|\n)",
)
STAR_PATTERNS = (
    r"(\d+)(?:\s*out\s*of\s*5|\s*\/\s*5|\s*stars?)", r"Rating:\s*(\d+)", r"(\d+)\s*star",
)
BLOCK_DATE_PATTERNS = (
    (r"(?<![\d/-])(\d{4}-\d{2}-\d{2})(?![\d/-])", "yyyy-MM-dd"),
    (r"(?<![\d/-])(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?![\d/-])", "M/d/yyyy"),
    (r"(?<![\d/-])(\d{1,2}[/-]\d{1,2}[/-]\d{2})(?![\d/-])", "M/d/yy"),
    (r"(\w+\s+\d{1,2},?\s+\d{4})", "MMMM d yyyy"),
)
META_WORDS = ("verified", "by ", "rating", "stars", "out of")
OWNER_WORDS = ("verified", "owner", "purchased")


def review_of_text(t: Column) -> Column:
    """Name, rating, title, body, date and purchase flag of plain review text.

    The date is a DATE, ISO form tried first. NULL for text under ``MIN_REVIEW``
    characters or without content lines.
    """

    def group(pattern: str, flags: str = "(?U)") -> Column:
        return F.regexp_extract(t, flags + pattern, 1)

    def fits(name: Column) -> Column:
        return F.when((F.length(name) > 1) & (F.length(name) < NAME_BELOW), name)

    name = F.coalesce(
        *[let(text.trim_space(group(p)), fits) for p in NAME_PATTERNS], F.lit("Anonymous")
    )
    rating = F.coalesce(
        *[
            let(group(p, "(?Ui)").try_cast("int"), lambda n: F.when(n.between(1, 5), n))
            for p in STAR_PATTERNS
        ]
    )

    def day(pattern: str, layout: str) -> Column:
        piece = group(pattern)
        if "/" in layout:
            piece = F.translate(piece, "-", "/")
        elif "MMMM" in layout:
            piece = F.initcap(F.regexp_replace(piece, r"[\s,]+", " "))
        return let(piece, lambda x: F.when(x != "", F.try_to_date(x, layout)))

    date = F.coalesce(*[day(*form) for form in BLOCK_DATE_PATTERNS])
    lines = F.filter(
        F.transform(F.split(t, "\n"), text.trim_space),
        lambda line: (F.length(line) > LINE_OVER) & ~text.mentions(F.lower(line), META_WORDS),
    )

    def assemble(content: Column) -> Column:
        heading = F.get(content, 0)
        titled = (F.size(content) > 1) & (F.length(heading) < TITLE_BELOW)
        rest = F.slice(content, 2, F.greatest(F.size(content), F.lit(1)))
        return F.when(
            F.size(content) > 0,
            F.struct(
                name.alias("reviewer_name"),
                rating.alias("rating"),
                F.when(titled, heading).otherwise(F.lit("")).alias("title"),
                F.when(titled, F.array_join(rest, " "))
                .otherwise(F.array_join(content, " "))
                .alias("body"),
                date.alias("date"),
                text.mentions(F.lower(t), OWNER_WORDS).alias("verified_purchase"),
            ),
        )

    return F.when(F.length(t) >= MIN_REVIEW, let(lines, assemble))


def review_array(blocks: Column, limit: int | None = None) -> Column:
    """Reviews read from text blocks, those without content left out."""
    if limit is not None:
        blocks = F.slice(blocks, 1, limit)
    return F.filter(F.transform(blocks, review_of_text), lambda r: r.isNotNull())


def parse_review_text(blocks: DataFrame, block: str = "text") -> DataFrame:
    """A review row per text block; other columns are kept."""
    keep = [c for c in blocks.columns if c != block]
    return (
        blocks.select(*keep, review_of_text(F.col(block)).alias("_r"))
        .filter(F.col("_r").isNotNull())
        .select(*keep, "_r.*")
    )
