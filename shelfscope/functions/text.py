"""Text rules for product and review fields, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from shelfscope.functions.bind import let

# fixed values: number patterns, tried in this order; the first group is the number
RATING_PATTERNS = (
    r"(\d+\.?\d*)\s*(?:out\s*of\s*5|/5|\s*stars?)",
    r"(\d+\.?\d*)\s*eggs?",
    r"rating[:\s]*(\d+\.?\d*)",
    r"(\d+\.?\d*)",
)
REVIEW_COUNT_PATTERNS = (
    r"\((\d+(?:,\d{3})*)\s*reviews?\)",
    r"(\d+(?:,\d{3})*)\s*reviews?",
    r"(\d+(?:,\d{3})*)\s*ratings?",
    r"(\d+(?:,\d{3})*)",
)
PRICE_PATTERN = r"\$?(\d+(?:\.\d{2})?)"

# fixed values: phrases
VERIFIED_PHRASES = (
    "verified purchase", "verified buyer", "confirmed purchase", "verified owner",
)
CHALLENGE_PHRASES = (
    "checking your browser before accessing",
    "please enable cookies and reload the page",
    "ddos protection by cloudflare",
    "cf-browser-verification",
    "challenge-platform",
    "just a moment",
    "cloudflare",
    "unusual traffic",
    "verify you are human",
    "checking your browser",
    "ray id",
)
LOADED_PHRASES = (
    "customer reviews", "add to cart", "price", "rating", "product", "specifications",
)
REVIEW_PHRASES = (
    "verified owner", "verified purchase", "pros:", "cons:", "overall review:",
    "helpful", "anonymous", "customer", "rating", "star", "egg", "recommend",
    "would buy",
)
SUMMARY_PHRASES = (
    "what reviewers are saying", "summary", "ai generated", "compatible with older",
    "good performance", "runs cool", "includes a cooler", "easy to install",
    "stock cooler",
)
USAGE_WORDS = ("bought", "purchased", "using", "installed")
BLOCK_PHRASES = ("verified owner", "pros:", "cons:", "overall review:", "rating")

# fixed values: brands looked for at the start of a title, then product lines
TITLE_BRANDS = (
    "AMD", "Intel", "NVIDIA", "ASUS", "MSI", "Gigabyte", "EVGA", "Corsair",
    "G.Skill", "Samsung", "Western Digital",
)
TITLE_LINES = ("Ryzen", "Core", "GeForce", "Radeon")

# fixed values: category of a title by the words it contains, first rule wins
TITLE_CATEGORIES = (
    ("CPU", ("cpu", "processor")),
    ("GPU", ("gpu", "graphics")),
    ("Motherboard", ("motherboard", "mobo")),
    ("Memory", ("memory", "ram")),
    ("Storage", ("storage", "ssd", "hdd")),
)

# whitespace as Unicode defines it, plus the four separator control characters
_SPACE = r"[\s\x{1C}-\x{1F}]"
_NOT_KEPT = r"(?U)[^\p{L}\p{N}_\s\-.,!?()$%&@#]"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_text(text: Column) -> Column:
    """Trim, collapse whitespace to single blanks, then delete every character that is
    not a letter, a numeral, ``_``, a blank or one of ``-.,!?()$%&@#``.

    Collapsing comes first, so a deleted symbol between blanks leaves two blanks. NULL
    becomes the empty text.
    """
    collapsed = F.regexp_replace(trim_space(text), rf"(?U){_SPACE}+", " ")
    return F.coalesce(F.regexp_replace(collapsed, _NOT_KEPT, ""), F.lit(""))


def _first(text: Column, pattern: str) -> Column:
    """First group of the first match, NULL when nothing matches."""
    found = F.regexp_extract(text, "(?i)" + pattern, 1)
    return let(found, lambda s: F.when(s != "", s))


def _number(text: Column, pattern: str, kind: str) -> Column:
    """The first group as a number; an empty match is not even tried."""
    found = F.regexp_extract(text, "(?i)" + pattern, 1)
    return let(
        found, lambda s: F.when(s != "", F.replace(s, F.lit(","), F.lit("")).try_cast(kind))
    )


def parse_price(text: Column) -> Column:
    """The first number of the text, commas ignored, with cents only if two digits follow."""
    return _number(F.replace(text, F.lit(","), F.lit("")), PRICE_PATTERN, "double")


def parse_rating(text: Column) -> Column:
    """The first pattern's first number that lies between 0 and 5."""

    def in_range(n: Column) -> Column:
        return F.when(n.between(0.0, 5.0), n)

    return F.coalesce(*[let(_number(text, p, "double"), in_range) for p in RATING_PATTERNS])


def parse_review_count(text: Column) -> Column:
    return F.coalesce(*[_number(text, p, "bigint") for p in REVIEW_COUNT_PATTERNS])


def mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text contains any of the phrases (compare lower case yourself)."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def is_verified_purchase(text: Column) -> Column:
    return F.coalesce(mentions(F.lower(text), VERIFIED_PHRASES), F.lit(False))


def review_key(name: Column, body: Column, date: Column) -> Column:
    """16 hex digits identifying a review; NULL without a name or a body.

    ``date`` is text; a missing date takes part as ``None``.
    """
    content = F.concat(name, body, F.coalesce(date, F.lit("None")))
    complete = (F.length(name) > 0) & (F.length(body) > 0)
    return F.when(complete, F.substring(F.md5(content), 1, 16))


def title_category(title: Column) -> Column:
    lower = F.lower(title)
    out = F.lit("Other")
    for category, words in reversed(TITLE_CATEGORIES):
        out = F.when(mentions(lower, words), F.lit(category)).otherwise(out)
    return out


def brand_of(brand_text: Column, title: Column) -> Column:
    """The page's brand text without its label, else a brand or product line in the title."""
    stated = clean_text(
        F.regexp_replace(brand_text, r"(?i)^(?:Brand:\s*|Manufacturer:\s*)", "")
    )
    makers = "|".join(b.replace(".", r"\.") for b in TITLE_BRANDS)
    maker = _first(title, rf"^({makers})\b")
    line = _first(title, rf"\b({'|'.join(TITLE_LINES)})\s+\w+")
    return F.when(F.length(brand_text) > 0, stated).otherwise(F.coalesce(maker, line))


def is_challenge(html: Column, title: Column, url: Column) -> Column:
    """Whether a crawled page is a bot challenge instead of content (detection only)."""
    return (
        F.coalesce(mentions(F.lower(html), CHALLENGE_PHRASES), F.lit(False))
        | F.coalesce(F.lower(title).contains("just a moment"), F.lit(False))
        | F.coalesce(F.lower(url).contains("cloudflare"), F.lit(False))
    )


def is_loaded(html: Column, shop_name: str | None = None) -> Column:
    """Whether a page shows any sign of shop content."""
    phrases = LOADED_PHRASES + ((shop_name.lower(),) if shop_name else ())
    return F.coalesce(mentions(F.lower(html), phrases), F.lit(False))


def looks_like_review(text: Column) -> Column:
    """Whether a block reads like one customer's review rather than a summary."""
    t = F.lower(text)
    individual = mentions(t, REVIEW_PHRASES)
    structured = (
        (t.contains("pros:") & t.contains("cons:"))
        | t.contains("overall review:")
        | t.contains("verified")
        | ((F.length(t) > 100) & mentions(t, USAGE_WORDS))
    )
    return F.coalesce(
        individual | (structured & ~mentions(t, SUMMARY_PHRASES)), F.lit(False)
    )
