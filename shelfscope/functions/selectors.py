"""Where shop pages keep their fields.

Fixed values: selector lists in order of preference.
"""

PRODUCT = {
    "title": (
        "h1.product-title", ".product-wrap h1", "[data-testid='product-title']",
        ".product-view-title h1", "h1",
    ),
    "brand": (
        ".product-brand a", ".product-brand", "[data-testid='product-brand']",
        ".brand-name", ".product-manufacturer",
    ),
    "price": (
        ".price-current", ".product-price .price-current", "[data-testid='product-price']",
        ".price-now", ".price-map", ".price",
    ),
    "rating": (
        ".rating-eggs", ".product-rating .rating", "[data-testid='product-rating']",
        ".overall-rating", ".rating-summary .rating",
    ),
    "review_count": (
        ".item-rating-num", ".rating-text", "[data-testid='review-count']",
        ".review-summary", ".customer-review-count",
    ),
    "description": (
        ".product-bullets", ".product-overview", "[data-testid='product-description']",
        ".product-details", ".product-summary",
    ),
}
RATING_ATTRIBUTES = ("data-rating", "data-value", "rating")
FILLED_RATING = (
    ".rating-eggs .rating-filled", ".rating-stars .filled", ".egg.full", ".star.filled",
)

REVIEW_ITEM = (
    "[class*='comment']:not([class*='summary'])",
    ".review-item:not(.product-vs-review)",
    ".customer-review:not([class*='summary'])",
    ".user-review",
    ".review-block:not([class*='summary'])",
    ".review:not([class*='summary']):not([class*='vs']):not([class*='banner'])",
    "[class*='review-item']:not([class*='summary'])",
    ".individual-review",
)
REVIEW = {
    "reviewer_name": (
        ".reviewer-name", "[class*='reviewer']:not([class*='summary'])", ".review-author",
        ".customer-name", ".review-by", ".user-name",
        "strong:first-child:not([class*='summary'])",
    ),
    "rating": (
        ".rating-eggs:not([class*='summary'])", "[class*='rating']:not([class*='summary'])",
        ".review-rating", ".stars", ".rating-stars", ".customer-rating",
        "[class*='egg']:not([class*='summary'])",
    ),
    "title": (
        ".review-title:not([class*='summary'])", ".review-heading", ".review-item-title",
        "h3:not([class*='summary'])", "h4:not([class*='summary'])",
        "h5:not([class*='summary'])", ".title:not([class*='summary'])",
    ),
    "body": (
        ".review-text:not([class*='summary'])", ".review-content:not([class*='summary'])",
        ".review-body", ".review-description", ".review-comment",
        ".overall-review:not([class*='summary'])",
        "p:not([class*='rating']):not([class*='date']):not([class*='summary'])",
    ),
    "date": (
        ".review-date", ".review-time", ".posted-date", ".review-timestamp",
        "[class*='date']:not([class*='summary'])", "time",
    ),
    "verified": (
        ".verified-owner", ".verified-purchase", ".verified-buyer", ".review-verified",
        "[class*='verified']",
    ),
}

#: Selectors of the rules themselves.
OTHER = ("html", "a[href]", "title", "div", "div.comments", "script", "script[type='application/ld+json']")

ALL = tuple(
    dict.fromkeys(
        [
            *(s for found in (PRODUCT, REVIEW) for group in found.values() for s in group),
            *FILLED_RATING, *REVIEW_ITEM, *OTHER,
        ]
    )
)
