"""Fixed table schemas."""

from __future__ import annotations

# catalogue columns in file order with the type each text value is converted to
CATALOG_COLUMNS = (
    ("title", "string"),
    ("category", "string"),
    ("discounted_price", "decimal(10,2)"),
    ("actual_price", "decimal(10,2)"),
    ("discount_percentage", "decimal(5,2)"),
    ("rating", "decimal(3,2)"),
    ("rating_count", "int"),
    ("about_product", "string"),
    ("user_id", "string"),
    ("user_name", "string"),
    ("review_id", "string"),
    ("review_title", "string"),
    ("review_content", "string"),
    ("img_link", "string"),
    ("product_link", "string"),
)

PRODUCTS = (
    "id bigint, title string, brand string, price double, rating double, "
    "review_count int, description string, url string, scraped_at timestamp_ntz, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
REVIEWS = (
    "id bigint, product_id bigint, reviewer_name string, rating double, title string, "
    "body string, review_date timestamp_ntz, verified_purchase boolean, "
    "helpful_count int, review_id string, product_url string, "
    "scraped_at timestamp_ntz, created_at timestamp_ntz"
)
SESSIONS = (
    "id bigint, url string, method_used string, success boolean, error_message string, "
    "total_reviews_extracted int, duration_seconds double, created_at timestamp_ntz"
)
METRICS = (
    "id bigint, product_id bigint, total_reviews bigint, scraping_method string, "
    "scraping_time decimal(10,3), timestamp timestamp_ntz"
)
