"""Check SQL for the product store, its merges and the crawl metrics."""

from __future__ import annotations

from shelfscope.views import ctes

_AS_OF = "timestamp '2024-01-31 00:00:00'"

_MERGE = ctes("products", "product_batch") + f""",
arrived as (select *, row_number() over (partition by url order by seq desc) as back,
    min(seq) over (partition by url) as first_seq from product_batch),
latest as (select * from arrived where back = 1)"""

_NEW = ctes("reviews", "review_batch") + f""",
stamped as (select *, try_cast(replace(replace(date, 'T', ' '), 'Z', '') as timestamp) as day,
    row_number() over (partition by review_id order by seq) as nr from review_batch),
fresh as (select * from stamped where review_id is null
    or (nr = 1 and review_id not in (select review_id from reviews)))"""

ORACLES = {
    "categorize_titles": ctes("products") + """
select id, title, case when regexp_matches(title, '(?i)cpu|processor') then 'CPU'
  when regexp_matches(title, '(?i)gpu|graphics') then 'GPU' when regexp_matches(title, '(?i)motherboard|mobo') then 'Motherboard'
  when regexp_matches(title, '(?i)memory|ram') then 'Memory' when regexp_matches(title, '(?i)storage|ssd|hdd') then 'Storage'
  else 'Other' end as category from products""",
    "import_products": ctes("products") + """
select id, title, brand, cast(cast(price as decimal(10,2)) as double) as price,
  cast(cast(rating as decimal(3,2)) as double) as rating, review_count, description,
  case when regexp_matches(title, '(?i)cpu|processor') then 'CPU'
  when regexp_matches(title, '(?i)gpu|graphics') then 'GPU' when regexp_matches(title, '(?i)motherboard|mobo') then 'Motherboard'
  when regexp_matches(title, '(?i)memory|ram') then 'Memory' when regexp_matches(title, '(?i)storage|ssd|hdd') then 'Storage'
  else 'Other' end as category, url, scraped_at, created_at from products""",
    "import_reviews": ctes("reviews") + """
select id, product_id, reviewer_name, cast(cast(rating as decimal(3,2)) as double) as rating, title, body,
  strftime(review_date, '%Y-%m-%d') as review_date, verified_purchase, helpful_count,
  cast(null as double) as sentiment_score, cast(length(body) as int) as review_length, scraped_at, created_at from reviews""",
    "merge_products": _MERGE + f"""
select p.id, coalesce(l.title, p.title) as title, case when l.url is null then p.brand else l.brand end as brand,
  case when l.url is null then p.price else l.price end as price,
  case when l.url is null then p.rating else l.rating end as rating,
  case when l.url is null then p.review_count else l.review_count end as review_count,
  case when l.url is null then p.description else l.description end as description,
  p.url, p.scraped_at, p.created_at, case when l.url is null then p.updated_at else {_AS_OF} end as updated_at
from products p left join latest l on p.url = l.url
union all
select (select max(id) from products) + row_number() over (order by first_seq), title, brand, price, rating, review_count,
  description, url, {_AS_OF}, {_AS_OF}, {_AS_OF}
from latest where url not in (select url from products)""",
    "new_reviews": _NEW + f"""
select product_id, reviewer_name, rating, title, body, day as review_date, verified_purchase,
  0 as helpful_count, review_id, product_url, {_AS_OF} as scraped_at, {_AS_OF} as created_at from fresh""",
    "delete_products": ctes("products") + """
select * from products where id not in (select l_partkey + 1 from lineitem where l_returnflag = 'R' and l_linenumber = 7)""",
    "product_by_url": ctes("products") + " select * from products where url = 'https://shop.example/p/42'",
    "product_by_id": ctes("products") + " select * from products where id = 43",
    "products_page": ctes("products") + """
select * replace (case when id % 7 <> 0 then created_at end as created_at),
  (select count(*) from products) as total, 70 < (select count(*) from products) as has_more
from products order by id % 7 = 0, created_at desc, id limit 50 offset 20""",
    "reviews_page": ctes("reviews") + """
select *, review_date as date, (select count(*) from reviews where product_id = 17) as total,
  15 < (select count(*) from reviews where product_id = 17) as has_more
from reviews where product_id = 17 order by created_at desc, id limit 10 offset 5""",
    "reviews_by_product": ctes("reviews") + " select * from reviews where product_id = 17",
    "product_with_reviews": ctes("products", "reviews") + """
select p.*, r.reviewer_name as review_reviewer_name, r.rating as review_rating, r.title as review_title,
  r.body as review_body, r.review_date as review_date, r.verified_purchase as review_verified_purchase
from products p left join (select * from reviews where product_id = 17 order by created_at desc, id) r on p.id = r.product_id
where p.id = 17""",
    "products_summary": ctes("products", "reviews") + """
select p.*, count(r.id) as actual_review_count, avg(r.rating) as avg_review_rating
from products p left join reviews r on p.id = r.product_id group by all""",
    "review_counts": ctes("products", "reviews") + """
select p.id, count(r.id) as review_count from products p left join reviews r on p.id = r.product_id group by p.id""",
    "products_nested": ctes("products", "reviews") + """,
docs as (select product_id, list({'reviewer_name': reviewer_name, 'rating': rating, 'title': title, 'body': body,
    'review_date': strftime(review_date, '%Y-%m-%d'), 'verified_purchase': verified_purchase} order by review_date, id) as rs
  from reviews group by product_id)
select p.*, 0 as part, coalesce(cast(to_json(d.rs) as varchar), '[]') as reviews
from products p left join docs d on p.id = d.product_id""",
    "products_nested_parts": ctes("products", "reviews") + """,
partly as (select * replace (case when id % 13 <> 0 then id end as id) from reviews),
units as (select product_id, review_date::date as day, floor(id / 7) as block, count(*) as n from partly group by all),
parts as (select product_id, day, block, cast(floor(coalesce(sum(n) over (partition by product_id order by day, block nulls first
    rows between unbounded preceding and 1 preceding), 0) / 7) as int) as part from units),
docs as (select r.product_id, part, string_agg(concat_ws(' ', title, body), ';' order by review_date, id nulls first, reviewer_name, rating, title, body) as rs
  from partly r join parts p on r.product_id = p.product_id and r.review_date::date = p.day
    and floor(r.id / 7) is not distinct from p.block group by all)
select p.id, coalesce(part, 0) as part, coalesce(rs, '') as reviews from products p left join docs d on p.id = d.product_id""",
    "store_overview": ctes("products", "reviews", "scraping_sessions") + """
select p.*, count(r.id) as actual_review_count, avg(r.rating) as avg_review_rating,
  (select count(*) from products) as store_total_products, (select count(*) from reviews) as store_total_reviews,
  (select count(*) from scraping_sessions) as store_total_sessions,
  (select round(avg(rating), 2) from reviews) as store_average_review_rating,
  (select round(sum(case when success then 1 else 0 end) * 100.0e0 / count(*), 2) from scraping_sessions) as store_scraping_success_rate
from products p left join reviews r on p.id = r.product_id group by all""",
    "products_after": ctes("products") + """
select * replace (case when id % 7 <> 0 then created_at end as created_at) from products
where id % 7 = 0 or created_at < timestamp '1990-01-01' or (created_at = timestamp '1990-01-01' and id > 40)
order by id % 7 = 0, created_at desc, id limit 30""",
    "products_after_undated": ctes("products") + """
select * replace (cast(null as timestamp) as created_at) from products where id % 7 = 0 and id > 40 order by id limit 30""",
    "search_catalogue": ctes("amazon_products") + """
select review_id, title, cast(discounted_price as double) as discounted_price, cast(rating as double) as rating from amazon_products
where contains(lower(title), 'brand#1') and discounted_price <= 30000 and rating >= 2""",
    "replace_products": ctes("products") + """,
held as (select id, title, brand, try_cast(price as decimal(10,2)) as price, try_cast(rating as decimal(3,2)) as rating, review_count,
  description, case when regexp_matches(title, '(?i)cpu|processor') then 'CPU'
    when regexp_matches(title, '(?i)gpu|graphics') then 'GPU' when regexp_matches(title, '(?i)motherboard|mobo') then 'Motherboard'
    when regexp_matches(title, '(?i)memory|ram') then 'Memory' when regexp_matches(title, '(?i)storage|ssd|hdd') then 'Storage'
    else 'Other' end as category, url, scraped_at, created_at from products),
newer as (select * replace (id * 2 as id, concat('new ', title) as title) from held where review_count > 25),
both_ as (select * from held where id not in (select id from newer) union all select * from newer)
select * replace (cast(price as double) as price, cast(rating as double) as rating) from both_""",
    "csv_line_breaks": ctes("amazon_products") + """
select review_id, title, category, cast(rating as double) as rating, rating_count,
  concat(review_content, chr(10), 'second, "line"', chr(10), chr(10), chr(13), chr(10), review_id) as review_content,
  false as rejected
from amazon_products""",
    "table_versions": ctes("products") + """,
second as (
  select id, case when id % 10 = 3 then upper(title) else title end as title, price from products where id % 10 <> 5
  union all select -id, title, price from products where id % 10 = 4)
select id, title, price, 1 as version from products union all select *, 2 from second union all select *, 3 from second""",
    "stored_lookups": ctes("products", "reviews") + """
select 'url' as way, id, title from products where url = 'https://shop.example/p/42'
union all select 'id', id, title from products where id = 44
union all select 'reviews', id, body from reviews where product_id = 17""",
    "rejected_values": ctes("amazon_products") + """
select count(*) as products,
  count(*) filter (where try_cast(cast(rating as double) * case when rating_count % 5 = 0 then 4.0e0 else 1.0e0 end as decimal(3,2)) is null
    and rating is not null) as ratings,
  count(*) filter (where try_cast(cast(discounted_price as double) * case when rating_count % 7 = 0 then 1e6 else 1.0e0 end as decimal(10,2)) is null
    and discounted_price is not null) as prices
from amazon_products""",
    "load_rejects": ctes("amazon_products") + """
select count(*) as read, count(*) filter (where rating_count = 13) as rejected,
  count(*) filter (where rating_count <> 13 and rating > 0 and category is not null) as kept from amazon_products""",
    "load_checked": ctes("amazon_products") + """,
t as (select title, category, case when rating_count <> 13 then rating end as rating, rating_count from amazon_products)
select count(*) as dataset_size, count(distinct coalesce(category, 'Unknown')) as unique_categories,
  count(*) filter (where rating > 0) as valid_ratings, cast(min(rating) as double) as min_rating, cast(max(rating) as double) as max_rating,
  count(*) filter (where category is null or category = '') as missing_categories, count(distinct title) as unique_products,
  round(count(*) filter (where rating > 0) * 100.0e0 / count(*), 2) as rating_completeness,
  count(*) filter (where rating_count <> 13 and rating > 0 and category is not null) as loaded,
  count(*) filter (where rating_count <> 13 and rating > 0 and category is not null) as last_id,
  count(*) filter (where rating_count <> 13 and rating > 0 and category is not null) as ids from t""",
    "analytics_summary": ctes("scraping_analytics") + """,
m as (select * replace (case when scraping_method <> 'error' then scraping_time end as scraping_time) from scraping_analytics)
select 'all' as block, null as key, count(*) as sessions, cast(sum(total_reviews) as bigint) as reviews,
  coalesce(round(avg(scraping_time), 6), 0) as mean_time from m
union all select 'method', scraping_method, count(*), cast(sum(total_reviews) as bigint), coalesce(round(avg(scraping_time), 6), 0) from m group by 2
union all select 'day', strftime(timestamp, '%Y-%m-%d'), count(*), cast(sum(total_reviews) as bigint), 0 from m
  where timestamp >= date '2024-01-31' - interval 7 days group by 2""",
    "store_stats": ctes("products", "reviews", "scraping_sessions") + """
select (select count(*) from products) as total_products, (select count(*) from reviews) as total_reviews,
  (select count(*) from scraping_sessions) as total_sessions,
  (select round(avg(rating), 2) from reviews) as average_review_rating,
  (select round(sum(case when success then 1 else 0 end) * 100.0e0 / count(*), 2) from scraping_sessions) as scraping_success_rate""",
    "search_products": ctes("products") + """
select * from (select *, case when regexp_matches(title, '(?i)cpu|processor') then 'CPU'
  when regexp_matches(title, '(?i)gpu|graphics') then 'GPU' when regexp_matches(title, '(?i)motherboard|mobo') then 'Motherboard'
  when regexp_matches(title, '(?i)memory|ram') then 'Memory' when regexp_matches(title, '(?i)storage|ssd|hdd') then 'Storage'
  else 'Other' end as category from products)
where price >= 900 and price <= 1200 and rating >= 2.5 and category = 'Memory'""",
    "products_in_category": ctes("amazon_products") + """
select title, cast(discounted_price as double) as discounted_price, cast(rating as double) as rating, product_link
from amazon_products where category = 'Brand#7'""",
    "expire_sessions": ctes("scraping_sessions") + """
select * from scraping_sessions where created_at >= timestamp '2024-01-31' - interval 14 days""",
    "expire_stored_sessions": ctes("scraping_sessions") + """
select * from scraping_sessions where created_at >= timestamp '2024-01-31 13:30:00' - interval 14 days""",
    "method_performance": ctes("scraping_analytics") + """
select scraping_method, count(*) as total_scraping_sessions, round(avg(scraping_time), 6) as avg_scraping_time,
  cast(sum(total_reviews) as bigint) as total_reviews_scraped, count(*) as method_count
from scraping_analytics group by scraping_method""",
    "recent_activity": ctes("scraping_analytics") + """
select strftime(timestamp, '%Y-%m-%d') as date, count(*) as sessions, cast(sum(total_reviews) as bigint) as reviews
from scraping_analytics where timestamp >= date '2024-01-31' - interval 7 days group by 1""",
    "session_totals": ctes("scraping_analytics") + """
select count(*) as total_sessions, round(coalesce(avg(scraping_time), 0), 6) as avg_time,
  cast(coalesce(min(scraping_time), 0) as double) as min_time, cast(coalesce(max(scraping_time), 0) as double) as max_time,
  cast(coalesce(sum(total_reviews), 0) as bigint) as total_reviews from scraping_analytics""",
    "append_metrics": ctes("scraping_analytics") + """
select cast((select max(id) from scraping_analytics) + row_number() over (order by o_orderkey) as bigint) as id,
  cast(o_custkey as bigint) as product_id, case when o_orderstatus = 'P' then 0 else cast(o_custkey % 40 as bigint) end as total_reviews,
  case when o_orderpriority = '5-LOW' then 'unknown' else o_orderpriority end as scraping_method,
  cast(cast(o_totalprice as decimal(10,3)) as double) as scraping_time, o_orderdate as timestamp from orders""",
    "append_sessions": ctes("scraping_sessions") + """
select (select max(id) from scraping_sessions) + row_number() over (order by o_orderkey) as id,
  concat('https://shop.example/p/', o_custkey) as url, o_orderpriority as method_used, o_orderstatus = 'F' as success,
  case when o_orderstatus <> 'F' then 'timeout' end as error_message,
  case when o_orderstatus = 'P' then 0 else cast(o_custkey % 40 as int) end as total_reviews_extracted,
  o_totalprice as duration_seconds, timestamp '2024-01-31' as created_at from orders""",
    "csv_scan": ctes("amazon_products") + """
select title, category, cast(discounted_price as varchar) as discounted_price, cast(actual_price as varchar) as actual_price,
  cast(discount_percentage as varchar) as discount_percentage,
  case when rating_count = 13 then 'n/a' else cast(rating as varchar) end as rating,
  case when rating_count = 17 then '17.5' else cast(rating_count as varchar) end as rating_count,
  case when rating_count = 11 then null else about_product end as about_product,
  case when rating_count = 11 then null else user_id end as user_id,
  case when rating_count = 11 then null else user_name end as user_name,
  case when rating_count = 11 then null else review_id end as review_id,
  case when rating_count = 11 then null else review_title end as review_title,
  case when rating_count = 11 then null else review_content end as review_content,
  case when rating_count = 11 then null else img_link end as img_link,
  case when rating_count = 11 then null else product_link end as product_link from amazon_products""",
    "load_catalog": ctes("amazon_products") + """
select row_number() over (order by review_id) as id, title, category, cast(discounted_price as double) as discounted_price,
  cast(actual_price as double) as actual_price, cast(discount_percentage as double) as discount_percentage,
  cast(rating as double) as rating, rating_count, about_product, user_id, user_name, review_id, review_title,
  review_content, img_link, product_link from amazon_products where rating > 0 and category is not null""",
    "load_counts": ctes("amazon_products") + """
select count(*) as read, count(*) filter (where rating_count = 13) as rejected,
  count(*) filter (where rating_count <> 13 and rating > 0 and category is not null) as kept from amazon_products""",
    "load_summary": ctes("amazon_products") + """
select count(*) as row_count, count(distinct category) as unique_categories, cast(min(rating) as double) as min_rating,
  cast(max(rating) as double) as max_rating, round(avg(rating), 2) as avg_rating
from amazon_products where rating > 0 and category is not null""",
    "table_info": ctes("products") + " " + " union all ".join(
        f"select '{c}' as column_name, '{k}' as column_type, count({c}) as filled, count(distinct {c}) as distinct_values, "
        f"min({v}) as least, max({v}) as greatest from products"
        for c, k, v in (
            ("id", "bigint", "cast(id as varchar)"), ("title", "string", "title"), ("brand", "string", "brand"),
            ("price", "double", "cast(price as varchar)"), ("rating", "double", "cast(rating as varchar)"),
            ("review_count", "int", "cast(review_count as varchar)"), ("description", "string", "description"),
            ("url", "string", "url"), ("scraped_at", "timestamp_ntz", "cast(scraped_at as varchar)"),
            ("created_at", "timestamp_ntz", "cast(created_at as varchar)"),
            ("updated_at", "timestamp_ntz", "cast(updated_at as varchar)"),
        )
    ),
    "stream_daily_activity": ctes("scraping_analytics") + """
select strftime(timestamp, '%Y-%m-%d') as date, count(*) as sessions, cast(sum(total_reviews) as bigint) as reviews
from scraping_analytics group by 1""",
    "stream_success_rate": ctes("scraping_sessions") + """
select strftime(created_at, '%Y-%m-%d') as date, method_used, count(*) as sessions,
  round(avg(case when success then 100.0e0 else 0 end), 6) as success_rate from scraping_sessions group by 1, 2""",
}
ORACLES["stream_merge_products"] = ORACLES["merge_products"]
ORACLES["stream_new_reviews"] = ORACLES["new_reviews"]
