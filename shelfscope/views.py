"""Catalogue, store and crawl tables expressed over the raw test tables.

Each view is one SQL text. It is used as is by Spark (over Parquet paths) and, with
plain table names and the few spelling differences below, as a CTE at the head of the
check SQL. No view ranks or groups rows: all are scans or one equi-join, so they grow
linearly and Catalyst prunes the columns a query does not ask for.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str
    root: str = ""
    # raw tables to be read from a named view (a stream) instead of their file
    streams: tuple[tuple[str, str], ...] = ()

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def table(self, table: str) -> str:
        if table in dict(self.streams):
            return dict(self.streams)[table]
        return f"parquet.`{self.root}/{table}.parquet`" if self.spark else table

    @property
    def ts(self) -> str:
        return "timestamp_ntz" if self.spark else "timestamp"

    def key60(self, text: str) -> str:
        """A 60-bit number from the MD5 of a text."""
        head = f"substr(md5({text}), 1, 15)"
        if self.spark:
            return f"cast(conv({head}, 16, 10) as bigint)"
        return f"cast(concat('0x', {head}) as bigint)"


DUCK = Dialect("duck")

_LINE = "concat_ws('-', {})".format(
    ", ".join(
        f"cast({c} as varchar(40))"
        for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            "cast(l_quantity as bigint)", "cast(l_extendedprice as decimal(12,2))",
        )
    )
)


def _amazon_products(d: Dialect) -> str:
    return f"""
select concat(p_name, ' ', p_brand) as title,
  case when p_size = 50 then null when p_size = 49 then '' else p_brand end as category,
  cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(10,2)) as discounted_price,
  cast(l_extendedprice as decimal(10,2)) as actual_price,
  cast(cast(l_discount as decimal(4,2)) * 100 as decimal(5,2)) as discount_percentage,
  case when l_linenumber = 7 and l_tax = 0.08 then null
       when l_linenumber = 7 and l_tax = 0.07 then cast(0 as decimal(3,2))
       else cast((cast(l_quantity as int) % 10
         + case p_brand when 'Brand#1' then 18 when 'Brand#2' then 22 when 'Brand#3' then 24
             when 'Brand#4' then 27 else 36 end) / 10.0e0 as decimal(3,2)) end as rating,
  cast(l_quantity as int) as rating_count,
  p_type as about_product,
  concat('U', cast(l_suppkey as varchar(20))) as user_id,
  concat('user', cast(l_suppkey as varchar(20))) as user_name,
  substr(md5({_LINE}), 1, 24) as review_id,
  concat('line ', cast(l_linenumber as varchar(20))) as review_title,
  concat('order ', cast(l_orderkey as varchar(20)), ', item "', p_name, '"') as review_content,
  concat('https://img.shop.example/', cast(p_partkey as varchar(20)), '.jpg') as img_link,
  concat('https://shop.example/p/', cast(p_partkey as varchar(20))) as product_link
from {d.table('lineitem')} join {d.table('part')} on l_partkey = p_partkey"""


def _products(d: Dialect) -> str:
    """A product per part, and for large parts a second one that nobody reviewed and no
    batch knows."""
    return f"""
with every as (
  select p_partkey + 1 as id, cast(p_partkey as varchar(20)) as page, * from {d.table('part')}
  union all
  select p_partkey + 500000001 as id, concat('x', cast(p_partkey as varchar(20))) as page, * from {d.table('part')} where p_size > 43)
select id,
  concat(p_name, ' ', case p_size % 7 when 0 then 'CPU cooler' when 1 then 'Graphics card'
    when 2 then 'mobo' when 3 then 'RAM kit' when 4 then 'SSD' when 5 then 'frame'
    else 'bracket' end) as title,
  p_brand as brand,
  p_retailprice as price,
  case when p_size = 50 then null else p_size / 10.0e0 end as rating,
  p_size as review_count,
  p_type as description,
  concat('https://shop.example/p/', page) as url,
  cast(date '2024-01-01' + cast(p_partkey % 365 as int) as {d.ts}) as scraped_at,
  cast(date '2024-01-01' + cast(p_partkey % 365 as int) as {d.ts}) as created_at,
  cast(date '2024-01-01' + cast(p_partkey % 365 as int) as {d.ts}) as updated_at
from every"""


def _reviews(d: Dialect) -> str:
    return f"""
select {d.key60(_LINE)} as id,
  l_partkey + 1 as product_id,
  concat('user', cast(l_suppkey as varchar(20))) as reviewer_name,
  case when l_tax = 0.08 then null else cast(1 + cast(l_quantity as int) % 5 as double) end as rating,
  concat('line ', cast(l_linenumber as varchar(20))) as title,
  concat('order ', cast(l_orderkey as varchar(20)), ' item ', cast(l_partkey as varchar(20))) as body,
  l_shipdate as review_date,
  l_returnflag = 'R' as verified_purchase,
  l_linenumber as helpful_count,
  substr(md5(concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))), 1, 16) as review_id,
  concat('https://shop.example/p/', cast(l_partkey as varchar(20))) as product_url,
  l_shipdate as scraped_at,
  l_shipdate as created_at
from {d.table('lineitem')}"""


def _scraping_sessions(d: Dialect) -> str:
    return f"""
select event_id as id,
  concat('https://shop.example/p/', cast(user_id as varchar(20))) as url,
  event_type as method_used,
  event_type <> 'error' as success,
  case when event_type = 'error' then 'timeout' end as error_message,
  cast(floor(value) as int) as total_reviews_extracted,
  value as duration_seconds,
  ts as created_at
from {d.table('events')}"""


def _scraping_analytics(d: Dialect) -> str:
    return f"""
select cast(event_id as bigint) as id,
  cast(user_id as bigint) as product_id,
  cast(floor(value) as bigint) as total_reviews,
  event_type as scraping_method,
  cast(value as decimal(10,3)) as scraping_time,
  ts as timestamp
from {d.table('events')}"""


def _product_batch(d: Dialect) -> str:
    """A crawl batch: two price observations for most parts, plus unseen products.

    ``seq`` is the order inside the batch; the later row of a URL wins.
    """
    return f"""
select concat(p_name, ' v2') as title, p_brand as brand, p_retailprice + 5 as price,
  4.5e0 as rating, p_size + 1 as review_count, p_type as description,
  concat('https://shop.example/p/', cast(p_partkey as varchar(20))) as url,
  p_partkey as seq
from {d.table('part')}
union all
select concat(p_name, ' v3') as title, p_brand as brand, p_retailprice + 9 as price,
  case when p_size % 2 = 0 then null else 4.0e0 end as rating, p_size + 2 as review_count,
  p_type as description,
  concat('https://shop.example/p/', cast(p_partkey + case when p_size > 40 then 100000000 else 0 end as varchar(20))) as url,
  p_partkey + 1000000000 as seq
from {d.table('part')}"""


def _review_batch(d: Dialect) -> str:
    """A crawl batch of reviews: known keys, unseen keys, repeats and missing keys."""
    return f"""
select l_partkey + 1 as product_id,
  concat('user', cast(l_suppkey as varchar(20))) as reviewer_name,
  cast(1 + cast(l_quantity as int) % 5 as double) as rating,
  concat('line ', cast(l_linenumber as varchar(20))) as title,
  concat('order ', cast(l_orderkey as varchar(20))) as body,
  case when l_linenumber = 1 then '2023-02-30'
       when l_linenumber = 2 then concat(substr(cast(l_shipdate as varchar(40)), 1, 10), 'T10:20:30Z')
       else substr(cast(l_shipdate as varchar(40)), 1, 10) end as date,
  l_returnflag = 'R' as verified_purchase,
  case when l_linenumber = 3 then null
       when l_linenumber > 5 then substr(md5(concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))), 1, 16)
       else substr(md5(concat('new', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))), 1, 16) end as review_id,
  concat('https://shop.example/p/', cast(l_partkey as varchar(20))) as product_url,
  {d.key60(_LINE)} as seq
from {d.table('lineitem')}"""


def _field_texts(d: Dialect) -> str:
    """Page texts with numbers and dates in the wordings the field rules know."""
    n = "cast(l_linenumber as varchar(20))"
    q = "cast(cast(l_quantity as int) as varchar(20))"
    price = "cast(cast(l_extendedprice as decimal(12,2)) as varchar(20))"
    iso = "substr(cast(l_shipdate as varchar(40)), 1, 10)"
    year, month, day = (f"substr({iso}, {a}, {b})" for a, b in ((1, 4), (6, 2), (9, 2)))
    month_name = (
        f"case {month} when '01' then 'January' when '02' then 'February' when '03' then 'March' "
        "when '04' then 'April' when '05' then 'May' when '06' then 'June' when '07' then 'July' "
        "when '08' then 'August' when '09' then 'September' when '10' then 'October' "
        "when '11' then 'November' else 'December' end"
    )
    kind = "(l_linenumber + cast(l_quantity as int)) % 8"
    tenths = "cast(cast((cast(l_quantity as int) % 45) / 10.0e0 as decimal(3,1)) as varchar(20))"
    return f"""
select {d.key60(_LINE)} as line_id,
  case {kind}
    when 0 then concat('$', {price}) when 1 then concat('£', {price}, ' each')
    when 2 then concat('from $', {q}, ',', {q}, {q}, '0.9') when 3 then concat('now ', {q}, ' to ', {n})
    when 4 then 'free' when 5 then '' when 6 then null else concat('USD 1,', {q}, '00.50') end as price_text,
  case {kind}
    when 0 then concat({tenths}, ' out of 5') when 1 then concat({tenths}, '/5')
    when 2 then concat({n}, ' eggs') when 3 then concat('Rating: ', {tenths})
    when 4 then concat({q}, ' stars then ', {tenths}) when 5 then concat('score ', {q})
    when 6 then null else concat({tenths}, ' OUT OF 5 STARS') end as rating_text,
  case {kind}
    when 0 then concat('(', {n}, ',', {q}, '00 reviews)') when 1 then concat({q}, ' ratings')
    when 2 then {q} when 3 then 'none' when 4 then concat('See 1,2', {q}, ' Review')
    when 5 then concat('(', {q}, ')') when 6 then null else concat({n}, ' of ', {q}, ' reviews') end as count_text,
  case {kind}
    when 0 then concat('on ', {month}, '/', {day}, '/', {year}) when 1 then concat({iso}, ' posted')
    when 2 then concat({month_name}, ' ', {day}, ', ', {year})
    when 3 then concat('Reviewed ', {day}, ' ', lower({month_name}), ' ', {year})
    when 4 then concat(substr({month_name}, 1, 3), ' ', {day}, ', ', {year}) when 5 then concat({year}, '-02-30')
    when 6 then null else concat({iso}, 'T11:59:08.95-05:00') end as date_text,
  case {kind}
    when 0 then concat({month}, '/', {day}, '/', {year}) when 1 then {iso}
    when 2 then concat({iso}, ' 08:09:10') when 3 then concat({month}, '/', {day}, '/', {year}, ' 08:09:10')
    when 4 then concat({day}, '/', {month}, '/', {year}) when 5 then concat({iso}, 'T11:59:08Z')
    when 6 then 'yesterday' else concat({iso}, 'T11:59:08.95-05:00') end as review_date_text,
  case {kind}
    when 0 then 'Verified Purchase' when 1 then 'VERIFIED BUYER since 2019' when 2 then 'confirmed purchase'
    when 3 then 'Verified Owner' when 4 then 'unverified' when 5 then '' when 6 then null
    else 'purchase confirmed' end as verified_text,
  concat('user', cast(l_suppkey as varchar(20))) as reviewer_name,
  case when {kind} = 4 then null when {kind} = 5 then '' else concat('order ', cast(l_orderkey as varchar(20))) end as body,
  case when {kind} = 3 then null else {iso} end as review_day
from {d.table('lineitem')}"""


def _page_facts(d: Dialect) -> str:
    """What each shop page says: product fields and up to three reviews, from its id."""
    k = "page_id"
    pick = lambda n, *vs: "case " + k + f" % {n} " + " ".join(
        f"when {i} then {v}" for i, v in enumerate(vs)
    ) + " end"
    cols = [
        "page_id", "url", "html",
        f"{k} % 5 as strategy", f"{k} % 4 as n_reviews",
        pick(4, "'ASUS'", "'Corsair'", "'G.Skill'", "'Noctua'") + " as brand",
        f"cast(({k} * 7919) % 200000 + 100 as bigint) as price_cents",
        f"cast(({k} % 46) / 10.0e0 as decimal(3,1)) as stars",
        f"cast(1 + ({k} * 31) % 999 as bigint) as shown_reviews",
    ]
    for i in (1, 2, 3):
        cols += [
            f"case ({k} + {i}) % 3 when 0 then 'Ann Lee' when 1 then 'Bob' else 'Cy R. Dow' end as name_{i}",
            f"1 + ({k} + {i}) % 5 as rating_{i}",
            f"concat('Verdict ', cast({i} as varchar(2)), ' on item ', cast({k} as varchar(20))) as title_{i}",
            f"concat('Works well in build ', cast({k} as varchar(20)), ' after week ', cast({i} as varchar(2)), ', café ½ price') as body_{i}",
            f"cast(date '2023-01-01' + cast(({k} * {i}) % 300 as int) as varchar(10)) as day_{i}",
        ]
    return f"select {', '.join(cols)} from {d.table('pages')}"


def _shop_pages(d: Dialect) -> str:
    """The raw pages with product markup and reviews in one of five forms added."""
    price = (
        "cast(cast(floor(price_cents / 100) as bigint) as varchar(20))",
        "lpad(cast(price_cents % 100 as varchar(2)), 2, '0')",
    )
    stars = "cast(stars as varchar(5))"
    product = f"""concat(
    case page_id % 3 when 0 then concat('<div class="product-brand"> <a href="/b">', brand, '</a></div>')
      when 1 then concat('<span class="brand-name">Brand: ', brand, '</span>') else '' end,
    '<ul class="price"><li class="price-was">$9,999.99</li><li class="price-current">$<strong>', {price[0]},
    '</strong><sup>.', {price[1]}, '</sup></li></ul>',
    case page_id % 3 when 0 then concat('<div class="rating-eggs" data-rating="', {stars}, '"></div>')
      when 1 then concat('<div class="product-rating"><span class="rating">', {stars}, '/5</span></div>')
      else '<span class="rating-stars"><i class="filled"></i><i class="filled"></i><i class="filled"></i><i></i></span>' end,
    '<span class="item-rating-num">(', cast(shown_reviews as varchar(5)), ' Reviews)</span>',
    '<div class="product-bullets"><ul><li>Fast</li><li> quiet fan </li></ul></div>',
    '<div class="product-overview">Long description of item ', cast(page_id as varchar(20)), ' with more than fifty letters in it</div>')"""

    def slots(make, glue: str = "") -> str:
        parts = [
            f"case when n_reviews >= {i} then concat({repr(glue) if glue and i > 1 else chr(39) * 2}, {make(i)}) else '' end"
            for i in (1, 2, 3)
        ]
        return "concat(" + ", ".join(parts) + ")"

    def ld(i: int, author: str) -> str:
        return (
            f"""concat('{{"@type":"Review","author":{author[0]}', name_{i}, '{author[1]},"reviewRating":{{"ratingValue":"', """
            f"""cast(rating_{i} as varchar(2)), '"}},"headline":"', title_{i}, '","reviewBody":"', body_{i}, """
            f"""'","datePublished":"', day_{i}, '"}}')"""
        )

    product_ld = slots(lambda i: ld(i, ('{"@type":"Person","name":"', '"}')), ",")
    listed_ld = slots(lambda i: ld(i, ('"', '"')), ",")
    blob = slots(
        lambda i: f"""case when page_id % 2 = 0
      then concat('{{"Comments": "', body_{i}, '","Image":{{"u":1,"Rating":9}},"Alt":"a {{b c","Rating": ', cast(rating_{i} as varchar(2)), ',"NickName": "', name_{i}, '"}}')
      else concat('{{"Rating": ', cast(rating_{i} as varchar(2)), ',"NickName": "', name_{i}, '","Comments": "', body_{i}, '"}}') end""",
        ",",
    )
    markup = slots(
        lambda i: f"""concat('<div class="review-item"><span class="reviewer-name">', name_{i}, '</span><i class="stars">',
      cast(rating_{i} as varchar(2)), ' out of 5</i><h4> ', title_{i}, '</h4><div class="review-text"><p>', body_{i},
      '</p></div><time>', day_{i}, '</time><span class="verified-owner">Verified Owner</span></div>')"""
    )
    block = slots(
        lambda i: f"""concat('<div class="comments">\nBy ', name_{i}, '\nVerified Owner\n', cast(rating_{i} as varchar(2)),
      ' out of 5\n<b>', title_{i}, '</b>\n', body_{i}, '\n', day_{i}, '\n</div>')"""
    )
    if d.spark:
        nl = lambda x: x  # noqa: E731 - Spark reads \n in a literal as a line break
    else:
        nl = lambda x: x.replace("\\n", "', chr(10), '")
    return f"""select page_id, url, replace(html, '</article>', concat({product}, case strategy
  when 0 then concat('<script type="application/ld+json">{{"@context":"x","@type":"Product","name":"p","review":[', {product_ld}, ']}}</script>')
  when 1 then concat('<script type="application/ld+json">{{broken</script><script type="application/ld+json">[', {listed_ld}, ']</script>')
  when 2 then concat('<script>window.__initialState__ = {{"ReviewInfo":{{"list":[', {blob}, ']}}}};</script>')
  when 3 then {markup}
  else {nl(block)} end, '</article>')) as html
from page_facts"""


def _review_records(d: Dialect) -> str:
    """Raw JSON review records with the different field names in use."""
    day = "substr(cast(l_shipdate as varchar(40)), 1, 10)"
    rating = "cast(1 + cast(l_quantity as int) % 5 as varchar(2))"
    name = "concat('user', cast(l_suppkey as varchar(20)))"
    body = "concat('order ', cast(l_orderkey as varchar(20)), '!')"
    title = "concat('line ', cast(l_linenumber as varchar(20)))"
    return f"""
select {d.key60(_LINE)} as line_id, case l_linenumber % 4
  when 0 then concat('{{"NickName":"', {name}, '","Rating":', {rating}, ',"Title":"', {title}, '","Comments":"', {body},
    '","InDate":"', {day}, '","HasPurchased":true,"TotalVoting":3}}')
  when 1 then concat('{{"DisplayName":"', {name}, '","rating":"', {rating}, '","headline":"', {title}, '","text":"', {body},
    '","review_date":"', {day}, 'T10:20:30Z","verified_purchase":false,"helpful_count":0,"upvotes":2}}')
  when 2 then concat('{{"NickName":"","author":"', {name}, '","Rating":0,"rating":', {rating}, ',"Title":"","title":null,"body":"', {body},
    '","Pros":"cheap","Cons":"loud"}}')
  else concat('{{"reviewer_name":null,"Rating":"n/a","content":"","Pros":"', {title}, '"}}') end as record
from {d.table('lineitem')}"""


VIEWS = {
    "amazon_products": _amazon_products,
    "products": _products,
    "reviews": _reviews,
    "scraping_sessions": _scraping_sessions,
    "scraping_analytics": _scraping_analytics,
    "product_batch": _product_batch,
    "review_batch": _review_batch,
    "field_texts": _field_texts,
    "review_records": _review_records,
    "page_facts": _page_facts,
    "shop_pages": _shop_pages,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the raw tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the raw tables in ``sf_dir``."""
    dialect = Dialect("spark", sf_dir.rstrip("/"))
    sql = VIEWS[name](dialect)
    if name == "shop_pages":
        sql = f"with page_facts as ({_page_facts(dialect)})\n{sql}"
    return spark.sql(sql)


def stream_view(spark: SparkSession, sf_dir: str, name: str, raw: str) -> DataFrame:
    """A view whose raw table ``raw`` arrives as a file stream."""
    path = f"{sf_dir}/{raw}.parquet"
    # a file stream wants a folder or a pattern; the pattern fits one file and a folder
    pattern = f"{sf_dir}/{raw}.parque[t]"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)
    return _over(spark, sf_dir, name, raw, stream)


def dealt_view(spark: SparkSession, sf_dir: str, name: str, raw: str) -> DataFrame:
    """A view whose raw table ``raw``, if its file has fewer row groups than there are cores,
    is dealt over the cores first; larger tables are split by the scan."""
    rows = table(spark, sf_dir, raw)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return _over(spark, sf_dir, name, raw, rows)


def _over(spark: SparkSession, sf_dir: str, name: str, raw: str, rows: DataFrame) -> DataFrame:
    """A view with ``rows`` in place of the raw table ``raw``."""
    source = f"rows_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(source)
    out = spark.sql(VIEWS[name](Dialect("spark", sf_dir.rstrip("/"), ((raw, source),))))
    spark.catalog.dropTempView(source)  # the name is resolved by now
    return out


def ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for the check SQL."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n](DUCK)})" for n in names)
