"""Check SQL for the text, date and URL rules."""

from __future__ import annotations

from shelfscope.views import ctes

_F = ctes("field_texts")
_SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def cleaned(text: str) -> str:
    """The text cleaning rule in RE2 spelling."""
    return (
        rf"coalesce(regexp_replace(regexp_replace(regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), "
        rf"'{_SPACE}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-.,!?()$%&@#]', '', 'g'), '')"
    )


def first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, '(?i){pattern}', 1), '')"


def rating(text: str) -> str:
    tries = []
    for p in (
        r"(\d+\.?\d*)\s*(?:out\s*of\s*5|/5|\s*stars?)", r"(\d+\.?\d*)\s*eggs?",
        r"rating[:\s]*(\d+\.?\d*)", r"(\d+\.?\d*)",
    ):
        n = f"try_cast({first(text, p)} as double)"
        tries.append(f"case when {n} between 0 and 5 then {n} end")
    return f"coalesce({', '.join(tries)})"


def price(text: str) -> str:
    plain = f"replace({text}, ',', '')"
    return "try_cast(" + first(plain, r"\$?(\d+(?:\.\d{2})?)") + " as double)"


def review_count(text: str) -> str:
    tries = [
        f"try_cast(replace({first(text, p)}, ',', '') as bigint)"
        for p in (
            r"\((\d+(?:,\d{3})*)\s*reviews?\)", r"(\d+(?:,\d{3})*)\s*reviews?",
            r"(\d+(?:,\d{3})*)\s*ratings?", r"(\d+(?:,\d{3})*)",
        )
    ]
    return f"coalesce({', '.join(tries)})"


def date(text: str) -> str:
    tries = [
        f"try_strptime(nullif(regexp_extract({text}, '{p}', 1), ''), '{f}')"
        for p, f in (
            (r"(\d{1,2}/\d{1,2}/\d{4})", "%m/%d/%Y"), (r"(\d{4}-\d{2}-\d{2})", "%Y-%m-%d"),
            (r"([\p{L}\p{N}_]+ \d{1,2}, \d{4})", "%B %d, %Y"), (r"(\d{1,2} [\p{L}\p{N}_]+ \d{4})", "%d %B %Y"),
        )
    ]
    return f"strftime(coalesce({', '.join(tries)}), '%Y-%m-%d')"


def _any(text: str, phrases) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_CHALLENGE = (
    "checking your browser before accessing", "please enable cookies and reload the page",
    "ddos protection by cloudflare", "cf-browser-verification", "challenge-platform", "just a moment",
    "cloudflare", "unusual traffic", "verify you are human", "checking your browser", "ray id",
)

ORACLES = {
    "clean_text": f"select doc_id, {cleaned('text')} as text from documents",
    "parse_price": _F + f" select line_id, {price('price_text')} as price from field_texts",
    "parse_rating": _F + f" select line_id, {rating('rating_text')} as rating from field_texts",
    "parse_review_count": _F + f" select line_id, {review_count('count_text')} as review_count from field_texts",
    "parse_date": _F + f" select line_id, {date('date_text')} as parsed from field_texts",
    "parse_review_date": _F + r"""
select line_id, case when contains(review_date_text, 'T')
    then try_cast(regexp_replace(regexp_replace(review_date_text, '(T[^-+]*)[-+].*$', '\1'), 'Z+$', '') as timestamp)
    else coalesce(try_strptime(review_date_text, '%Y-%m-%d'), try_strptime(review_date_text, '%m/%d/%Y'),
      try_strptime(review_date_text, '%d/%m/%Y'), try_strptime(review_date_text, '%Y-%m-%d %H:%M:%S'),
      try_strptime(review_date_text, '%m/%d/%Y %H:%M:%S')) end as parsed from field_texts""",
    "parse_review_date_text": _F + r""",
t as (select line_id, date_text as x, lower(date_text) as low,
    regexp_extract(date_text, '^(\d{1,2})[/-](\d{1,2})[/-](\d{4})', ['m', 'd', 'y']) as n,
    regexp_extract(lower(date_text), '(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\s+(\d{1,2}),?\s+(\d{4})', ['m', 'd', 'y']) as w
  from field_texts)
select line_id, coalesce(case when regexp_matches(x, '^\d{4}-\d{2}-\d{2}') then x end,
  strftime(try_strptime(concat(n.y, '-', lpad(n.m, 2, '0'), '-', lpad(n.d, 2, '0')), '%Y-%m-%d'), '%Y-%m-%d'),
  strftime(try_strptime(concat(w.y, '-', substr(w.m, 1, 3), '-', lpad(w.d, 2, '0')), '%Y-%b-%d'), '%Y-%m-%d'), x) as parsed from t""",
    "verified_flag": _F + """
select line_id, coalesce(regexp_matches(lower(verified_text), 'verified purchase|verified buyer|confirmed purchase|verified owner'), false) as verified
from field_texts""",
    "review_key": _F + """
select line_id, case when reviewer_name <> '' and body <> ''
  then substr(md5(concat(reviewer_name, body, coalesce(review_day, 'None'))), 1, 16) end as review_id from field_texts""",
    "valid_urls": r"""
select page_id, target, regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as valid, contains(target, 'example.com') as shop
from (select page_id, case page_id % 5 when 0 then url when 1 then substr(url, 8) when 2 then concat('mailto:', url)
  when 3 then url else replace(url, '://', ':/') end as target from pages)""",
    "normalize_urls": r"""
select page_id, link, case when regexp_matches(link, '^https?://') then link
  when starts_with(link, '//') then concat(regexp_extract(url, '^[a-z]+:'), link)
  when starts_with(link, 'mailto:') then link
  when starts_with(link, '#') then concat(regexp_extract(url, '^[^#]+'), link)
  when starts_with(link, '/a/./b/../c/') then concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), replace(link, '/a/./b/../c/', '/a/c/'))
  when starts_with(link, '../../up/') then concat(regexp_extract(url, '^[a-z]+://[^/?#]+'),
    coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*/)', 1), '([^/]*/[^/]*/)$', ''), ''), '/'), 'up/')
  when starts_with(link, '/') then concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), link)
  when starts_with(link, '?') then concat(regexp_extract(url, '^[^?#]+'), link)
  else concat(regexp_extract(url, '^[a-z]+://[^?#]*/'), link) end as absolute
from (select page_id, url, unnest(list_concat(regexp_extract_all(html, 'href="([^"]*)"', 1),
  [url, concat('//cdn.example.org/', page_id), concat('item/', page_id, '.html'), concat('?page=', page_id),
   concat('../../up/./', page_id, '/../x/..'), concat('#at-', page_id), concat('/a/./b/../c/', page_id, '?q=/../'),
   concat('mailto:', page_id, '@example.org')])) as link from pages)""",
    "extract_brand": ctes("products") + r""",
t as (select id, case id % 6 when 0 then concat('Brand: ', brand) when 1 then concat('manufacturer:  ', brand) when 2 then brand else null end as brand_text,
  case id % 6 when 3 then concat('intel ', title) when 4 then concat('Fast G.Skill Ryzen 7 ', title) when 5 then concat('AMDock ', title) else title end as name from products)
select id, case when brand_text <> '' then """ + cleaned(r"regexp_replace(brand_text, '(?i)^(?:Brand:\s*|Manufacturer:\s*)', '')") + r"""
  else coalesce(nullif(regexp_extract(name, '(?i)^(AMD|Intel|NVIDIA|ASUS|MSI|Gigabyte|EVGA|Corsair|G\.Skill|Samsung|Western Digital)\b', 1), ''),
    nullif(regexp_extract(name, '(?i)\b(Ryzen|Core|GeForce|Radeon)\s+\w+', 1), '')) end as brand from t""",
    "flag_challenge_pages": r"""
with t as (select page_id, case page_id % 9 when 0 then 'https://challenge.CloudFlare.example/x' else url end as url,
    case page_id % 9 when 1 then replace(html, '</body>', '<p>Checking your browser</p></body>')
      when 2 then replace(html, '<title>', '<title>Just a moment') else html end as html from pages)
select page_id, """ + _any("lower(html)", _CHALLENGE) + r""" or contains(lower(url), 'cloudflare')
    or contains(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), 'just a moment') as challenge,
  """ + _any("lower(html)", ("customer reviews", "add to cart", "price", "rating", "product", "specifications")) + " as loaded from t",
    "review_like": "select conv_id, turn, " + (
        _any("lower(text)", ("verified owner", "verified purchase", "pros:", "cons:", "overall review:", "helpful", "anonymous",
                             "customer", "rating", "star", "egg", "recommend", "would buy"))
        + " or ((contains(lower(text), 'verified') or (length(text) > 100 and "
        + _any("lower(text)", ("bought", "purchased", "using", "installed")) + ")) and not "
        + _any("lower(text)", ("what reviewers are saying", "summary", "ai generated", "compatible with older", "good performance",
                               "runs cool", "includes a cooler", "easy to install", "stock cooler")) + ")"
    ) + " as review_like from conversations",
}
