"""Check SQL for the catalogue analysis: plain aggregates over the raw tables."""

from __future__ import annotations

from shelfscope.views import ctes

_RATED = ctes("amazon_products") + """,
rated as (select category, rating from amazon_products where rating is not null),
whole as (select avg(rating) as m, stddev_pop(rating) as s from rated)"""

_TABLE = _RATED + """,
grouped as (
  select category, count(*) as product_count, avg(rating) as mean, stddev_pop(rating) as sd,
    var_pop(rating) as var, min(rating) as lo, max(rating) as hi, median(rating) as q2,
    quantile_cont(rating, 0.25) as q1, quantile_cont(rating, 0.75) as q3,
    sum(case when rating >= 4 then 1 else 0 end) as high
  from rated where category <> '' group by category),
cats as (
  select category, product_count, mean,
    round(mean, 3) as avg_rating, round(sd, 3) as rating_stddev, round(var, 3) as rating_variance,
    cast(lo as double) as min_rating, cast(hi as double) as max_rating,
    cast(round(q2, 1) as double) as median_rating,
    round(cast(high as double) * 100 / product_count, 1) as high_rating_percentage,
    cast(round(q1, 1) as double) as q1_rating, cast(round(q3, 1) as double) as q3_rating,
    cast(round(q3 - q1, 1) as double) as iqr,
    round((mean - m) / nullif(s, 0), 2) as z_score,
    case when abs((mean - m) / nullif(s, 0)) > 2 then 'Significant'
         when abs((mean - m) / nullif(s, 0)) > 1 then 'Notable' else 'Normal' end as significance_level
  from grouped cross join whole)"""

_LABELLED = _RATED + """,
labelled as (
  select category, count(*) as n, avg(rating) as mean, stddev_pop(rating) as sd, var_pop(rating) as var,
    (avg(rating) - any_value(m)) / nullif(any_value(s), 0) as z
  from rated cross join whole where category is not null group by category)"""

_OVERALL = """,
overall as (
  select count(*) as total_products, count(distinct category) as unique_categories,
    round(avg(rating), 3) as overall_average_rating, round(stddev_pop(rating), 3) as overall_stddev,
    cast(median(rating) as double) as median_rating,
    cast(mode() within group (order by rating) as double) as mode_rating,
    cast(min(rating) as double) as min_rating, cast(max(rating) as double) as max_rating,
    cast(sum(case when rating >= 4 then 1 else 0 end) as bigint) as high_rated_products,
    cast(sum(case when rating <= 2 then 1 else 0 end) as bigint) as low_rated_products,
    round(sum(case when rating >= 4 then 100.0e0 else 0 end) / count(*), 2) as high_rated_percentage,
    round(sum(case when rating <= 2 then 100.0e0 else 0 end) / count(*), 2) as low_rated_percentage
  from rated)"""

_REPORT = "order by mean desc, product_count desc, category"
_REPORT_BACK = "order by mean, product_count, category desc"


def _ranking(name: str, measure: str, direction: str) -> str:
    return f"""select '{name}' as ranking,
  cast(row_number() over (order by {measure} {direction}, mean desc, product_count desc, category) as int) as position,
  category, round({measure}, 6) as value
from varied qualify position <= 5"""


_EXTREMES = _TABLE + _OVERALL + f""",
ranked as (select *,
    row_number() over ({_REPORT}) as nr,
    row_number() over ({_REPORT_BACK}) as back,
    row_number() over (order by rating_variance desc, mean desc, product_count desc, category) as most,
    row_number() over (order by rating_variance, mean desc, product_count desc, category) as least,
    row_number() over (order by rating_stddev desc, mean desc, product_count desc, category) as most_sd,
    row_number() over (order by rating_stddev, mean desc, product_count desc, category) as least_sd,
    row_number() over (order by avg_rating desc, mean desc, product_count desc, category) as best_avg,
    row_number() over (order by avg_rating, mean desc, product_count desc, category) as worst_avg,
    count(*) over () as n_cats
  from cats),
findings as (
  select 1 as k, concat('''', category, ''' is the top-performing category with ', format('{{:.2f}}', avg_rating),
    ' average rating from ', format('{{:,}}', product_count), ' products') as t from ranked where nr = 1
  union all select 2, concat('''', category, ''' shows the lowest performance with ', format('{{:.2f}}', avg_rating),
    ' average rating') from ranked where back = 1 and n_cats > 1
  union all select 3, concat('''', category, ''' shows highest rating variability (σ²=', format('{{:.3f}}', rating_variance),
    '), indicating inconsistent product quality') from ranked where most = 1 and n_cats > 1
  union all select 4, concat('''', category, ''' demonstrates most consistent quality (σ²=', format('{{:.3f}}', rating_variance), ')')
    from ranked where least = 1 and n_cats > 1
  union all select 5, concat(count(*), ' categories show statistically significant performance differences from the dataset mean')
    from ranked where significance_level = 'Significant' having count(*) > 0
  union all select 6, case when high_rated_percentage > 0
      then concat(format('{{:.1f}}', high_rated_percentage), '% of all products receive high ratings (4.0+)')
    when overall_average_rating >= 4 then concat('Overall dataset shows strong performance with ', format('{{:.2f}}', overall_average_rating), ' average rating')
    else concat('Dataset average rating is ', format('{{:.2f}}', overall_average_rating)) end from overall),
finding_rows as (
  select row_number() over (order by k) as position, t as finding from findings qualify position <= 6),
zs as (
  select category, round(z, 2) as z_score, row_number() over (order by abs(z) desc nulls last, category) as far,
    case when abs(z) > 2 then 'Significant' when abs(z) > 1 then 'Notable' else 'Normal' end as level
  from (select category, (avg(rating) - any_value(m)) / nullif(any_value(s), 0) as z
        from rated cross join whole where category is not null group by category)),
advised as (
  select 1 as k, concat('Focus on ''', category, ''' category - consistently high ratings (', format('{{:.2f}}', avg_rating), ')') as t
    from (select category, avg_rating from cats cross join overall where avg_rating > overall_average_rating + 0.2e0 {_REPORT} limit 1)
  union all select 2, concat('Investigate ''', category, ''' category - below average ratings (', format('{{:.2f}}', avg_rating), ')')
    from (select category, avg_rating from cats cross join overall where avg_rating < overall_average_rating - 0.2e0 {_REPORT_BACK} limit 1)
  union all select 3, concat('Review quality control for ''', category, ''' - high rating variability (σ=', format('{{:.2f}}', rating_stddev), ')')
    from (select category, rating_stddev from cats where rating_stddev > 1 {_REPORT} limit 1)
  union all select 4, concat('''', category, ''' shows consistent quality - good benchmark for other categories')
    from (select category from cats where rating_stddev < 0.5e0 {_REPORT} limit 1)
  union all select 4 + row_number() over (order by far), case
      when z_score > 2 then concat('''', category, ''' significantly outperforms average (z-score: ', format('{{:.2f}}', z_score), ')')
      when z_score < -2 then concat('''', category, ''' significantly underperforms average (z-score: ', format('{{:.2f}}', z_score), ')') end
    from (select * from zs where level = 'Significant' order by far limit 2)),
advice_rows as (
  select row_number() over (order by k) as position, t as recommendation from advised where t is not null qualify position <= 5)"""

ORACLES = {
    "category_stats": _TABLE + " select * exclude (mean) from cats",
    "export_results": _TABLE + """
select columns(* exclude (mean, min_rating, max_rating))::varchar,
  cast(cast(min_rating as decimal(3,2)) as varchar) as min_rating, cast(cast(max_rating as decimal(3,2)) as varchar) as max_rating from cats""",
    "overall_stats": _RATED + _OVERALL + " select * from overall",
    "category_significance": _LABELLED + """
select category, n as count, round(mean, 3) as avg_rating, round(sd, 3) as stddev, round(z, 2) as z_score,
  case when abs(z) > 2.58 then 'Highly Significant (p<0.01)' when abs(z) > 1.96 then 'Significant (p<0.05)'
       when abs(z) > 1.64 then 'Notable (p<0.10)' else 'Normal' end as significance_level
from labelled order by abs(z) desc nulls last, category limit 20""",
    "zscore_categories": _LABELLED + """
select category, n as sample_size, round(mean, 3) as avg_rating, round(z, 2) as z_score,
  case when abs(z) > 2 then 'Significant' when abs(z) > 1 then 'Notable' else 'Normal' end as significance_level
from labelled""",
    "variability_top": _LABELLED + " select category, round(var, 3) as variance from labelled order by var desc, category limit 5",
    "variability_bottom": _LABELLED + " select category, round(var, 3) as variance from labelled order by var, category limit 5",
    "rating_distribution_overall": _RATED + """
select cast(floor(rating) as int) as rating, count(*) as count,
  round(count(*) * 100.0e0 / (select count(*) from rated), 2) as percentage
from rated group by 1""",
    "rating_distribution": _RATED + """,
stars as (select category, cast(floor(rating) as int) as rating_floor, count(*) as count from rated where rating > 0 group by 1, 2)
select category, rating_floor, count,
  round(count * 100.0e0 / sum(count) over (partition by category), 6) as percentage from stars""",
    "variability_rankings": _TABLE + """,
varied as (select *, rating_stddev / nullif(avg_rating, 0) as coefficient_of_variation from cats)
""" + " union all ".join(
        f"({_ranking(*r)})"
        for r in (
            ("highest_variance_categories", "rating_variance", "desc"),
            ("lowest_variance_categories", "rating_variance", "asc"),
            ("highest_stddev_categories", "rating_stddev", "desc"),
            ("most_consistent_categories", "rating_stddev", "asc"),
            ("highest_coefficient_variation", "coefficient_of_variation", "desc"),
        )
    ),
    "variability_summary": _TABLE + """
select round(avg(rating_variance), 6) as mean_variance, round(avg(rating_stddev), 6) as mean_stddev,
  min(rating_variance) as min_variance, max(rating_variance) as max_variance from cats""",
    "performance_summary": _TABLE + """
select (select count(*) from amazon_products) as total_products, count(*) as categories_analyzed,
  count(*) filter (where significance_level = 'Significant') as significant_categories,
  round(avg(product_count), 1) as average_products_per_category,
  max(product_count) as largest_category_size, min(product_count) as smallest_category_size from cats""",
    "performance_extremes": _EXTREMES + """
select 'top' as block, cast(nr as int) as position, category, avg_rating, product_count from ranked where nr <= 3
union all
select 'bottom', cast(row_number() over (order by nr) as int), category, avg_rating, product_count from ranked where back <= 3""",
    "analysis_summary": _EXTREMES + """
select 'highest_rated' as role, category, avg_rating, product_count, rating_stddev, rating_variance from ranked where best_avg = 1
union all select 'lowest_rated', category, avg_rating, product_count, rating_stddev, rating_variance from ranked where worst_avg = 1
union all select 'highest_variability', category, avg_rating, product_count, rating_stddev, rating_variance from ranked where most_sd = 1
union all select 'lowest_variability', category, avg_rating, product_count, rating_stddev, rating_variance from ranked where least_sd = 1""",
    "key_findings": _EXTREMES + " select cast(position as int) as position, finding from finding_rows",
    "recommendations": _EXTREMES + " select cast(position as int) as position, recommendation from advice_rows",
    "analysis_metadata": _TABLE + " select (select count(*) from amazon_products) as dataset_size, count(*) as categories_analyzed from cats",
    "quick_summary": _EXTREMES + """
select n.c as dataset_scale, r.n_cats as categories_count, 0 as analysis_duration, r.category as top_category,
  r.avg_rating as top_category_rating, 3 as key_insights_count,
  concat('Analyzing ', format('{:,}', n.c), ' products across ', r.n_cats, ' categories') as insight_1,
  concat('Overall average rating: ', format('{:.2f}', o.overall_average_rating)) as insight_2,
  concat('High-rated products: ', format('{:.1f}', o.high_rated_percentage), '%') as insight_3
from ranked r cross join overall o cross join (select count(*) as c from amazon_products) n where r.nr = 1""",
    "validate_dataset": ctes("amazon_products") + """,
v as (select count(*) as dataset_size, count(distinct coalesce(category, 'Unknown')) as unique_categories,
  count(*) filter (where rating > 0) as valid_ratings, cast(min(rating) as double) as min_rating,
  cast(max(rating) as double) as max_rating, count(*) filter (where category is null or category = '') as missing_categories,
  count(distinct title) as unique_products,
  round(count(*) filter (where rating > 0) * 100.0e0 / count(*), 2) as rating_completeness from amazon_products)
select *, concat_ws('; ',
  case when rating_completeness < 70 then 'Low rating completeness - consider data cleaning' end,
  case when unique_categories < 5 then 'Limited category diversity - verify category mapping' end,
  case when dataset_size < 100000 then 'Small dataset size - statistical significance may be limited' end) as recommendations from v""",
    "dataset_info": ctes("amazon_products") + """
select count(*) as total_products, count(distinct category) as unique_categories,
  count(*) filter (where rating > 0) as products_with_ratings, cast(min(rating) as double) as min,
  cast(max(rating) as double) as max, round(avg(rating), 2) as average,
  round(count(*) filter (where rating > 0) * 100.0e0 / count(*), 1) as rating_completeness from amazon_products""",
    "top_categories": ctes("amazon_products") + """
select category, count(*) as product_count from amazon_products where category is not null
group by category order by product_count desc, category limit 10""",
    "market_share": ctes("amazon_products") + """
select category, count(*) as product_count,
  round(count(*) * 100.0e0 / (select count(*) from amazon_products), 2) as market_share
from amazon_products group by category""",
    "price_stats": ctes("amazon_products") + """
select category, count(*) as product_count, round(avg(discounted_price), 2) as avg_price,
  round(median(cast(discounted_price as double)), 3) as median_price, round(stddev_pop(cast(discounted_price as double)), 2) as price_stddev,
  cast(min(discounted_price) as double) as min_price, cast(max(discounted_price) as double) as max_price,
  cast(max(discounted_price) - min(discounted_price) as double) as price_range
from amazon_products where discounted_price is not null group by category""",
    "premium_categories": _TABLE + """
select category, product_count, avg_rating, high_rating_percentage from cats where high_rating_percentage > 50""",
    "custom_sql": ctes("amazon_products") + """
select about_product, count(*) as products, cast(max(actual_price) as double) as top_price
from amazon_products where rating_count > 10 group by about_product""",
    "executive_summary": _EXTREMES + """,
parts as (
  select 0 as k, 0 as i, unnest(['PRODUCT CATALOGUE - LARGE-SCALE ANALYSIS EXECUTIVE SUMMARY', repeat('=', 70), '',
      'Analysis Date: 2024-01-31', concat('Dataset Size: ', format('{:,}', c), ' products'), 'Analysis Duration: 0.0 seconds',
      concat('Categories Analyzed: ', (select count(*) from cats)), '', 'KEY FINDINGS', repeat('-', 20)]) as t,
      unnest(range(10)) as j from (select count(*) as c from amazon_products)
  union all select 1, position, concat(position, '. ', finding), 0 from finding_rows
  union all select 2, 0, unnest(['', 'TOP PERFORMING CATEGORIES', repeat('-', 25)]), unnest(range(3))
  union all select 3, nr, concat('• ', category, ': ', format('{:.2f}', avg_rating), ' avg rating (', format('{:,}', product_count), ' products)'), 0 from ranked where nr <= 3
  union all select 4, 0, unnest(['', 'SCALABILITY PERFORMANCE', repeat('-', 22),
      concat('Query Performance: 0.00s for ', format('{:,}', c), ' rows'), 'Memory Efficiency: Optimized for large datasets',
      'Indexing Strategy: Rating histogram per category']), unnest(range(6)) from (select count(*) as c from amazon_products))
select row_number() over (order by k, i, j) as line_no, t as text from parts""",
    "category_report": _EXTREMES + """,
head as (
  select 0 as k, unnest(range(6)) as i, unnest([repeat('=', 60), 'PRODUCT CATALOGUE - CATEGORY ANALYSIS REPORT', repeat('=', 60), '', 'Analysis Date: 2024-01-31', '']) as t
  union all select 1, unnest(range(5)), unnest(['EXECUTIVE SUMMARY', repeat('-', 20), concat('Total Categories Analyzed: ', (select count(*) from cats)),
    concat('Overall Average Rating: ', format('{:.3f}', overall_average_rating)), '']) from overall
  union all select 2, unnest(range(5)), unnest(['TOP PERFORMING CATEGORY', concat('Category: ', category), concat('Average Rating: ', format('{:.3f}', avg_rating)),
    concat('Product Count: ', format('{:,}', product_count)), '']) from ranked where best_avg = 1
  union all select 3, unnest(range(5)), unnest(['LOWEST PERFORMING CATEGORY', concat('Category: ', category), concat('Average Rating: ', format('{:.3f}', avg_rating)),
    concat('Product Count: ', format('{:,}', product_count)), '']) from ranked where worst_avg = 1
  union all select 4, unnest(range(2)), unnest(['RATING VARIABILITY', repeat('-', 20)])
  union all select 5, 0, concat('Most Variable: ', category, ' (σ=', format('{:.3f}', rating_stddev), ')') from ranked where most_sd = 1
  union all select 5, 1, concat('Most Consistent: ', category, ' (σ=', format('{:.3f}', rating_stddev), ')') from ranked where least_sd = 1
  union all select 5, 2, ''
  union all select 6, unnest(range(2)), unnest(['KEY RECOMMENDATIONS', repeat('-', 20)]) where exists (select 1 from advice_rows)
  union all select 6, 1 + position, concat(position, '. ', recommendation) from advice_rows
  union all select 6, 99, '' where exists (select 1 from advice_rows)
  union all select 7, unnest(range(6)), unnest(['STATISTICAL ANALYSIS', repeat('-', 20), concat('Total Products: ', format('{:,}', total_products)),
    concat('Overall Standard Deviation: ', format('{:.3f}', overall_stddev)), '', 'Z-Score Analysis (Categories vs. Overall Mean):']) from overall
  union all select 8, far, concat('  ', category, ': z=', format('{:.2f}', z_score), ' (', level, ')') from zs where far <= 5
  union all select 9, unnest(range(6)), unnest(['', repeat('=', 60), 'DETAILED CATEGORY STATISTICS', repeat('=', 60),
    'Category             Count    Avg    StdDev   Min    Max    High%   ', repeat('-', 70)]))
select 0 as section, row_number() over (order by k, i) - 1 as line, t as text from head
union all
select 1, row_number() over (order by avg_rating desc, mean desc, product_count desc, category),
  concat(format('{:<20} ', category), format('{:<8} ', format('{:,}', product_count)), format('{:<6.2f} ', avg_rating),
    format('{:<8.3f} ', rating_stddev), format('{:<6.1f} ', min_rating), format('{:<6.1f} ', max_rating), format('{:<8.1f}', high_rating_percentage)) from cats
union all
select 2, unnest(range(4)), unnest(['', repeat('=', 60), 'End of Report', repeat('=', 60)])""",
}
# the same statistics over the store's products, with the category taken from the title
_IMPORTED = ctes("products") + """,
amazon_products as (select case when regexp_matches(title, '(?i)cpu|processor') then 'CPU'
    when regexp_matches(title, '(?i)gpu|graphics') then 'GPU' when regexp_matches(title, '(?i)motherboard|mobo') then 'Motherboard'
    when regexp_matches(title, '(?i)memory|ram') then 'Memory' when regexp_matches(title, '(?i)storage|ssd|hdd') then 'Storage'
    else 'Other' end as category, try_cast(rating as decimal(3,2)) as rating from products)"""
ORACLES["imported_category_stats"] = ORACLES["category_stats"].replace(ctes("amazon_products"), _IMPORTED)
ORACLES["stream_category_stats"] = ORACLES["category_stats"]
