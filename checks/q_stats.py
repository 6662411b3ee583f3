"""Aggregates."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import AS_OF
from kerbside.plans import stats as S
from kerbside.sources import driver_tables as D


def pct(part, whole, digits=1):
    return rounded(f"{part} / {whole} * 100", digits)


@query(
    "overview_stats",
    "scored analysis",
    f"""
SELECT count(*) AS total_listings, count(*) FILTER (WHERE NOT is_duplicate) AS unique_listings,
  count(*) FILTER (WHERE is_duplicate) AS duplicates,
  count(*) FILTER (WHERE NOT is_duplicate AND deal_score >= 70) AS hot_deals_count, {rounded("avg(price)", 0)} AS avg_price,
  {rounded("avg(price_diff_pct)", 2)} AS avg_discount, (SELECT count(*) FROM analysis) AS analyzed_count,
  {pct("(SELECT count(*) FROM analysis)", "count(*) FILTER (WHERE NOT is_duplicate)")} AS analyzed_pct
FROM scored
""",
)
def _(spark, sf):
    return S.overview_stats(D.scored(spark, sf), D.analysis(spark, sf))


@query(
    "dashboard_stats",
    "scored",
    f"""
SELECT count(*) AS total, count(*) FILTER (WHERE price_diff_pct > 0) AS below_market,
  count(*) FILTER (WHERE price_diff_pct > 15) AS hot_deals, {rounded("avg(price_diff_pct)", 4)} AS avg_diff,
  {rounded("avg(price)", 4)} AS avg_price FROM scored WHERE NOT is_duplicate
""",
)
def _(spark, sf):
    return S.dashboard_stats(D.scored(spark, sf))


@query(
    "coverage_stats",
    "scored analysis",
    f"""
SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_duplicate) AS total_unique,
  count(*) FILTER (WHERE is_duplicate) AS total_dupes, count(market_price) AS total_priced,
  count(*) FILTER (WHERE price_diff_pct > 15 AND NOT is_duplicate) AS hot_deals,
  (SELECT count(*) FROM analysis) AS total_analyzed, {pct("count(market_price)", "count(*)")} AS priced_pct,
  {pct("(SELECT count(*) FROM analysis)", "count(*) FILTER (WHERE NOT is_duplicate)")} AS analyzed_pct FROM scored
""",
)
def _(spark, sf):
    return S.coverage_stats(D.scored(spark, sf), D.analysis(spark, sf))


@query("count_by_source", "marked", "SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT is_duplicate) AS unique FROM marked GROUP BY source".replace("AS unique", 'AS "unique"'))
def _(spark, sf):
    return S.count_by_source(D.scored(spark, sf))


@query("count_by_source_unique", "marked", "SELECT source, count(*) AS n FROM marked WHERE NOT is_duplicate GROUP BY source")
def _(spark, sf):
    return S.count_by_source(D.scored(spark, sf)).select("source", F.col("unique").alias("n"))


@query(
    "count_by_category",
    "analysis",
    f"""
SELECT category, count(*) AS count, {rounded("count(*) * 100 / (SELECT count(*) FROM analysis)", 1)} AS share_pct
FROM analysis GROUP BY category
""",
)
def _(spark, sf):
    return S.count_by_category(D.analysis(spark, sf))


@query(
    "top_brands",
    "listings",
    f"SELECT brand, count(*) AS count, {rounded('avg(price)', 0)} AS avg_price FROM listings GROUP BY brand ORDER BY count DESC, brand LIMIT 10",
)
def _(spark, sf):
    return S.top_brands(D.listings(spark, sf))


@query(
    "top_cities",
    "listings",
    f"""SELECT city, count(*) AS count, {rounded('avg(price)', 0)} AS avg_price FROM listings WHERE city IS NOT NULL
GROUP BY city ORDER BY count DESC, city LIMIT 10""",
)
def _(spark, sf):
    return S.top_cities(D.listings(spark, sf))


@query("brand_counts", "marked", "SELECT brand, count(*) AS count FROM marked WHERE NOT is_duplicate GROUP BY brand")
def _(spark, sf):
    return S.brand_counts(D.scored(spark, sf))


@query(
    "city_counts_having",
    "marked",
    "SELECT city, count(*) AS count FROM marked WHERE NOT is_duplicate AND city IS NOT NULL GROUP BY city HAVING count(*) >= 10",
)
def _(spark, sf):
    return S.city_counts_having(D.scored(spark, sf))


@query(
    "model_counts",
    "marked",
    "SELECT model, count(*) AS count FROM marked WHERE NOT is_duplicate AND lower(brand) = 'brand#7' GROUP BY model",
)
def _(spark, sf):
    return S.model_counts(D.scored(spark, sf), "BRAND#7")


@query("distinct_brands", "listings", "SELECT DISTINCT brand FROM listings ORDER BY brand")
def _(spark, sf):
    return S.distinct_values(D.listings(spark, sf), "brand")


@query("distinct_cities", "listings", "SELECT DISTINCT city FROM listings WHERE city IS NOT NULL ORDER BY city")
def _(spark, sf):
    return S.distinct_values(D.listings(spark, sf), "city")


@query(
    "price_buckets",
    "marked",
    """
SELECT CAST(floor(price / 250000) * 250000 AS BIGINT) AS bucket_from, CAST(floor(price / 250000) * 250000 + 250000 AS BIGINT)
  AS bucket_to, count(*) AS count FROM marked WHERE NOT is_duplicate GROUP BY 1, 2
""",
)
def _(spark, sf):
    return S.price_buckets(D.scored(spark, sf))


@query(
    "brand_stats",
    "scored",
    f"""
SELECT brand, count(*) AS count, {rounded("avg(price)", 2)} AS avg_price, {rounded("round(avg(price_diff_pct), 9)", 2)} AS avg_discount
FROM scored WHERE NOT is_duplicate GROUP BY brand
""",
)
def _(spark, sf):
    return S.brand_stats(D.scored(spark, sf))


@query(
    "summary_stats",
    "scored",
    f"""
SELECT count(*) AS total_listings, count(*) FILTER (WHERE NOT is_duplicate) AS total_unique, {rounded("avg(price)", 2)} AS avg_price,
  {rounded("avg(mileage)", 2)} AS avg_mileage, {rounded("avg(price_diff_pct)", 2)} AS avg_discount,
  {rounded("avg(deal_score)", 2)} AS avg_score,
  count(*) FILTER (WHERE created_at >= date_trunc('day', {AS_OF})) AS listings_today,
  count(*) FILTER (WHERE created_at >= date_trunc('day', {AS_OF}) - INTERVAL 7 DAY) AS listings_this_week,
  quantile_cont(price, 0.5)::DOUBLE AS median_price FROM scored
""",
)
def _(spark, sf):
    return S.summary_stats(D.scored(spark, sf), D.as_of())
