"""Alert matching in batch."""

from pyspark.sql import functions as F

from checks.registry import query
from kerbside.operators import alerts as A
from kerbside.sources import driver_tables as D


def filters(spark, sf):
    """Two filters per customer: one by make and price, one by city, discount and score; a few match anything."""
    c = D.table(spark, sf, "customer")
    key = F.col("c_custkey")
    by_make = c.select(
        key.alias("user_id"),
        F.when(key % 10 != 0, F.concat(F.lit("BRAND#"), F.col("c_nationkey").cast("string"))).alias("brand"),
        F.when(key % 3 == 0, "economy").otherwise(F.when(key % 3 == 1, "").otherwise(F.lit(None))).alias("model"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 100).alias("max_price"),
        F.when(key % 4 == 0, F.lit(10.0)).alias("min_discount"),
        F.lit(None).cast("string").alias("city"),
        (F.lit(2008) + key % 12).cast("int").alias("min_year"),
        F.lit(None).cast("double").alias("min_deal_score"),
    )
    by_city = c.select(
        key.alias("user_id"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("model"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.lit(900_000.0)).alias("max_price"), F.lit(25.0).alias("min_discount"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("city"), F.lit(None).cast("int").alias("min_year"),
        F.lit(75.0).alias("min_deal_score"),
    )
    return by_make.unionByName(by_city)


FILTERS = """(SELECT c_custkey AS user_id, CASE WHEN c_custkey % 10 <> 0 THEN 'BRAND#' || CAST(c_nationkey AS VARCHAR) END AS brand,
    CASE c_custkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN '' END AS model, greatest(c_acctbal, 0.0) * 100 AS max_price,
    CASE WHEN c_custkey % 4 = 0 THEN 10.0 END AS min_discount, CAST(NULL AS VARCHAR) AS city, 2008 + c_custkey % 12 AS min_year,
    CAST(NULL AS DOUBLE) AS min_deal_score FROM customer
  UNION ALL SELECT c_custkey, NULL, NULL, CASE WHEN c_custkey % 5 <> 0 THEN 900000.0 END, 25.0,
    'nation_' || CAST(c_nationkey AS VARCHAR), NULL, 75.0 FROM customer)"""
MATCHED = f"""(SELECT DISTINCT f.user_id, s.listing_id, s.url, s.brand, s.price, s.source, s.created_at FROM scored s, {FILTERS} f
  WHERE NOT s.is_duplicate AND (coalesce(f.brand, '') = '' OR lower(f.brand) = lower(s.brand)) AND (coalesce(f.model, '') = '' OR lower(f.model) = lower(s.model))
  AND (f.max_price IS NULL OR s.price <= f.max_price) AND (f.min_discount IS NULL OR coalesce(s.price_diff_pct, 0) >= f.min_discount)
  AND (coalesce(f.city, '') = '' OR coalesce(s.city, '') = '' OR contains(lower(s.city), lower(f.city)))
  AND (f.min_year IS NULL OR s.year >= f.min_year) AND (f.min_deal_score IS NULL OR s.deal_score >= f.min_deal_score))"""
MUTED = "(SELECT DISTINCT c_custkey AS user_id, 'brand#' || CAST(c_custkey % 25 AS VARCHAR) AS brand FROM customer WHERE c_custkey % 2 = 0)"
# every listing went to one user
SENT = "(SELECT c_custkey AS user_id, url FROM customer JOIN scored ON listing_id % (SELECT count(*) FROM customer) + 1 = c_custkey)"


NEW_SINCE = "2001-07-01 00:00:00"


def offered(spark, sf):
    """All listings that are no duplicates, with what a filter or an alert looks at."""
    kept = ["listing_id", "url", "brand", "model", "year", "price", "city", "price_diff_pct", "deal_score", "created_at"]
    return D.scored(spark, sf).filter(~F.col("is_duplicate")).select(*kept)


def muted(spark, sf):
    c = D.table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0)
    return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("brand#"), (F.col("c_custkey") % 25).cast("string")).alias("brand"))


def sent(spark, sf):
    customers = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    many = customers.agg(F.count("*")).scalar()
    return D.scored(spark, sf).select((F.col("listing_id") % many + 1).alias("user_id"), "url").join(customers, "user_id")


@query("filter_match_join", "scored", f"SELECT user_id, listing_id, price FROM {MATCHED} m")
def _(spark, sf):
    return A.filter_match_join(offered(spark, sf), filters(spark, sf)).select("user_id", "listing_id", "price")


@query(
    "join_muted_anti",
    "scored",
    f"SELECT user_id, listing_id FROM {MATCHED} m WHERE NOT EXISTS (SELECT 1 FROM {MUTED} x WHERE x.user_id = m.user_id AND x.brand = lower(m.brand))",
)
def _(spark, sf):
    matched = A.filter_match_join(offered(spark, sf), filters(spark, sf))
    return A.without_muted(matched, muted(spark, sf)).select("user_id", "listing_id")


@query(
    "join_sent_anti",
    "scored",
    f"SELECT user_id, listing_id FROM {MATCHED} m WHERE NOT EXISTS (SELECT 1 FROM {SENT} x WHERE x.user_id = m.user_id AND x.url = m.url)",
)
def _(spark, sf):
    return A.unsent_matches(offered(spark, sf), filters(spark, sf), sent(spark, sf)).select("user_id", "listing_id")


ALERTS = f"""SELECT user_id, listing_id, url, price FROM {MATCHED} m WHERE user_id % 7 <> 0
  AND created_at >= TIMESTAMP '2001-07-01 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM {MUTED} x WHERE x.user_id = m.user_id AND x.brand = lower(m.brand))
  AND NOT EXISTS (SELECT 1 FROM {SENT} x WHERE x.user_id = m.user_id AND x.url = m.url)"""


def users(spark, sf):
    return D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7 != 0).alias("is_active")
    )


@query("alerts", "scored", ALERTS)
def _(spark, sf):
    fresh = offered(spark, sf).filter(F.col("created_at") >= F.to_timestamp(F.lit(NEW_SINCE)))
    out = A.alerts(fresh, filters(spark, sf), muted(spark, sf), sent(spark, sf), users(spark, sf), offered(spark, sf))
    return out.select("user_id", "listing_id", "url", "price")


@query(
    "user_alert_stats",
    "scored",
    f"""
SELECT coalesce(f.user_id, s.user_id) AS user_id, coalesce(f.n, 0) AS filters, coalesce(s.n, 0) AS alerts
FROM (SELECT user_id, count(*) AS n FROM {FILTERS} x GROUP BY user_id) f
FULL JOIN (SELECT user_id, count(*) AS n FROM {SENT} y GROUP BY user_id) s ON f.user_id = s.user_id
""",
)
def _(spark, sf):
    return A.user_alert_stats(filters(spark, sf), sent(spark, sf))
