"""Search, deals, price drops, joins with analysis."""

import uuid

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import AS_OF
from kerbside.common import shared_folder
from kerbside.functions import labels as L
from kerbside.plans import search as S
from kerbside.sources import driver_tables as D
from kerbside.sources import writers as W

# the fixture's listings are years old, so "fresh" means 200 days here
FRESH_HOURS = 24 * 400
YOUNG = f"date_diff('second', created_at, {AS_OF}) <= 3600 * {FRESH_HOURS}"


_pages: dict = {}


def laid_out(spark, sf, **asked):
    """A browse list in page order, written once per session, as for many readers."""
    key = (spark.sparkContext.applicationId, sf, str(sorted(asked.items())))
    if key not in _pages:
        _pages[key] = S.lay_out_pages(D.scored(spark, sf), f"{shared_folder(spark)}/pages/{uuid.uuid4().hex}", **asked)
    return _pages[key]


def flagship(spark, sf):
    return S.top_deals(D.scored(spark, sf), D.as_of(), limit=20, min_score=70, max_age_hours=FRESH_HOURS)


@query(
    "top_deals",
    "scored",
    f"""
SELECT listing_id, brand, model, year, price, market_price, coalesce(price_diff_pct, 0.0) AS diff_pct, deal_score, city,
  mileage, url, source, category FROM scored
WHERE NOT is_duplicate AND deal_score >= 70 AND price > 100000 AND {YOUNG}
ORDER BY deal_score DESC NULLS LAST, price_diff_pct DESC NULLS LAST, listing_id LIMIT 20
""",
)
def _(spark, sf):
    return flagship(spark, sf)


LAST_POINT = "(SELECT listing_id, price AS old_price FROM history_points WHERE pos = n)"
DROPPED = f"""(SELECT s.*, h.old_price, {rounded("(h.old_price - s.price) / h.old_price * 100", 2)} AS drop_pct
  FROM scored s JOIN {LAST_POINT} h USING (listing_id) WHERE NOT is_duplicate AND h.old_price > 0 AND s.price < h.old_price)"""


@query(
    "hot_deals",
    "scored history_points",
    f"""
SELECT listing_id, brand, model, year, price, market_price, price_diff_pct AS diff_pct, city, url, source, category,
  attractiveness, coalesce(old_price > 0 AND price < old_price, false) AS price_dropped,
  CASE WHEN old_price > 0 AND price < old_price THEN {rounded("(old_price - price) / old_price * 100", 2)} ELSE 0.0::DOUBLE END
    AS price_drop_pct
FROM scored LEFT JOIN {LAST_POINT} h USING (listing_id)
WHERE NOT is_duplicate AND price_diff_pct >= 15 AND market_price IS NOT NULL AND category = 'clean' AND {YOUNG}
ORDER BY price_diff_pct DESC NULLS LAST, listing_id LIMIT 50
""",
)
def _(spark, sf):
    return S.hot_deals(D.scored_with_history(spark, sf), D.as_of(), max_age_hours=FRESH_HOURS)


@query(
    "price_drops",
    "scored history_points",
    f"""
SELECT listing_id, brand, model, year, price, market_price, coalesce(price_diff_pct, 0.0) AS diff_pct, city, url, source,
  category, drop_pct AS price_drop_pct FROM {DROPPED} t WHERE drop_pct >= 1
ORDER BY drop_pct DESC, listing_id LIMIT 50
""",
)
def _(spark, sf):
    return S.price_drops(D.scored_with_history(spark, sf))


@query(
    "price_drops_city",
    "scored history_points",
    f"""
SELECT listing_id, brand, model, year, price, market_price, coalesce(price_diff_pct, 0.0) AS diff_pct, city, url, source,
  category, drop_pct AS price_drop_pct FROM {DROPPED} t WHERE drop_pct >= 5 AND contains(lower(city), 'nation_1')
ORDER BY drop_pct DESC, listing_id LIMIT 100
""",
)
def _(spark, sf):
    return S.price_drops(D.scored_with_history(spark, sf), min_drop_pct=5, limit=100, city="Nation_1")


@query(
    "recent_price_drops",
    "scored history_points",
    f"""
SELECT listing_id, brand, model, price, old_price, drop_pct, url FROM {DROPPED} t
ORDER BY updated_at DESC NULLS LAST, listing_id LIMIT 5
""",
)
def _(spark, sf):
    return S.recent_price_drops(D.scored_with_history(spark, sf))


@query(
    "fresh_listings",
    "marked",
    f"""
SELECT listing_id, brand, model, year, price, source, {rounded(f"date_diff('microsecond', created_at, {AS_OF}) / 6e7", 1)}
  AS age_minutes FROM marked WHERE NOT is_duplicate ORDER BY created_at DESC NULLS LAST, listing_id LIMIT 5
""",
)
def _(spark, sf):
    return S.fresh_listings(D.scored(spark, sf), D.as_of())


@query(
    "search_listings",
    "scored",
    """
SELECT listing_id, brand, model, year, price, market_price, nullif(price_diff_pct, 0.0) AS diff_pct, deal_score, mileage,
  city, source, url, body_type, owners_count FROM scored
WHERE NOT is_duplicate AND price > 0 AND lower(brand) = 'brand#3' AND lower(model) = 'economy' AND year BETWEEN 2010 AND 2022
  AND price BETWEEN 200000 AND 2000000 AND price_diff_pct >= 5 AND source = 'src_b' AND contains(lower(city), 'nation')
  AND deal_score >= 30
ORDER BY deal_score DESC NULLS LAST, created_at DESC NULLS LAST, listing_id LIMIT 50
""",
)
def _(spark, sf):
    return S.search_listings(
        D.scored(spark, sf), brand="BRAND#3", model="Economy", year_from=2010, year_to=2022, price_from=200_000,
        price_to=2_000_000, min_discount=5.0, source="SRC_B", city="Nation", min_score=30, limit=80,
    )


@query(
    "sort_nulls_last",
    "scored",
    """
SELECT listing_id, brand, model, year, price, market_price, nullif(price_diff_pct, 0.0) AS diff_pct, deal_score, mileage,
  city, source, url, body_type, owners_count FROM scored WHERE NOT is_duplicate AND price > 0
ORDER BY deal_score DESC NULLS LAST, created_at DESC NULLS LAST, listing_id LIMIT 20
""",
)
def _(spark, sf):
    return S.search_listings(D.scored(spark, sf))


BROWSE_COLUMNS = """listing_id, brand, model, year, price, market_price, price_diff_pct, category, confidence, deal_score,
  created_at"""


@query(
    "browse_listings",
    "scored",
    f"""
WITH kept AS (SELECT * FROM scored WHERE contains(lower(brand), 'brand#') AND contains(lower(model), 'o') AND year >= 2008
  AND price BETWEEN 100000 AND 2400000 AND price_diff_pct BETWEEN -40 AND 45 AND category = 'clean' AND source = 'src_a'
  AND contains(lower(city), 'nation') AND deal_score >= 10 AND NOT is_duplicate)
SELECT {BROWSE_COLUMNS}, (SELECT count(*) FROM kept) AS total,
  CAST(greatest(ceil((SELECT count(*) FROM kept) / 25), 1) AS BIGINT) AS total_pages
FROM kept ORDER BY deal_score DESC NULLS LAST, listing_id LIMIT 25 OFFSET 50
""",
)
def _(spark, sf):
    asked = dict(
        brand="Brand#", model="o", year_from=2008, price_from=100_000, price_to=2_400_000, diff_from=-40.0, diff_to=45.0,
        category="clean", source="src_a", city="NATION", min_deal_score=10.0,
    )
    return laid_out(spark, sf, sort_by="deal_score", **asked).page(spark, 3)


@query(
    "offset_page",
    "scored",
    f"""
WITH kept AS (SELECT * FROM scored WHERE NOT is_duplicate)
SELECT {BROWSE_COLUMNS}, (SELECT count(*) FROM kept) AS total,
  CAST(greatest(ceil((SELECT count(*) FROM kept) / 25), 1) AS BIGINT) AS total_pages
FROM kept ORDER BY category ASC NULLS LAST, listing_id LIMIT 25 OFFSET 25
""",
)
def _(spark, sf):
    return laid_out(spark, sf, sort_by="category", descending=False).page(spark, 2)


@query(
    "top_n",
    "scored",
    f"""
WITH kept AS (SELECT * FROM scored)
SELECT {BROWSE_COLUMNS}, (SELECT count(*) FROM kept) AS total,
  CAST(greatest(ceil((SELECT count(*) FROM kept) / 25), 1) AS BIGINT) AS total_pages
FROM kept ORDER BY price_diff_pct DESC NULLS LAST, listing_id LIMIT 25
""",
)
def _(spark, sf):
    return S.browse_listings(D.scored(spark, sf), hide_duplicates=False)


@query(
    "listing_detail",
    "scored",
    """
WITH asked AS (SELECT min(canonical_id) AS id FROM scored WHERE is_duplicate)
SELECT a.id AS asked_id, CASE WHEN s.listing_id = a.id THEN 'self' ELSE 'duplicate' END AS role, s.listing_id, s.brand, s.price,
  s.category, s.deal_score
FROM scored s, asked a WHERE coalesce(s.canonical_id, s.listing_id) = a.id
""",
)
def _(spark, sf):
    scored = D.scored(spark, sf)
    wanted = scored.filter("is_duplicate").agg(F.min("canonical_id").alias("listing_id"))
    return S.listing_detail(scored, wanted, ["brand", "price", "category", "deal_score"])


@query(
    "join_analysis_left",
    "scored analysis",
    """
SELECT s.source, coalesce(a.category, 'none') AS category, count(*) AS n FROM scored s LEFT JOIN analysis a USING (listing_id)
GROUP BY 1, 2
""",
)
def _(spark, sf):
    joined = D.listings(spark, sf).join(D.analysis(spark, sf), "listing_id", "left")
    return joined.groupBy("source", F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@query(
    "join_analysis_inner",
    "scored analysis",
    f"""
SELECT s.listing_id, s.price, a.category, a.confidence FROM scored s JOIN analysis a USING (listing_id)
WHERE a.confidence >= 0.5 AND NOT s.is_duplicate AND {YOUNG}
""",
)
def _(spark, sf):
    analysis = D.analysis(spark, sf).filter(F.col("confidence") >= 0.5)
    kept = D.marked(spark, sf).filter(~F.col("is_duplicate") & S.younger_than(D.as_of(), FRESH_HOURS))
    return kept.join(analysis, "listing_id").select("listing_id", "price", "category", "confidence")


@query(
    "export_deals_csv",
    "scored",
    """
SELECT brand, model, year, price, market_price, nullif(price_diff_pct, 0.0) AS "diff_%", nullif(deal_score, 0) AS deal_score,
  nullif(mileage, 0) AS mileage, body_type, nullif(owners_count, 0) AS owners, city, source, url
FROM scored WHERE NOT is_duplicate AND price > 0 AND deal_score >= 60 ORDER BY deal_score DESC NULLS LAST, listing_id LIMIT 500
""",
)
def _(spark, sf):
    import uuid

    from kerbside.common import shared_folder

    path = f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    W.export_deals_csv(D.scored(spark, sf), path)
    # read the file back: what was exported is the result
    return spark.read.option("header", True).schema(W.deals_export(D.scored(spark, sf)).schema).csv(path)


# ------------------------------------------------------------------ labels and bands
@query(
    "listing_age_label",
    "listings",
    """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN h < 1 THEN '< 1ч' WHEN h < 24 THEN '< 24ч' ELSE '> 24ч' END AS label
  FROM (SELECT date_diff('second', created_at, (SELECT max(created_at) FROM listings)) / 3600 AS h FROM listings) t) t
GROUP BY label
""",
)
def _(spark, sf):
    listings = D.listings(spark, sf)
    newest = listings.agg(F.max("created_at")).scalar()
    return listings.groupBy(L.listing_age_label(F.col("created_at"), newest).alias("label")).agg(F.count("*").alias("n"))


@query(
    "age_minutes",
    "listings",
    f"SELECT listing_id, {rounded(f'''date_diff('microsecond', created_at, {AS_OF}) / 6e7''', 1)} AS age_minutes FROM listings",
)
def _(spark, sf):
    return D.listings(spark, sf).select("listing_id", L.age_minutes(F.col("created_at"), D.as_of()).alias("age_minutes"))


@query(
    "price_diff_amount_and_band",
    "scored",
    """
SELECT listing_id, price - market_price AS diff_amount, CASE WHEN price_diff_pct > 15 THEN 'hot' WHEN price_diff_pct > 5 THEN 'good'
  WHEN price_diff_pct > 0 THEN 'ok' WHEN price_diff_pct > -10 THEN 'neutral' WHEN price_diff_pct IS NOT NULL THEN 'bad' END AS band,
  CASE WHEN price_diff_pct IS NOT NULL
    THEN CAST(floor((greatest(least(price_diff_pct, 30.0), -30.0) + 30) / 60 * 100) AS INTEGER) END AS bar
FROM scored
""",
)
def _(spark, sf):
    diff = F.col("price_diff_pct")
    return D.scored(spark, sf).select(
        "listing_id", (F.col("price") - F.col("market_price")).alias("diff_amount"), L.diff_band(diff).alias("band"),
        L.diff_bar_width(diff).alias("bar"),
    )


@query(
    "row_band",
    "scored",
    """
SELECT band, count(*) AS n FROM (SELECT CASE WHEN price_diff_pct > 15 THEN 'hot' WHEN price_diff_pct > 5 THEN 'good'
  WHEN category IN ('damaged_body', 'bad_docs', 'debtor') THEN 'bad' WHEN category = 'complex_but_profitable' THEN 'complex'
  ELSE '' END AS band FROM scored) t GROUP BY band
""",
)
def _(spark, sf):
    band = L.row_band(F.col("price_diff_pct"), F.col("category"))
    return D.scored(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "score_band",
    "scored",
    """
SELECT deal_band, attractiveness_band, alert_band, count(*) AS n FROM (SELECT
  CASE WHEN deal_score >= 80 THEN 'hot' WHEN deal_score >= 60 THEN 'good' WHEN deal_score >= 40 THEN 'mid'
    WHEN deal_score IS NOT NULL THEN 'low' END AS deal_band,
  CASE WHEN attractiveness >= 7 THEN 'hot' WHEN attractiveness >= 5 THEN 'good' WHEN attractiveness >= 3 THEN 'mid'
    WHEN attractiveness IS NOT NULL THEN 'low' END AS attractiveness_band,
  CASE WHEN deal_score >= 80 THEN 'star' WHEN deal_score >= 60 THEN 'thumb' WHEN deal_score IS NOT NULL THEN 'chart' END
    AS alert_band FROM scored) t GROUP BY ALL
""",
)
def _(spark, sf):
    return (
        D.scored(spark, sf)
        .groupBy(
            L.score_band(F.col("deal_score"), (80, 60, 40)).alias("deal_band"),
            L.score_band(F.col("attractiveness"), (7, 5, 3)).alias("attractiveness_band"),
            L.alert_score_band(F.col("deal_score")).alias("alert_band"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "category_label",
    "analysis",
    """
SELECT CASE category WHEN 'clean' THEN 'Чистая' WHEN 'damaged_body' THEN 'Битая' WHEN 'debtor' THEN 'Должник'
  WHEN 'complex_but_profitable' THEN 'Сложная, но выгодная' END AS label, count(*) AS n FROM analysis GROUP BY 1
""",
)
def _(spark, sf):
    return D.analysis(spark, sf).groupBy(L.category_label(F.col("category")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "price_history_steps",
    "history_points",
    """
SELECT listing_id, CAST(pos - 1 AS INTEGER) AS pos, price, price - nxt AS change,
  CASE WHEN price < nxt THEN 'down' WHEN price > nxt THEN 'up' ELSE 'same' END AS direction
FROM (SELECT *, lead(price) OVER (PARTITION BY listing_id ORDER BY pos) AS nxt FROM history_points) t WHERE nxt IS NOT NULL
""",
)
def _(spark, sf):
    steps = D.price_history(spark, sf).select("listing_id", F.posexplode(L.price_steps(F.col("price_history"))).alias("pos", "s"))
    return steps.select("listing_id", "pos", "s.price", "s.change", "s.direction")
