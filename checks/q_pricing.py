"""Cleaning, encodings, prices, comparables and scores."""

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.views import AS_OF
from kerbside.common import fold_of
from kerbside.operators import clean as C
from kerbside.operators import comparables as K
from kerbside.operators import encode as E
from kerbside.operators import evaluate as V
from kerbside.operators import features as FE
from kerbside.operators import pricing as P
from kerbside.operators import scoring as SC
from kerbside.plans import pipeline
from kerbside.sources import driver_tables as D

RULES = C.CleaningRules(max_age_days=D.FIXTURE_MAX_AGE_DAYS)


def trainable(spark, sf):
    return pipeline.training_rows(D.marked(spark, sf), D.document_analysis(spark, sf), D.text_flags(spark, sf))


def fresh(spark, sf):
    return trainable(spark, sf).filter(C.fresh(F.col("created_at"), D.as_of(), D.FIXTURE_MAX_AGE_DAYS))


def train(spark, sf):
    """Cleaned training rows, written once like the other stage tables."""

    def build(spark, sf):
        return FE.training_bounds(C.clean_training_set(trainable(spark, sf), D.as_of(), RULES))

    return D.written_once(spark, sf, "train", build)


@query("clean_fresh_60d", "trainable fresh", "SELECT source, count(*) AS n FROM fresh GROUP BY source")
def _(spark, sf):
    return fresh(spark, sf).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "win_iqr_outliers",
    "fresh iqr_bounds",
    """
SELECT listing_id, coalesce(price < low OR price > high, false) AS iqr_outlier FROM fresh LEFT JOIN iqr_bounds
USING (brand, model)
""",
)
def _(spark, sf):
    return C.with_iqr_flag(fresh(spark, sf), RULES).select("listing_id", "iqr_outlier")


@query(
    "win_mad_outliers",
    "after_iqr mad_stats",
    """
SELECT listing_id, coalesce(abs(ln(price) - median_ln) / mad > 3.5, false) AS mad_outlier FROM after_iqr
LEFT JOIN mad_stats USING (brand, model)
""",
)
def _(spark, sf):
    kept = C.with_iqr_flag(fresh(spark, sf), RULES).filter(~F.col("iqr_outlier"))
    return C.with_mad_flag(kept, RULES).select("listing_id", "mad_outlier")


@query(
    "win_segment_median",
    "fresh",
    """
SELECT f.listing_id, m.median_price FROM fresh f JOIN (SELECT brand, model, quantile_cont(price, 0.5)::DOUBLE AS median_price
  FROM fresh GROUP BY brand, model) m USING (brand, model)
""",
)
def _(spark, sf):
    return C.with_segment_median(fresh(spark, sf)).select("listing_id", "median_price")


@query(
    "clean_mileage_per_year",
    "trainable",
    "SELECT listing_id FROM trainable WHERE NOT coalesce(mileage / greatest(2026 - year, 1) > 20000, false)",
)
def _(spark, sf):
    return trainable(spark, sf).filter(~C.bad_mileage(limit=20_000)).select("listing_id")


@query(
    "win_cross_source_price_sanity",
    "fresh",
    """
SELECT f.listing_id, f.price < m.median_price * 0.3 AS price_suspicious FROM fresh f JOIN
  (SELECT brand, model, quantile_cont(price, 0.5) AS median_price FROM fresh GROUP BY brand, model) m USING (brand, model)
""",
)
def _(spark, sf):
    return C.with_price_sanity_flag(fresh(spark, sf), RULES).select("listing_id", "price_suspicious")


@query("clean_training_set", "clean", "SELECT listing_id, brand, model, price FROM clean")
def _(spark, sf):
    return C.clean_training_set(trainable(spark, sf), D.as_of(), RULES).select("listing_id", "brand", "model", "price")


@query(
    "cleaning_report",
    "trainable fresh after_iqr after_mad after_mileage clean",
    """
SELECT (SELECT count(*) FROM trainable) AS total,
  (SELECT count(*) FROM trainable) - (SELECT count(*) FROM fresh) AS removed_stale,
  (SELECT count(*) FROM fresh) - (SELECT count(*) FROM after_iqr) AS removed_iqr_outlier,
  (SELECT count(*) FROM after_iqr) - (SELECT count(*) FROM after_mad) AS removed_mad_outlier,
  (SELECT count(*) FROM after_mad) - (SELECT count(*) FROM after_mileage) AS removed_bad_mileage,
  (SELECT count(*) FROM after_mileage) - (SELECT count(*) FROM clean) AS removed_price_suspicious,
  (SELECT count(*) FROM clean) AS kept
""",
)
def _(spark, sf):
    return C.cleaning_report(C.cleaning_reasons(trainable(spark, sf), D.as_of(), RULES))


@query(
    "training_bounds",
    "trainable",
    """
SELECT brand, count(*) AS n FROM trainable WHERE price BETWEEN 50000 AND 20000000 AND year BETWEEN 1990 AND 2027 GROUP BY brand
""",
)
def _(spark, sf):
    return FE.training_bounds(trainable(spark, sf)).groupBy("brand").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ features
@query(
    "fill_defaults",
    "listings",
    """
SELECT listing_id, coalesce(body_type, 'unknown') AS body_type, coalesce(drive_type, 'unknown') AS drive_type,
  coalesce(transmission, 'unknown') AS transmission, year, CAST(is_dealer AS INTEGER) AS is_dealer,
  nullif(mileage::DOUBLE, 0) AS mileage, nullif(power_hp::DOUBLE, 0) AS power_hp, nullif(engine_volume, 0) AS engine_volume
FROM listings
""",
)
def _(spark, sf):
    return FE.fill_defaults(D.listings(spark, sf)).select(
        "listing_id", "body_type", "drive_type", "transmission", "year", "is_dealer", "mileage", "power_hp", "engine_volume"
    )


@query(
    "derived_features",
    "listings",
    f"""
SELECT listing_id, CAST(2026 - year AS INTEGER) AS car_age, {rounded("ln(2026 - year + 1)", 6)} AS log_car_age,
  {rounded("ln(mileage + 1)", 6)} AS log_mileage, {rounded("mileage / greatest(2026 - year, 1)", 4)} AS mileage_per_year,
  {rounded("mileage / ((2026 - year) * 15000 + 1)", 6)} AS mileage_ratio, CAST(month(listing_date) AS INTEGER) AS listing_month,
  {rounded("power_hp / engine_volume", 4)} AS power_per_liter, CAST(lower(brand) IN ('bmw', 'audi') AS INTEGER) AS is_premium
FROM listings
""",
)
def _(spark, sf):
    out = FE.derived_features(FE.fill_defaults(D.listings(spark, sf)))
    digits = {"log_car_age": 6, "log_mileage": 6, "mileage_per_year": 4, "mileage_ratio": 6, "power_per_liter": 4}
    return out.select(
        "listing_id", "car_age", *[F.round(c, d).alias(c) for c, d in digits.items()], "listing_month", "is_premium"
    )


@query(
    "extra_features",
    "listings",
    f"SELECT listing_id, brand || '_' || model AS brand_model, {rounded('ln(engine_volume)', 6)} AS log_engine_volume FROM listings",
)
def _(spark, sf):
    out = FE.extra_features(D.listings(spark, sf))
    return out.select("listing_id", "brand_model", F.round("log_engine_volume", 6).alias("log_engine_volume"))


@query(
    "time_decay_weight",
    "listings",
    f"""SELECT listing_id, {rounded(f"exp(-0.007 * (date_diff('second', listing_date, {AS_OF}) / 86400))", 9)} AS weight FROM listings""",
)
def _(spark, sf):
    weight = FE.time_decay_weight(D.as_of(), F.col("listing_date"))
    return D.listings(spark, sf).select("listing_id", F.round(weight, 9).alias("weight"))


@query(
    "segment_sample_counts",
    "train",
    """
SELECT brand, model, count(*) AS samples, CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 15 THEN 'medium' ELSE 'low' END
  AS confidence FROM train GROUP BY brand, model
""",
)
def _(spark, sf):
    return FE.segment_sample_counts(train(spark, sf))


@query(
    "category_codes",
    "listings",
    """
SELECT model, CAST(dense_rank() OVER (ORDER BY model) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT model FROM listings) t
""",
)
def _(spark, sf):
    return E.category_codes(D.listings(spark, sf), "model")


# ------------------------------------------------------------------ encodings and baseline
@query(
    "target_encoding",
    "te_brand_model_year te_brand_model te_brand te_city",
    """
SELECT level, k, round(te, 8) AS te, n FROM (
  SELECT 'brand_model_year' AS level, brand || '_' || model || '_' || CAST(year AS VARCHAR) AS k, te, n FROM te_brand_model_year
  UNION ALL SELECT 'brand_model', brand || '_' || model, te, n FROM te_brand_model
  UNION ALL SELECT 'brand', brand, te, n FROM te_brand UNION ALL SELECT 'city', city, te, n FROM te_city) t
""",
)
def _(spark, sf):
    from kerbside.common import union_all

    tables = E.target_encoding(train(spark, sf))
    return union_all(
        [
            tables[level].select(
                F.lit(level).alias("level"), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("k"),
                F.round("te", 8).alias("te"), "n",
            )
            for level, keys in E.LEVELS.items()
        ]
    )


@query(
    "target_encoding_join",
    "listings te_brand_model te_city gm",
    """
SELECT listing_id, round(coalesce(b.te, (SELECT mean FROM gm)), 8) AS te_brand_model,
  round(coalesce(c.te, (SELECT mean FROM gm)), 8) AS te_city
FROM listings LEFT JOIN te_brand_model b USING (brand, model) LEFT JOIN te_city c USING (city)
""",
)
def _(spark, sf):
    out = E.apply_target_encoding(D.listings(spark, sf), E.target_encoding(train(spark, sf)))
    return out.select("listing_id", F.round("te_brand_model", 8).alias("te_brand_model"), F.round("te_city", 8).alias("te_city"))


FOLD = "CAST(((listing_id % 1000003) * 7919) % 5 AS INTEGER)"


@query("fold_assignment", "listings", f"SELECT {FOLD} AS fold, count(*) AS n, sum(price)::BIGINT AS price_sum FROM listings GROUP BY 1")
def _(spark, sf):
    return (
        D.listings(spark, sf).groupBy(fold_of(F.col("listing_id"), 5).alias("fold"))
        .agg(F.count("*").alias("n"), F.sum("price").alias("price_sum"))
    )


@query(
    "target_encoding_oof",
    "train gm",
    f"""
WITH f AS (SELECT *, {FOLD} AS fold FROM train),
t AS (SELECT brand, sum(ln(price)) AS ts, count(*) AS tn FROM f GROUP BY brand),
o AS (SELECT brand, fold, sum(ln(price)) AS s, count(*) AS n FROM f GROUP BY brand, fold)
SELECT listing_id, round((ts - s + 50 * (SELECT mean FROM gm)) / (tn - n + 50), 8) AS te_oof
FROM f JOIN t USING (brand) JOIN o USING (brand, fold)
""",
)
def _(spark, sf):
    rows = train(spark, sf).withColumn("fold", fold_of(F.col("listing_id"), 5))
    return E.target_encoding_oof(rows, ["brand"], "fold", 50).select("listing_id", F.round("te_oof", 8).alias("te_oof"))


def priced(spark, sf):
    rows = train(spark, sf)
    base = P.price_baseline(D.marked(spark, sf), E.target_encoding(rows))
    return P.with_sample_confidence(base, FE.segment_sample_counts(rows))


@query("price_baseline", "priced", "SELECT listing_id, p50, samples, confidence_level FROM priced")
def _(spark, sf):
    return priced(spark, sf).select("listing_id", "p50", "samples", "confidence_level")


@query(
    "price_vs_market",
    "priced",
    f"SELECT listing_id, CASE WHEN p50 > 0 AND price > 0 THEN {rounded('(1 - price / p50) * 100', 1)} END AS pct FROM priced",
)
def _(spark, sf):
    return priced(spark, sf).select("listing_id", P.price_vs_market(F.col("price"), F.col("p50")).alias("pct"))


@query("score_prices", "market", "SELECT listing_id, outcome, market_price, price_diff_pct FROM market")
def _(spark, sf):
    return P.score_prices(priced(spark, sf)).select("listing_id", "outcome", "market_price", "price_diff_pct")


@query(
    "score_prices_counts",
    "market",
    """
SELECT count(*) FILTER (WHERE outcome = 'scored') AS scored, count(*) FILTER (WHERE outcome = 'skipped_sanity') AS skipped_sanity,
  count(*) FILTER (WHERE outcome = 'skipped_low_confidence') AS skipped_low_confidence,
  count(*) FILTER (WHERE outcome = 'no_prediction') AS no_prediction, count(*) FILTER (WHERE outcome = 'not_due') AS not_due FROM market
""",
)
def _(spark, sf):
    return P.score_counts(D.scored(spark, sf))


# ------------------------------------------------------------------ scores
@query(
    "price_ratio",
    "scored",
    f"""SELECT listing_id, ratio AS price_ratio, {rounded("(1 - ratio) * 100", 2)} AS diff_pct FROM scored""",
)
def _(spark, sf):
    ratio = SC.price_ratio(F.col("price"), F.col("market_price"))
    return D.scored(spark, sf).select("listing_id", ratio.alias("price_ratio"), SC.diff_from_ratio(ratio).alias("diff_pct"))


@query(
    "diff_from_ratio",
    "scored",
    f"""SELECT category, count(*) AS n, {rounded(f"round(avg({rounded('(1 - ratio) * 100', 2)}), 9)", 4)} AS avg_diff FROM scored GROUP BY category""",
)
def _(spark, sf):
    diff = SC.diff_from_ratio(SC.price_ratio(F.col("price"), F.col("market_price")))
    return D.scored(spark, sf).groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.round(F.avg(diff), 9), 4).alias("avg_diff")
    )


@query("attractiveness", "scored", "SELECT listing_id, category, attractiveness FROM scored WHERE category IS NOT NULL")
def _(spark, sf):
    ratio = SC.price_ratio(F.col("price"), F.col("market_price"))
    score = SC.attractiveness(F.col("category"), F.col("confidence"), ratio)
    return D.scored(spark, sf).filter(F.col("category").isNotNull()).select(
        "listing_id", "category", score.alias("attractiveness")
    )


@query(
    "deal_score",
    "scored",
    """
SELECT listing_id, CAST(trunc(greatest(least(50.0 + part_price + part_category + part_mileage + part_photos + part_gaps
  + part_fresh + part_owners + part_cheap, score_cap, 100.0), 0.0)) AS INTEGER) AS deal_score, score_cap::DOUBLE AS score_cap,
  part_gaps::DOUBLE AS part_gaps, part_mileage::DOUBLE AS part_mileage, part_fresh::DOUBLE AS part_fresh FROM scored
""",
)
def _(spark, sf):
    rows = D.scored(spark, sf).drop("deal_score").join(D.text_flags(spark, sf).select("doc_id", "red_flag"), "doc_id", "left")
    from kerbside.functions.text import red_flag_hit

    flag = F.coalesce("red_flag", F.lit(False)) | red_flag_hit(F.col("url"))
    return SC.deal_score(rows, D.as_of(), flag).select(
        "listing_id", "deal_score", "score_cap", "part_gaps", "part_mileage", "part_fresh"
    )


@query("score_deals", "scored", "SELECT listing_id, deal_score, is_duplicate FROM scored")
def _(spark, sf):
    from kerbside.functions.text import red_flag_hit

    flags = D.text_flags(spark, sf).select("doc_id", "red_flag")
    rows = D.scored(spark, sf).drop("deal_score").join(flags, "doc_id", "left")
    scored = SC.score_deals(rows, D.as_of(), F.coalesce("red_flag", F.lit(False)) | red_flag_hit(F.col("url")))
    return scored.select("listing_id", "deal_score", "is_duplicate")


# ------------------------------------------------------------------ comparables
ELIGIBLE = f"(SELECT * FROM marked WHERE NOT is_duplicate AND price > 0 AND created_at >= {AS_OF} - INTERVAL 2400 DAY)"
PAIRS = f"""
SELECT t.listing_id, c.listing_id AS comparable_id, c.price, c.source, c.year AS comparable_year,
  coalesce(c.mileage, 0) AS comparable_mileage,
  round(0.35 * pow(abs(t.year - c.year) / 2, 2)
    + 0.45 * pow(abs(ln(greatest(coalesce(t.mileage, 0), 1)) - ln(greatest(coalesce(c.mileage, 0), 1))), 2)
    + 0.20 * pow(abs(coalesce(t.engine_volume, 0) - coalesce(c.engine_volume, 0)) / 0.5, 2), 6) AS distance,
  coalesce(abs(coalesce(t.mileage, 0) - c.mileage), 1000000) AS gap
FROM marked t JOIN {ELIGIBLE} c ON lower(c.brand) = lower(t.brand) AND lower(c.model) = lower(t.model)
  AND c.year BETWEEN t.year - 2 AND t.year + 2
  AND (c.mileage IS NULL OR c.mileage BETWEEN coalesce(t.mileage, 0) - 30000 AND coalesce(t.mileage, 0) + 30000)
"""
NEAREST = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY distance, gap, price, comparable_id) AS INTEGER)
  AS rank FROM ({PAIRS}) p)"""


@query(
    "knn_topk",
    "marked",
    f"""
SELECT listing_id, rank, comparable_id, price, source, comparable_year, comparable_mileage, distance FROM {NEAREST} n WHERE rank <= 10
""",
)
def _(spark, sf):
    return K.knn_topk(D.marked(spark, sf), D.as_of(), 10, D.FIXTURE_MAX_AGE_DAYS)


@query("comparables_join", "marked", f"SELECT t.listing_id, coalesce(n, 0) AS candidates FROM marked t LEFT JOIN (SELECT listing_id, count(*) AS n FROM ({PAIRS}) p GROUP BY listing_id) c USING (listing_id)")
def _(spark, sf):
    out = K.comparables_join(D.marked(spark, sf), D.as_of(), D.FIXTURE_MAX_AGE_DAYS)
    return out.select("listing_id", F.coalesce("candidates", F.lit(0).cast("bigint")).alias("candidates"))


COMPARABLE = f"""(SELECT listing_id, CAST(floor(quantile_cont(price, 0.25)) AS INTEGER) AS p25_price,
  CAST(floor(quantile_cont(price, 0.5)) AS INTEGER) AS median_price, CAST(floor(quantile_cont(price, 0.75)) AS INTEGER) AS p75_price,
  CAST(count(*) AS INTEGER) AS comparables FROM {NEAREST} n WHERE rank <= 10 GROUP BY listing_id)"""


@query(
    "comparable_price",
    "marked",
    f"""
SELECT m.listing_id, p25_price, median_price, p75_price, coalesce(comparables, 0) AS comparables,
  CASE WHEN comparables IS NULL THEN 0.0 WHEN comparables >= 10 THEN 1.0
    ELSE {rounded("0.2::DOUBLE + (comparables - 1) * 0.8::DOUBLE / 9", 2)} END AS comparable_confidence
FROM marked m LEFT JOIN {COMPARABLE} c USING (listing_id)
""",
)
def _(spark, sf):
    return K.comparable_price(D.marked(spark, sf), D.as_of(), 10, D.FIXTURE_MAX_AGE_DAYS).select(
        "listing_id", "p25_price", "median_price", "p75_price", "comparables", "comparable_confidence"
    )


HAS_S, HAS_M, HAS_C = "src IS NOT NULL", "p50 IS NOT NULL", "median_price IS NOT NULL"


@query(
    "ensemble_price",
    "marked scored",
    f"""
WITH j AS (SELECT s.listing_id, CASE WHEN s.listing_id % 3 = 0 THEN s.price + 5000 END AS src, c.median_price, coalesce(c.comparables, 0) AS n,
  s.market_price AS p50 FROM scored s LEFT JOIN {COMPARABLE} c USING (listing_id)),
m AS (SELECT *, CASE WHEN {HAS_S} AND {HAS_C} AND n >= 3 AND {HAS_M} THEN 'source+comparable+model'
  WHEN {HAS_S} AND {HAS_M} AND ({HAS_C} AND n >= 3) IS NOT TRUE THEN 'source+model'
  WHEN {HAS_S} AND {HAS_C} AND n >= 3 THEN 'source+comparable'
  WHEN {HAS_C} AND n >= 3 AND {HAS_M} THEN 'comparable+model' WHEN {HAS_C} AND n < 3 AND {HAS_M} THEN 'model_heavy+comparable'
  WHEN {HAS_M} THEN 'model_only' WHEN {HAS_C} THEN 'comparable_only' WHEN {HAS_S} THEN 'source_only' ELSE 'none' END
  AS ensemble_method FROM j)
SELECT listing_id, ensemble_method, CAST(floor(CASE ensemble_method
  WHEN 'source+comparable+model' THEN src * 0.5::DOUBLE + median_price * 0.3::DOUBLE + p50 * 0.2::DOUBLE
  WHEN 'source+model' THEN src * 0.5::DOUBLE + p50 * 0.5::DOUBLE WHEN 'source+comparable' THEN src * 0.5::DOUBLE + median_price * 0.5::DOUBLE
  WHEN 'comparable+model' THEN median_price * 0.5::DOUBLE + p50 * 0.5::DOUBLE
  WHEN 'model_heavy+comparable' THEN median_price * 0.3::DOUBLE + p50 * 0.7::DOUBLE
  WHEN 'model_only' THEN p50::DOUBLE WHEN 'comparable_only' THEN median_price::DOUBLE WHEN 'source_only' THEN src::DOUBLE END) AS INTEGER)
  AS ensemble_price,
  {rounded(f'''least(CASE WHEN {HAS_S} THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {HAS_M} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n >= 10 THEN 0.4::DOUBLE
    WHEN n >= 3 THEN 0.2::DOUBLE + (n - 3) * 0.2::DOUBLE / 7 WHEN n >= 1 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE)''', 2)} AS ensemble_confidence
FROM m
""",
)
def _(spark, sf):
    near = K.comparable_price(D.marked(spark, sf), D.as_of(), 10, D.FIXTURE_MAX_AGE_DAYS).select(
        "listing_id", "median_price", "comparables"
    )
    rows = (
        D.scored(spark, sf)
        .select(
            "listing_id", F.when(F.col("listing_id") % 3 == 0, F.col("price") + 5000).alias("source_estimate"),
            F.col("market_price").alias("p50"),
        )
        .join(near, "listing_id", "left")
    )
    return P.ensemble_price(rows).select("listing_id", "ensemble_method", "ensemble_price", "ensemble_confidence")


# ------------------------------------------------------------------ error measures (on the baseline price)
def _predictions(spark, sf):
    return D.scored(spark, sf).filter(F.col("market_price").isNotNull()).select(
        "listing_id", "brand", "price", F.col("market_price").alias("p50"), fold_of(F.col("listing_id"), 5).alias("fold")
    )


PREDICTIONS = f"(SELECT listing_id, brand, price, market_price AS p50, {FOLD} AS fold FROM scored WHERE market_price IS NOT NULL)"
MAPE = "avg(abs((price - p50) / price)) * 100"


@query("mape_overall", "scored", f"SELECT {rounded(MAPE, 4)} AS mape FROM {PREDICTIONS} p")
def _(spark, sf):
    return V.mape_overall(_predictions(spark, sf))


@query("mae", "scored", f"SELECT {rounded('avg(abs(price - p50))', 2)} AS mae FROM {PREDICTIONS} p")
def _(spark, sf):
    return V.mae(_predictions(spark, sf))


@query("mape_by_fold", "scored", f"SELECT fold, count(*) AS n, {rounded(MAPE, 4)} AS mape FROM {PREDICTIONS} p GROUP BY fold")
def _(spark, sf):
    return V.mape_by_fold(_predictions(spark, sf))


@query(
    "mape_by_price_segment",
    "scored",
    f"""
SELECT CASE WHEN price < 800000 THEN '<800K' WHEN price < 1500000 THEN '800K-1.5M' ELSE '>1.5M' END AS segment, count(*) AS n,
  {rounded(MAPE, 1)} AS mape FROM {PREDICTIONS} p GROUP BY 1 HAVING count(*) >= 20
""",
)
def _(spark, sf):
    return V.mape_by_price_segment(_predictions(spark, sf))


@query(
    "mape_by_brand_top_bottom",
    "scored",
    f"""
WITH b AS (SELECT brand, count(*) AS n, {rounded(MAPE, 4)} AS mape FROM {PREDICTIONS} p GROUP BY brand HAVING count(*) >= 30)
SELECT * FROM (SELECT *, 'worst' AS side FROM b ORDER BY mape DESC, brand LIMIT 7) w
UNION ALL SELECT * FROM (SELECT *, 'best' AS side FROM b ORDER BY mape, brand LIMIT 5) t
""",
)
def _(spark, sf):
    return V.mape_by_brand_top_bottom(_predictions(spark, sf))


@query(
    "stacked_p50",
    "scored",
    f"SELECT listing_id, {rounded('market_price * 0.4::DOUBLE + coalesce(price, market_price) * 0.4::DOUBLE + market_price * 0.2::DOUBLE', 4)} AS p50 FROM scored WHERE market_price IS NOT NULL",
)
def _(spark, sf):
    rows = D.scored(spark, sf).filter(F.col("market_price").isNotNull())
    blend = P.stacked_p50(F.col("market_price"), F.col("price"), F.lit(None).cast("double"))
    return rows.select("listing_id", F.round(blend, 4).alias("p50"))


GRID = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in V.weight_grid())


@query(
    "stack_weight_search",
    "scored",
    f"""
SELECT w_first, w_second, w_third, {rounded("avg(abs((price - (w_first * market_price + w_second * price * 1.1::DOUBLE + w_third * (market_price + 20000))) / price)) * 100", 6)}
  AS mape FROM scored, (VALUES {GRID}) AS g(w_first, w_second, w_third) WHERE market_price IS NOT NULL GROUP BY ALL
""",
)
def _(spark, sf):
    rows = D.scored(spark, sf).filter(F.col("market_price").isNotNull()).select(
        "price", F.col("market_price").cast("double").alias("p_first"), (F.col("price") * 1.1).alias("p_second"),
        (F.col("market_price") + 20_000).cast("double").alias("p_third"),
    )
    return V.stack_weight_search(rows)


def _runs(spark, sf):
    """Model runs: one per day of events, its mean value as the error."""
    return D.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("p50_mape")
    ).withColumn("status", F.when(F.dayofmonth("day") % 3 == 0, "production").otherwise("rejected"))


RUNS = f"""(SELECT day, {rounded("round(avg(value), 9)", 6)} AS p50_mape, CASE WHEN day(day) % 3 = 0 THEN 'production' ELSE 'rejected' END AS status
  FROM (SELECT CAST(ts AS DATE) AS day, value FROM events) e GROUP BY day)"""


@query("best_run", None, f"SELECT coalesce(min(p50_mape) FILTER (WHERE status = 'production'), min(p50_mape)) AS best_mape FROM {RUNS} r")
def _(spark, sf):
    return V.best_run(_runs(spark, sf))


@query(
    "promotion",
    None,
    f"""
WITH b AS (SELECT coalesce(min(p50_mape) FILTER (WHERE status = 'production'), min(p50_mape)) AS best_mape FROM {RUNS} r)
SELECT day, best_mape, CASE WHEN p50_mape > best_mape THEN 'rejected' ELSE 'production' END AS decision FROM {RUNS} r, b
""",
)
def _(spark, sf):
    runs = _runs(spark, sf)
    return V.promotion(runs, runs).select("day", "best_mape", "decision")
