"""The driver-table views in portable SQL, and a helper that puts the needed ones in front of an oracle query."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-11-05 00:00:00'"

def rounded(expression: str, digits: int) -> str:
    """Half-up rounding of a double on its decimal digits, as Spark rounds."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: str, body: str) -> str:
    """``WITH`` clause holding the named views and whatever they need, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


view(
    "raw_ads",
    (),
    """
SELECT l_orderkey * 10 + l_linenumber AS ad_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' ELSE 'src_c' END AS source,
  CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS external_id,
  p_brand AS brand, p_type AS model,
  CAST(2006 + (o_orderkey * 7) % 20 AS INTEGER) AS year,
  CAST(CASE WHEN l_quantity >= 3 THEN floor(l_quantity / 10) * 40000 + 20000 END AS INTEGER) AS mileage,
  CAST(floor(p_size / 10.0) * 300000 + floor(l_extendedprice / 10000) * 100000 + 50000 AS INTEGER) AS price,
  CASE WHEN p_size % 5 <> 0 THEN CAST(1.0 + (p_size % 5) * 0.5 AS DOUBLE) END AS engine_volume,
  CASE l_partkey % 4 WHEN 0 THEN 'gasoline' WHEN 1 THEN 'дизель' WHEN 2 THEN 'hybrid' END AS engine_type,
  CAST(CASE WHEN l_suppkey % 6 <> 0 THEN 60 + (l_partkey * 13) % 240 END AS INTEGER) AS power_hp,
  CASE l_suppkey % 5 WHEN 0 THEN 'AT' WHEN 1 THEN ' механика ' WHEN 2 THEN 'CVT' WHEN 3 THEN 'tiptronic' END
    AS transmission,
  CASE l_partkey % 3 WHEN 0 THEN 'front_drive' WHEN 1 THEN '4WD' END AS drive_type,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 < 3 THEN 'sedan' ELSE 'suv' END AS body_type,
  CAST(1 + l_suppkey % 4 AS INTEGER) AS owners_count,
  CAST(l_partkey % 15 AS INTEGER) AS photo_count,
  n_name AS city,
  c_mktsegment = 'MACHINERY' AS is_dealer,
  CAST(l_shipdate AS TIMESTAMP) AS seen_at,
  CAST(o_orderdate AS TIMESTAMP) AS listing_date,
  l_partkey, l_suppkey, l_quantity, l_extendedprice,
  'https://cars.example/' || CASE l_linenumber % 3 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' ELSE 'src_c' END
    || CASE WHEN l_suppkey % 97 = 0 THEN '/bityy' ELSE '' END || '/'
    || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS url,
  p_brand || ' ' || p_type || ' '
    || CASE WHEN p_size % 5 = 0 THEN '2.5' ELSE CAST(CAST(1.0 + (p_size % 5) * 0.5 AS DECIMAL(3,1)) AS VARCHAR) END
    || ' AT, ' || CAST(2006 + (o_orderkey * 7) % 20 AS VARCHAR) AS title,
  (l_orderkey * 10 + l_linenumber) % (SELECT count(*) FROM documents) AS doc_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""",
)
view(
    "listings",
    ("raw_ads",),
    """
SELECT ad_id AS listing_id, source, external_id, title, brand, model, year, mileage, price, engine_volume, engine_type,
  power_hp, transmission, drive_type, body_type, owners_count, photo_count, city, is_dealer, url, doc_id, listing_date,
  created_at, seen_at AS updated_at
FROM (SELECT *, min(seen_at) OVER (PARTITION BY ad_id) AS created_at,
        row_number() OVER (PARTITION BY ad_id
          ORDER BY seen_at DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM raw_ads) t
WHERE rn = 1
""",
)
view(
    "history_points",
    ("raw_ads", "listings"),
    """
SELECT p.ad_id AS listing_id, p.price, CAST(p.first_seen AS DATE) AS date,
  row_number() OVER (PARTITION BY p.ad_id ORDER BY p.first_seen, p.price) AS pos,
  count(*) OVER (PARTITION BY p.ad_id) AS n
FROM (SELECT ad_id, price, min(seen_at) AS first_seen FROM raw_ads GROUP BY ad_id, price) p
JOIN listings l ON l.listing_id = p.ad_id WHERE p.price <> l.price
""",
)
view(
    "document_analysis",
    (),
    """
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'clean' WHEN quality = 1 AND toxic = 1
  THEN 'complex_but_profitable' WHEN quality = 0 AND toxic = 0 THEN 'damaged_body' ELSE 'debtor' END AS category,
  CAST(0.25 + (doc_id % 4) * 0.25 AS DOUBLE) AS confidence
FROM labels
""",
)
view(
    "analysis",
    ("listings", "document_analysis"),
    "SELECT listing_id, category, confidence FROM listings JOIN document_analysis USING (doc_id)",
)
view(
    "duplicates",
    ("listings",),
    """
SELECT listing_id, source, first_value(listing_id) OVER w AS canonical_id,
  source <> first_value(source) OVER w AS is_duplicate
FROM listings WHERE city <> ''
WINDOW w AS (PARTITION BY lower(brand), lower(model), year, lower(city), price, coalesce(mileage, 0)
             ORDER BY created_at, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
)
view(
    "marked",
    ("listings", "duplicates"),
    """
SELECT l.*, coalesce(d.is_duplicate, false) AS is_duplicate,
  CASE WHEN d.is_duplicate THEN d.canonical_id END AS canonical_id
FROM listings l LEFT JOIN duplicates d USING (listing_id)
""",
)


def negatable(text: str, word: str) -> str:
    """First occurrence of ``word`` exists and the four characters before it hold no negation."""
    at = f"strpos({text}, '{word}')"
    before = f"substr({text}, greatest({at} - 4, 1), least({at} - 1, 4))"
    return f"({at} > 0 AND NOT contains({before}, 'th') AND NOT contains({before}, 's '))"


view(
    "text_flags",
    (),
    f"""
SELECT doc_id, lower(text) AS t,
  contains(lower(text), 'outre') OR contains(lower(text), 'eauou') OR contains(lower(text), 'bityy')
    OR {negatable("lower(text)", "lement")} OR {negatable("lower(text)", "ention")} AS red_flag,
  contains(lower(text), 'thintion') OR contains(lower(text), 'inging') AS bars_training
FROM documents
""",
)
view(
    "trainable",
    ("marked", "analysis", "text_flags"),
    """
SELECT m.*, a.category FROM marked m LEFT JOIN analysis a USING (listing_id) LEFT JOIN text_flags f USING (doc_id)
WHERE NOT m.is_duplicate AND m.price > 0 AND coalesce(a.category, '') NOT IN ('damaged_body', 'bad_docs', 'debtor')
  AND NOT coalesce(f.bars_training, false)
""",
)
FRESH = f"created_at >= {AS_OF} - INTERVAL 2400 DAY"
view("fresh", ("trainable",), f"SELECT * FROM trainable WHERE {FRESH}")
view(
    "iqr_bounds",
    ("fresh",),
    """
SELECT brand, model, count(*) AS n,
  quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS low,
  quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS high
FROM fresh GROUP BY brand, model HAVING count(*) >= 5
""",
)
view(
    "after_iqr",
    ("fresh", "iqr_bounds"),
    """
SELECT f.* FROM fresh f LEFT JOIN iqr_bounds b USING (brand, model)
WHERE b.low IS NULL OR (f.price >= b.low AND f.price <= b.high)
""",
)
view(
    "mad_stats",
    ("after_iqr",),
    """
SELECT brand, model, count(*) AS n, any_value(median_ln) AS median_ln,
  quantile_cont(abs(ln(price) - median_ln), 0.5) AS mad
FROM (SELECT brand, model, price, m.median_ln FROM after_iqr JOIN
        (SELECT brand, model, quantile_cont(ln(price), 0.5) AS median_ln FROM after_iqr GROUP BY brand, model) m
      USING (brand, model)) t
GROUP BY brand, model HAVING count(*) >= 10 AND quantile_cont(abs(ln(price) - median_ln), 0.5) >= 1e-9
""",
)
view(
    "after_mad",
    ("after_iqr", "mad_stats"),
    """
SELECT r.* FROM after_iqr r LEFT JOIN mad_stats s USING (brand, model)
WHERE s.mad IS NULL OR abs(ln(r.price) - s.median_ln) / s.mad <= 3.5
""",
)
view(
    "after_mileage",
    ("after_mad",),
    "SELECT * FROM after_mad WHERE mileage IS NULL OR mileage / greatest(2026 - year, 1) <= 60000",
)
view(
    "clean",
    ("after_mileage",),
    """
SELECT r.* FROM after_mileage r JOIN
  (SELECT brand, model, quantile_cont(price, 0.5) AS median_price FROM after_mileage GROUP BY brand, model) s
  USING (brand, model)
WHERE (SELECT count(*) FROM after_mileage) <= 100 OR r.price >= s.median_price * 0.3
""",
)
view(
    "train",
    ("clean",),
    "SELECT * FROM clean WHERE price BETWEEN 50000 AND 20000000 AND year BETWEEN 1990 AND 2027",
)
view("gm", ("train",), "SELECT avg(ln(price)) AS mean FROM train")


def encoding(name: str, keys: str, strength: int) -> None:
    view(
        name,
        ("train", "gm"),
        f"""SELECT {keys}, (sum(ln(price)) + {strength} * (SELECT mean FROM gm)) / (count(*) + {strength}) AS te,
  count(*) AS n FROM train GROUP BY {keys}""",
    )


encoding("te_brand_model_year", "brand, model, year", 10)
encoding("te_brand_model", "brand, model", 30)
encoding("te_brand", "brand", 50)
encoding("te_city", "city", 50)
view(
    "priced",
    ("marked", "te_brand_model_year", "te_brand_model", "te_brand"),
    """
SELECT m.*, CAST(floor(exp(coalesce(y.te, bm.te, b.te, (SELECT mean FROM gm)))) AS INTEGER) AS p50,
  coalesce(bm.n, 0) AS samples,
  CASE WHEN coalesce(bm.n, 0) >= 50 THEN 'high' WHEN coalesce(bm.n, 0) >= 15 THEN 'medium' ELSE 'low' END
    AS confidence_level
FROM marked m LEFT JOIN te_brand_model_year y USING (brand, model, year)
LEFT JOIN te_brand_model bm USING (brand, model) LEFT JOIN te_brand b USING (brand)
""",
)
view(
    "market",
    ("priced",),
    f"""
SELECT *, CASE WHEN outcome = 'scored' THEN p50 END AS market_price,
  CASE WHEN outcome = 'scored' THEN greatest(least({rounded("(1 - price / p50) * 100", 1)}, 999.99), -999.99) END
    AS price_diff_pct
FROM (SELECT *, CASE WHEN NOT (price > 0 AND year >= 1990) THEN 'not_due' WHEN p50 <= 0 THEN 'no_prediction'
        WHEN p50 / price < 0.4 OR p50 / price > 2.5 THEN 'skipped_sanity'
        WHEN confidence_level = 'low' AND (p50 / price < 0.55 OR p50 / price > 1.8) THEN 'skipped_low_confidence'
        ELSE 'scored' END AS outcome FROM priced) t
""",
)
view(
    "deal_parts",
    ("market", "analysis", "text_flags"),
    f"""
SELECT k.*, a.category, a.confidence,
  coalesce(greatest(least(price_diff_pct, 30.0), -30.0)
    * CASE WHEN 2026 - year > 15 THEN 0.5 WHEN 2026 - year > 10 THEN 0.75 ELSE 1.0 END * 1.5, 0.0) AS part_price,
  CASE a.category WHEN 'clean' THEN 10.0 WHEN 'complex_but_profitable' THEN 5.0 ELSE 0.0 END AS part_category,
  CASE WHEN coalesce(mileage, 0) = 0 THEN 0.0 WHEN mileage / greatest(2026 - year, 1) < 10000 THEN 5.0
    WHEN mileage / greatest(2026 - year, 1) > 30000 THEN -5.0 ELSE 0.0 END AS part_mileage,
  CASE WHEN photo_count > 10 THEN 5.0 WHEN photo_count > 5 THEN 3.0 ELSE 0.0 END AS part_photos,
  CASE WHEN gaps >= 2 THEN -8.0 WHEN gaps = 1 THEN -3.0 ELSE 0.0 END AS part_gaps,
  CASE WHEN age_h < 6 THEN 8.0 WHEN age_h < 24 THEN 4.0 WHEN age_h > 72 THEN -3.0 ELSE 0.0 END AS part_fresh,
  CASE WHEN owners_count = 1 THEN 5.0 WHEN owners_count >= 4 THEN -5.0 ELSE 0.0 END AS part_owners,
  CASE WHEN price > 0 AND price < 200000 THEN -5.0 ELSE 0.0 END AS part_cheap,
  least(100.0, CASE WHEN gaps >= 2 THEN 65.0 WHEN gaps = 1 THEN 80.0 ELSE 100.0 END,
    CASE WHEN price > 0 AND price < 100000 THEN 20.0 ELSE 100.0 END,
    CASE WHEN a.category = 'damaged_body' THEN 15.0 WHEN a.category IN ('bad_docs', 'debtor') THEN 10.0 ELSE 100.0 END,
    CASE WHEN mileage >= 300000 THEN 30.0 WHEN mileage >= 200000 THEN 55.0 ELSE 100.0 END,
    CASE WHEN coalesce(mileage, 0) <> 0 AND mileage / greatest(2026 - year, 1) > 50000 THEN 40.0 ELSE 100.0 END,
    CASE WHEN coalesce(f.red_flag, false) OR contains(lower(k.url), 'bityy') THEN 15.0 ELSE 100.0 END) AS score_cap
FROM (SELECT *, (CASE WHEN coalesce(mileage, 0) = 0 THEN 1 ELSE 0 END) + (CASE WHEN body_type IS NULL THEN 1 ELSE 0 END)
        AS gaps, date_diff('second', created_at, {AS_OF}) / 3600 AS age_h FROM market) k
LEFT JOIN analysis a USING (listing_id) LEFT JOIN text_flags f USING (doc_id)
""",
)
ATTRACTIVENESS = """greatest(least(
    (CASE category WHEN 'clean' THEN 1.0 WHEN 'complex_but_profitable' THEN 0.7 WHEN 'damaged_body' THEN 0.3
       WHEN 'bad_docs' THEN 0.2 WHEN 'debtor' THEN 0.15 ELSE 0.5 END::DOUBLE * 5
     + CASE WHEN ratio > 0 THEN least(greatest(1 - ratio, 0.0::DOUBLE) * 2, 1.0::DOUBLE) * 5 ELSE 2.5::DOUBLE END)
    * (0.7::DOUBLE + confidence * 0.3::DOUBLE), 10.0::DOUBLE), 0.0::DOUBLE)"""
view(
    "scored",
    ("deal_parts",),
    f"""
SELECT *, CASE WHEN NOT is_duplicate AND price > 0 THEN CAST(trunc(greatest(least(50.0 + part_price + part_category
    + part_mileage + part_photos + part_gaps + part_fresh + part_owners + part_cheap, score_cap, 100.0), 0.0))
    AS INTEGER) END AS deal_score,
  CASE WHEN category IS NOT NULL THEN {rounded(ATTRACTIVENESS, 1)} END AS attractiveness
FROM (SELECT *, CASE WHEN market_price > 0 THEN {rounded("price / market_price", 3)} END AS ratio FROM deal_parts) t
""",
)
