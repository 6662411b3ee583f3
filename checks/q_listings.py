"""Ingest, dedup and lifecycle queries."""

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import AS_OF
from kerbside.functions import normalise as N
from kerbside.operators import ad_filters as A
from kerbside.operators import dedup, lifecycle, upsert
from kerbside.sources import driver_tables as D
from kerbside.sources import readers
from kerbside.sources.rendered import card_url

DATE = "DATE '2001-11-05'"


@query(
    "scan_listings",
    "listings",
    "SELECT listing_id, source, brand, model, year, mileage, price, city FROM listings",
)
def _(spark, sf):
    D.listings(spark, sf)
    path = D._written[(spark.sparkContext.applicationId, sf, "listings")]
    return readers.scan_listings(spark, path, ["listing_id", "source", "brand", "model", "year", "mileage", "price", "city"])


@query(
    "scan_listings_with_analysis",
    "listings analysis",
    "SELECT l.listing_id, l.brand, l.price, a.category, a.confidence FROM listings l LEFT JOIN analysis a USING (listing_id)",
)
def _(spark, sf):
    both = readers.scan_listings_with_analysis(D.listings(spark, sf), D.analysis(spark, sf))
    return both.select("listing_id", "brand", "price", "category", "confidence")


@query(
    "union_sources",
    "raw_ads",
    """
SELECT source, count(*) AS ads, count(body_type) AS with_body, count(mileage) AS with_mileage, sum(price)::BIGINT AS price_sum
FROM (SELECT source, price, mileage, CASE WHEN source <> 'src_c' THEN body_type END AS body_type FROM raw_ads) t
GROUP BY source
""",
)
def _(spark, sf):
    ads = D.raw_ads(spark, sf).select("source", "price", "mileage", "body_type")
    # the third marketplace does not give a body type
    parts = [ads.filter(F.col("source") == s) for s in ("src_a", "src_b")]
    parts.append(ads.filter(F.col("source") == "src_c").drop("body_type"))
    return readers.union_sources(parts).groupBy("source").agg(
        F.count("*").alias("ads"),
        F.count("body_type").alias("with_body"),
        F.count("mileage").alias("with_mileage"),
        F.sum("price").alias("price_sum"),
    )


# ------------------------------------------------------------------ normalise and validate
def _canonical(column, table):
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE lower(trim({column})) {cases} ELSE trim({column}) END"


SAMPLE_TRANSMISSION = {"at": "АКПП", "механика": "МКПП", "cvt": "вариатор"}
SAMPLE_DRIVE = {"front_drive": "передний", "4wd": "полный"}
SAMPLE_BODY = {"sedan": "седан"}
SAMPLE_ENGINE = {"gasoline": "бензин", "дизель": "дизель", "hybrid": "гибрид"}


@query(
    "normalise_categoricals",
    "listings",
    f"""
SELECT listing_id, {_canonical("transmission", SAMPLE_TRANSMISSION)} AS transmission,
  {_canonical("drive_type", SAMPLE_DRIVE)} AS drive_type, {_canonical("body_type", SAMPLE_BODY)} AS body_type,
  {_canonical("engine_type", SAMPLE_ENGINE)} AS engine_type FROM listings
""",
)
def _(spark, sf):
    return N.normalise_categoricals(D.listings(spark, sf)).select(
        "listing_id", "transmission", "drive_type", "body_type", "engine_type"
    )


@query(
    "dictionary_joins",
    "listings",
    f"""
SELECT {_canonical("transmission", SAMPLE_TRANSMISSION)} AS transmission,
  {_canonical("drive_type", SAMPLE_DRIVE)} AS drive_type, count(*) AS n FROM listings GROUP BY 1, 2
""",
)
def _(spark, sf):
    return N.normalise_categoricals(D.listings(spark, sf)).groupBy("transmission", "drive_type").agg(F.count("*").alias("n"))


@query(
    "normalise_brand",
    "listings",
    """
SELECT listing_id, CASE listing_id % 7 WHEN 0 THEN 'LADA' WHEN 1 THEN 'BMW' WHEN 2 THEN 'Skoda' WHEN 3 THEN 'GAZ'
  WHEN 4 THEN 'Mercedes-Benz' ELSE brand END AS brand FROM listings
""",
)
def _(spark, sf):
    spelled = (
        F.when(F.col("listing_id") % 7 == 0, "Lada (ВАЗ)")
        .when(F.col("listing_id") % 7 == 1, " бмв ")
        .when(F.col("listing_id") % 7 == 2, "Шкода (import)")
        .when(F.col("listing_id") % 7 == 3, "ГАЗ")
        .when(F.col("listing_id") % 7 == 4, "mercedes")
        .otherwise(F.concat(F.lit(" "), F.col("brand")))
    )
    return N.normalise_brand(D.listings(spark, sf).withColumn("brand", spelled)).select("listing_id", "brand")


def _dirty(spark, sf):
    """Sightings with impossible values mixed in."""
    key = F.col("ad_id")
    return D.raw_ads(spark, sf).select(
        "ad_id",
        F.when(key % 11 == 0, F.lit(9_999)).when(key % 13 == 0, F.lit(50_000_001)).otherwise(F.col("price")).alias("price"),
        F.when(key % 5 == 0, F.lit(-1)).when(key % 7 == 0, F.lit(1_000_000)).otherwise(F.col("mileage")).alias("mileage"),
        F.when(key % 3 == 0, F.lit(1969)).when(key % 4 == 0, F.lit(2028)).otherwise(F.col("year")).alias("year"),
    )


DIRTY = """(SELECT ad_id,
  CASE WHEN ad_id % 11 = 0 THEN 9999 WHEN ad_id % 13 = 0 THEN 50000001 ELSE price END AS price,
  CASE WHEN ad_id % 5 = 0 THEN -1 WHEN ad_id % 7 = 0 THEN 1000000 ELSE mileage END AS mileage,
  CASE WHEN ad_id % 3 = 0 THEN 1969 WHEN ad_id % 4 = 0 THEN 2028 ELSE year END AS year FROM raw_ads)"""


@query(
    "validate_ads",
    "raw_ads",
    f"""
SELECT ad_id, price, CASE WHEN mileage BETWEEN 0 AND 999999 THEN mileage END AS mileage,
  CASE WHEN year BETWEEN 1970 AND 2027 THEN year ELSE 0 END AS year
FROM {DIRTY} t WHERE price BETWEEN 10000 AND 50000000
""",
)
def _(spark, sf):
    return N.validate_ads(_dirty(spark, sf))


@query(
    "validate_ads_rejects",
    "raw_ads",
    f"""
SELECT CASE WHEN price < 10000 THEN 'price too low' ELSE 'price too high' END AS reason, count(*) AS n
FROM {DIRTY} t WHERE price NOT BETWEEN 10000 AND 50000000 GROUP BY 1
""",
)
def _(spark, sf):
    return N.rejected_ads(_dirty(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ upsert
CUT = "2001-01-01 00:00:00"


def _first_sighting(spark, sf, columns=("*",)):
    """Ads as fetched in a run: first sighting per id."""
    order = [F.col(c) for c in ("seen_at", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    if columns != ("*",):
        return upsert.first_per_key(D.raw_ads(spark, sf).select(*columns), ["ad_id"], order)
    return D.sightings(spark, sf, lambda rows, keys: upsert.first_per_key(rows, keys, order))


FIRST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY seen_at, l_partkey, l_suppkey,
  l_quantity, l_extendedprice) AS rn FROM raw_ads) t WHERE rn = 1)"""
STORED = f"(SELECT * FROM {FIRST} f WHERE seen_at < TIMESTAMP '{CUT}')"
INCOMING = "(SELECT * FROM listings WHERE updated_at >= TIMESTAMP '2000-06-01 00:00:00')"


@query("first_per_key", "raw_ads", f"SELECT ad_id, source, price, seen_at FROM {FIRST} f")
def _(spark, sf):
    return _first_sighting(spark, sf).select("ad_id", "source", "price", "seen_at")


def _stored(spark, sf):
    """The table before the run: first sightings before the cut, without history."""
    return (
        _first_sighting(spark, sf)
        .filter(F.col("seen_at") < F.to_timestamp(F.lit(CUT)))
        .select(
            "source", "external_id", F.col("ad_id").alias("listing_id"), "brand", "model", "year", "mileage", "price",
            "body_type", "city", "url",
            F.col("seen_at").alias("created_at"), F.col("seen_at").alias("updated_at"),
            F.lit(None).cast("array<struct<price:int,date:date>>").alias("price_history"),
        )
    )


def _incoming(spark, sf):
    """The run: current state of every ad seen since mid 2000."""
    return (
        D.listings(spark, sf)
        .filter(F.col("updated_at") >= F.to_timestamp(F.lit("2000-06-01 00:00:00")))
        .select("source", "external_id", "listing_id", "brand", "model", "year", "mileage", "price", "body_type", "city", "url")
    )


@query(
    "upsert_classify",
    "raw_ads listings",
    f"""
SELECT i.external_id, i.price, s.price AS old_price,
  CASE WHEN s.price IS NULL THEN 'new' WHEN s.price <> i.price THEN 'price_changed' ELSE 'unchanged' END AS change
FROM {INCOMING} i LEFT JOIN {STORED} s ON s.source = i.source AND s.external_id = i.external_id
""",
)
def _(spark, sf):
    return upsert.upsert_classify(_incoming(spark, sf), _stored(spark, sf)).select("external_id", "price", "old_price", "change")


@query(
    "join_existing_keys",
    "raw_ads listings",
    f"""
SELECT i.source, count(*) AS known FROM {INCOMING} i JOIN {STORED} s
  ON s.source = i.source AND s.external_id = i.external_id GROUP BY i.source
""",
)
def _(spark, sf):
    known = _incoming(spark, sf).join(_stored(spark, sf).select("source", "external_id"), ["source", "external_id"])
    return known.groupBy("source").agg(F.count("*").alias("known"))


@query(
    "upsert_apply",
    "raw_ads listings",
    f"""
SELECT coalesce(s.external_id, i.external_id) AS external_id,
  coalesce(i.price, s.price) AS price,
  CASE WHEN s.ad_id IS NULL THEN i.brand ELSE s.brand END AS brand,
  CASE WHEN s.ad_id IS NULL THEN i.mileage ELSE s.mileage END AS mileage,
  coalesce(s.seen_at, {AS_OF}) AS created_at,
  CASE WHEN i.listing_id IS NULL THEN s.seen_at ELSE {AS_OF} END AS updated_at,
  CASE WHEN s.price <> i.price THEN CAST(s.price AS VARCHAR) || '@' || CAST({DATE} AS VARCHAR) ELSE '' END AS history
FROM {STORED} s FULL JOIN {INCOMING} i ON s.source = i.source AND s.external_id = i.external_id
""",
)
def _(spark, sf):
    merged = upsert.upsert_apply(_incoming(spark, sf), _stored(spark, sf), D.as_of())
    points = F.transform(
        F.coalesce("price_history", F.array().cast("array<struct<price:int,date:date>>")),
        lambda h: F.concat(h["price"].cast("string"), F.lit("@"), h["date"].cast("string")),
    )
    return merged.select(
        "external_id", "price", "brand", "mileage", "created_at", "updated_at", F.array_join(points, ",").alias("history")
    )


@query(
    "upsert_metrics",
    "raw_ads listings",
    f"""
SELECT i.source, count(*) AS total_fetched, count(*) FILTER (WHERE s.price IS NULL) AS new_saved,
  count(*) FILTER (WHERE s.price = i.price) AS duplicates_skipped,
  count(*) FILTER (WHERE s.price <> i.price) AS prices_updated
FROM {INCOMING} i LEFT JOIN {STORED} s ON s.source = i.source AND s.external_id = i.external_id GROUP BY i.source
""",
)
def _(spark, sf):
    incoming = _incoming(spark, sf)
    return upsert.upsert_metrics(incoming, upsert.upsert_classify(incoming, _stored(spark, sf)))


@query(
    "fetch_efficiency",
    None,
    """
SELECT event_type, count(*) AS total_fetched, count(*) FILTER (WHERE value > 100) AS captchas_hit,
  round(count(*) / nullif(count(*) FILTER (WHERE value > 100), 0), 4) AS per_captcha
FROM events GROUP BY event_type
""",
)
def _(spark, sf):
    runs = D.table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("total_fetched"), F.count_if(F.col("value") > 100).alias("captchas_hit")
    )
    rate = upsert.fetch_efficiency(F.col("total_fetched"), F.col("captchas_hit"))
    return runs.withColumn("per_captcha", F.round(rate, 4))


@query(
    "unseen_ads",
    "raw_ads listings",
    f"""
SELECT listing_id, price FROM listings l WHERE NOT EXISTS
  (SELECT 1 FROM {FIRST} f WHERE f.ad_id = l.listing_id AND f.price = l.price)
""",
)
def _(spark, sf):
    seen = _first_sighting(spark, sf).select(F.col("ad_id").alias("listing_id"), "price")
    return upsert.unseen_ads(D.listings(spark, sf), seen).select("listing_id", "price")


@query(
    "needs_detail",
    "raw_ads listings",
    f"""
SELECT i.listing_id FROM {INCOMING} i WHERE NOT EXISTS
  (SELECT 1 FROM {STORED} s WHERE s.source = i.source AND s.external_id = i.external_id AND s.body_type IS NOT NULL)
""",
)
def _(spark, sf):
    return upsert.needs_detail(_incoming(spark, sf), _stored(spark, sf)).select("listing_id")


@query(
    "fill_missing_fields",
    "listings",
    """
SELECT listing_id, coalesce(nullif(body_type, 'suv'), 'crossover') AS body_type, coalesce(mileage, 77) AS mileage,
  coalesce(transmission, 'filled') AS transmission
FROM listings
""",
)
def _(spark, sf):
    listings = D.listings(spark, sf)
    stored = listings.withColumn("body_type", F.when(F.col("body_type") == "suv", "unknown").otherwise(F.col("body_type")))
    enriched = listings.select(
        "listing_id", F.lit("crossover").alias("body_type"), F.lit(77).alias("mileage"), F.lit("filled").alias("transmission")
    )
    out = upsert.fill_missing_fields(stored, enriched, "listing_id", ["body_type", "mileage", "transmission"])
    return out.select("listing_id", "body_type", "mileage", "transmission")


@query(
    "sink_listings_upsert",
    "raw_ads listings",
    f"""
SELECT coalesce(s.source, i.source) AS source, count(*) AS listings, sum(coalesce(i.price, s.price))::BIGINT AS price_sum,
  count(*) FILTER (WHERE s.price <> i.price) AS with_history
FROM {STORED} s FULL JOIN {INCOMING} i ON s.source = i.source AND s.external_id = i.external_id GROUP BY 1
""",
)
def _(spark, sf):
    import uuid

    from kerbside.common import shared_folder
    from kerbside.sources.bucketed import BucketTable

    table = BucketTable(spark, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}")
    table.create(_stored(spark, sf), upsert.KEYS)
    table.merge(_incoming(spark, sf), lambda new, old: upsert.upsert_apply(new, old, D.as_of()))
    return table.read().groupBy("source").agg(
        F.count("*").alias("listings"),
        F.sum("price").alias("price_sum"),
        F.count_if(F.size(F.coalesce("price_history", F.array().cast("array<struct<price:int,date:date>>"))) > 0).alias("with_history"),
    )


@query(
    "sink_analysis_upsert",
    "analysis",
    """
SELECT listing_id, category, CASE WHEN listing_id % 2 = 0 THEN confidence ELSE 0.9 END::DOUBLE AS confidence
FROM analysis
""",
)
def _(spark, sf):
    every = D.analysis(spark, sf)
    stored = every.filter(F.col("listing_id") % 2 == 0)
    incoming = every.withColumn("confidence", F.lit(0.9))
    return lifecycle.insert_analysis(stored, incoming).select("listing_id", "category", "confidence")


# ------------------------------------------------------------------ dedup and lifecycle
@query(
    "cross_source_dedup",
    "marked",
    "SELECT listing_id, source, canonical_id, is_duplicate FROM marked",
)
def _(spark, sf):
    return dedup.cross_source_dedup(D.listings(spark, sf)).select("listing_id", "source", "canonical_id", "is_duplicate")


@query(
    "win_canonical_first",
    "listings",
    """
SELECT brand, model, year, city, price, mileage, min(listing_id) FILTER (WHERE rn = 1) AS canonical_id, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY brand, model, year, city, price, mileage ORDER BY created_at, listing_id) AS rn
   FROM listings) t GROUP BY brand, model, year, city, price, mileage HAVING count(*) > 1
""",
)
def _(spark, sf):
    keys = ["brand", "model", "year", "city", "price", "mileage"]
    first = F.min(F.struct("created_at", "listing_id"))
    return (
        D.listings(spark, sf).groupBy(*keys).agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1")
        .select(*keys, F.col("f.listing_id").alias("canonical_id"), "n")
    )


GROUPS = """SELECT coalesce(canonical_id, listing_id) AS group_id, listing_id, canonical_id IS NULL AS is_canonical,
  count(*) OVER (PARTITION BY coalesce(canonical_id, listing_id)) AS group_size FROM marked"""


@query("duplicate_group_of", "marked", f"SELECT * FROM ({GROUPS}) t WHERE group_size > 1")
def _(spark, sf):
    return dedup.duplicate_membership(D.marked(spark, sf))


@query(
    "duplicate_self_join",
    "marked",
    """
SELECT d.listing_id AS asked_id, o.listing_id AS other_id, o.price FROM marked d
JOIN marked o ON coalesce(o.canonical_id, o.listing_id) = d.canonical_id AND o.listing_id <> d.listing_id
WHERE d.is_duplicate
""",
)
def _(spark, sf):
    marked = D.marked(spark, sf)
    wanted = marked.filter("is_duplicate").select("listing_id")
    return dedup.duplicate_group_of(marked, wanted).select("asked_id", F.col("listing_id").alias("other_id"), "price")


@query(
    "mark_stale",
    "marked",
    f"""
SELECT listing_id, s AS is_stale, s OR is_duplicate AS is_hidden FROM (SELECT *, updated_at < {AS_OF} - INTERVAL 400 DAY
  AND created_at < {AS_OF} - INTERVAL 400 DAY AND NOT is_duplicate AS s FROM marked) t
""",
)
def _(spark, sf):
    return lifecycle.mark_stale(D.marked(spark, sf), D.as_of(), 400).select("listing_id", "is_stale", "is_hidden")


@query(
    "unenriched_listings",
    "marked",
    """
SELECT listing_id, url, brand, model, created_at FROM marked
WHERE source = 'src_a' AND NOT is_duplicate AND (body_type IS NULL OR body_type = 'unknown') AND url <> ''
ORDER BY created_at DESC NULLS LAST, listing_id LIMIT 200
""",
)
def _(spark, sf):
    return lifecycle.unenriched_listings(D.marked(spark, sf), "src_a", 200).select(
        "listing_id", "url", "brand", "model", "created_at"
    )


def _described(spark, sf):
    return D.marked(spark, sf).join(D.documents(spark, sf), "doc_id", "left")


@query(
    "analysis_backlog",
    "marked analysis",
    """
SELECT count(*) AS backlog FROM marked m LEFT JOIN documents d USING (doc_id)
WHERE NOT is_duplicate AND d.text <> '' AND NOT EXISTS (SELECT 1 FROM analysis a WHERE a.listing_id = m.listing_id)
""",
)
def _(spark, sf):
    return lifecycle.analysis_backlog(_described(spark, sf), D.analysis(spark, sf))


@query(
    "join_backlog_anti",
    "marked analysis",
    """
SELECT m.source, count(*) AS backlog FROM marked m LEFT JOIN documents d USING (doc_id)
WHERE d.text <> '' AND NOT EXISTS (SELECT 1 FROM analysis a WHERE a.listing_id = m.listing_id) GROUP BY m.source
""",
)
def _(spark, sf):
    left = lifecycle.described_without_analysis(_described(spark, sf), D.analysis(spark, sf), include_duplicates=True)
    return left.groupBy("source").agg(F.count("*").alias("backlog"))


@query(
    "analysis_candidates",
    "marked analysis",
    """
SELECT m.listing_id, m.title || chr(10) || d.text AS text, m.price, m.created_at
FROM marked m JOIN documents d USING (doc_id)
WHERE NOT is_duplicate AND d.text <> '' AND NOT EXISTS (SELECT 1 FROM analysis a WHERE a.listing_id = m.listing_id)
ORDER BY m.created_at DESC NULLS LAST, m.listing_id LIMIT 50
""",
)
def _(spark, sf):
    return lifecycle.analysis_candidates(_described(spark, sf), D.analysis(spark, sf), 50)


@query(
    "analysis_run_metrics",
    None,
    """
WITH w AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events
  GROUP BY event_type, user_id)
SELECT count(*) AS workers, sum(n)::BIGINT AS total_processed, sum(bad)::BIGINT AS total_failed,
  (SELECT string_agg(e, '|') FROM (SELECT 'bad ' || event_type || ' ' || CAST(user_id AS VARCHAR) AS e FROM w WHERE bad > 0
    ORDER BY event_type || '-' || CAST(user_id AS VARCHAR) LIMIT 10) t) AS errors
FROM w
""",
)
def _(spark, sf):
    events = D.table(spark, sf, "events")
    failed = F.count_if(F.col("event_type") == "error")
    workers = events.groupBy("event_type", "user_id").agg(F.count("*").alias("processed"), failed.alias("failed"))
    named = workers.select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("worker_name"), "processed", "failed",
        F.when(F.col("failed") > 0, F.array(F.concat_ws(" ", F.lit("bad"), "event_type", F.col("user_id").cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    return lifecycle.analysis_run_metrics(named).select(
        "workers", "total_processed", "total_failed", F.array_join("total_errors", "|").alias("errors")
    )


# ------------------------------------------------------------------ ad filters
def _ads(spark, sf):
    """Current ads with the columns the filter chain reads."""
    return (
        D.listings(spark, sf)
        .join(D.documents(spark, sf), "doc_id", "left")
        .select(
            "listing_id", "price", "title", "description",
            F.concat(F.col("city"), F.lit(", Main street")).alias("address"),
            F.when(F.col("listing_id") % 3 != 0, F.concat(F.lit("shop-"), (F.col("listing_id") % 13).cast("string"))).alias("seller_id"),
            F.col("updated_at").alias("published"),
            (F.col("listing_id") % 11 == 0).alias("is_reserved"),
            (F.col("listing_id") % 4 == 0).alias("is_promoted"),
        )
    )


ADS = """(SELECT l.listing_id, l.price, lower(coalesce(title, '') || coalesce(d.text, '')) AS body, city || ', Main street' AS address,
  CASE WHEN listing_id % 3 <> 0 THEN 'shop-' || CAST(listing_id % 13 AS VARCHAR) END AS seller_id, updated_at AS published,
  listing_id % 11 = 0 AS is_reserved, listing_id % 4 = 0 AS is_promoted
  FROM listings l LEFT JOIN documents d USING (doc_id))"""
BLACK, WHITE = ["thintion", "INGING"], ["brand#1", "Brand#2"]
IN_PRICE = "price BETWEEN 100000 AND 1500000"
NOT_BLACK = "NOT (contains(body, 'thintion') OR contains(body, 'inging'))"
IS_WHITE = "(contains(body, 'brand#1') OR contains(body, 'brand#2'))"
AT_GEO = "contains(address, 'NATION_1')"
SELLER_OK = "(seller_id IS NULL OR seller_id NOT IN ('shop-1', 'shop-5'))"
RECENT = f"date_diff('second', published, {AS_OF}) <= 86400 * 1500"


@query("filter_price_range", "listings", f"SELECT listing_id, price FROM listings WHERE {IN_PRICE}")
def _(spark, sf):
    return D.listings(spark, sf).filter(A.in_price_range(100_000, 1_500_000)).select("listing_id", "price")


@query("filter_black_keywords", "listings", f"SELECT listing_id FROM {ADS} t WHERE {NOT_BLACK}")
def _(spark, sf):
    return _ads(spark, sf).filter(A.without_phrases(BLACK)).select("listing_id")


@query("filter_white_keywords", "listings", f"SELECT listing_id FROM {ADS} t WHERE {IS_WHITE}")
def _(spark, sf):
    return _ads(spark, sf).filter(A.with_phrases(WHITE)).select("listing_id")


@query("filter_address", "listings", f"SELECT listing_id FROM {ADS} t WHERE {AT_GEO}")
def _(spark, sf):
    return _ads(spark, sf).filter(A.at_address("NATION_1", F.col("address"))).select("listing_id")


@query("filter_seller_blacklist", "listings", f"SELECT listing_id FROM {ADS} t WHERE {SELLER_OK}")
def _(spark, sf):
    blocked = D.table(spark, sf, "supplier").filter(F.col("s_suppkey").isin(1, 5)).select(
        F.concat(F.lit("shop-"), F.col("s_suppkey").cast("string")).alias("seller_id")
    )
    return A.drop_blocked_sellers(_ads(spark, sf), blocked).select("listing_id")


@query("filter_recent", "listings", f"SELECT listing_id FROM {ADS} t WHERE {RECENT}")
def _(spark, sf):
    return _ads(spark, sf).filter(A.recent(86_400 * 1500, F.col("published"), D.as_of())).select("listing_id")


@query("filter_reserved", "listings", f"SELECT listing_id FROM {ADS} t WHERE NOT is_reserved")
def _(spark, sf):
    return _ads(spark, sf).filter(A.not_reserved(F.col("is_reserved"))).select("listing_id")


@query("filter_promoted", "listings", f"SELECT listing_id FROM {ADS} t WHERE NOT is_promoted")
def _(spark, sf):
    return _ads(spark, sf).filter(A.not_promoted(F.col("is_promoted"))).select("listing_id")


SETTINGS = A.AdFilter(
    min_price=100_000, max_price=1_500_000, black_words=BLACK, white_words=WHITE, geo="NATION_1",
    blocked_sellers=["shop-1", "shop-5"], max_age_seconds=86_400 * 1500, ignore_reserved=True, ignore_promoted=True,
)
UNSEEN = f"NOT EXISTS (SELECT 1 FROM {FIRST} f WHERE f.ad_id = t.listing_id AND f.price = t.price)"
CHAIN = [UNSEEN, IN_PRICE, NOT_BLACK, IS_WHITE, AT_GEO, SELLER_OK, RECENT, "NOT is_reserved", "NOT is_promoted"]


def _seen(spark, sf):
    # the price and what decides between equal sightings before it
    columns = ["ad_id", "source", "brand", "model", "year", "mileage", "price", "seen_at", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return _first_sighting(spark, sf, columns).select(F.col("ad_id").alias("listing_id"), "price")


@query("ads_filter_chain", "raw_ads listings", f"SELECT listing_id, price FROM {ADS} t WHERE {' AND '.join(CHAIN)}")
def _(spark, sf):
    return A.ads_filter_chain(_ads(spark, sf), SETTINGS, D.as_of(), _seen(spark, sf)).select("listing_id", "price")


_STEP_NAMES = ["viewed", "price", "black_words", "white_words", "address", "seller", "recent", "reserved", "promoted"]


@query(
    "ads_filter_counts",
    "raw_ads listings",
    "SELECT count(*) AS fetched, "
    + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(CHAIN[: i + 1])}) AS after_{n}" for i, n in enumerate(_STEP_NAMES)).replace(
        UNSEEN, "unseen"
    )
    + f" FROM (SELECT *, {UNSEEN} AS unseen FROM {ADS} t) t",
)
def _(spark, sf):
    return A.ads_filter_counts(_ads(spark, sf), SETTINGS, D.as_of(), _seen(spark, sf))


@query(
    "red_flag_filter",
    "marked analysis text_flags",
    """
SELECT listing_id FROM marked LEFT JOIN analysis USING (listing_id) LEFT JOIN text_flags USING (doc_id)
WHERE coalesce(category, '') NOT IN ('damaged_body', 'bad_docs', 'debtor') AND NOT coalesce(bars_training, false)
""",
)
def _(spark, sf):
    rows = D.marked(spark, sf).join(D.analysis(spark, sf), "listing_id", "left").join(D.documents(spark, sf), "doc_id", "left")
    return A.red_flag_filter(rows, D.FIXTURE_TRAINING_FLAGS).select("listing_id")


@query(
    "city_region_from_url",
    "listings",
    """
SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Санкт-Петербург' WHEN 2 THEN 'Казань'
  ELSE 'Elsewhere' END AS city, CASE listing_id % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Санкт-Петербург'
  WHEN 2 THEN 'Республика Татарстан' END AS region FROM listings
""",
)
def _(spark, sf):
    from kerbside.functions.text import city_from_url, region_from_url

    pages = D.listings(spark, sf).withColumn("page", card_url())
    return pages.select(
        "listing_id", city_from_url(F.col("page"), "cars.example").alias("city"),
        region_from_url(F.col("page"), "cars.example").alias("region"),
    )
