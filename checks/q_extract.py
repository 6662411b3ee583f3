"""Extraction from pages, catalogue blobs and offers; exports of catalogue items."""

from pyspark.sql import functions as F

from checks.registry import query
from kerbside.operators import extract as X
from kerbside.sources import driver_tables as D
from kerbside.sources import rendered as RD
from kerbside.sources import writers as W

SLUG_CITY = """CASE listing_id % 4 WHEN 0 THEN 'Москва' WHEN 1 THEN 'Санкт-Петербург' WHEN 2 THEN 'Казань' ELSE 'Elsewhere' END"""
SLUG = "CASE listing_id % 4 WHEN 0 THEN 'moscow' WHEN 1 THEN 'spb' WHEN 2 THEN 'kazan' ELSE 'elsewhere' END"
CARD = f"""'https://auto.cars.example/' || {SLUG} || '/' || lower(replace(brand, '#', '')) || '/' || lower(replace(model, ' ', ''))
  || '/' || external_id || '.html'"""
DAY = "strftime(listing_date, '%Y-%m-%d')"
LITRES = "CASE WHEN engine_volume IS NULL THEN 2.5 ELSE engine_volume END::DOUBLE"
PHOTO = "'https://s1.cars.example/photo/' || external_id"
CARD_COLUMNS = [
    "external_id", "brand", "model", "year", "price", "mileage", "vin", "description", "city", "engine_type", "engine_volume",
    "power_hp", "transmission", "drive_type", "body_type", "owners_count", "customs_cleared", "seller_type", "seller_name",
    "is_dealer", "listing_date", "photo_count",
]
CAR_SQL = f"""
SELECT external_id, brand, model, year, price, mileage, 'VIN' || external_id AS vin, 'About "' || title || '"' AS description,
  {SLUG_CITY} AS city, 'бензин' AS engine_type, {LITRES} AS engine_volume, coalesce(power_hp, 75) AS power_hp,
  coalesce(trim(transmission), '') AS transmission, coalesce(drive_type, '') AS drive_type, coalesce(body_type, '') AS body_type,
  owners_count, listing_id % 2 = 0 AS customs_cleared, CASE WHEN is_dealer THEN 'дилер' ELSE 'частное лицо' END AS seller_type,
  CASE WHEN is_dealer THEN 'Auto House' END AS seller_name, is_dealer, {DAY} AS listing_date,
  CASE WHEN photo_count > 7 THEN 2 ELSE 1 END AS photo_count
FROM listings WHERE listing_id % 3 <> 0
"""
STATE_SQL = f"""
SELECT external_id, brand, model, year, price, mileage, CAST(NULL AS VARCHAR) AS vin, CAST(NULL AS VARCHAR) AS description,
  {SLUG_CITY} AS city, 'дизель' AS engine_type, {LITRES} AS engine_volume, 150 AS power_hp, nullif(transmission, '') AS transmission,
  CAST(NULL AS VARCHAR) AS drive_type, body_type, owners_count, CAST(NULL AS BOOLEAN) AS customs_cleared,
  CASE WHEN is_dealer THEN 'дилер' END AS seller_type, 'Shop' AS seller_name, is_dealer, {DAY} AS listing_date, 0 AS photo_count
FROM listings WHERE listing_id % 3 = 0
"""


@query("extract_jsonld_car", "listings", CAR_SQL)
def _(spark, sf):
    return X.extract_jsonld_car(RD.card_pages(spark, sf)).select(*CARD_COLUMNS)


@query("extract_preloaded_state", "listings", STATE_SQL)
def _(spark, sf):
    return X.extract_preloaded_state(RD.card_pages(spark, sf)).select(*CARD_COLUMNS)


@query("extract_cards", "listings", f"SELECT external_id, brand, price, engine_type FROM ({CAR_SQL} UNION ALL {STATE_SQL}) t")
def _(spark, sf):
    return X.extract_cards(RD.card_pages(spark, sf)).select("external_id", "brand", "price", "engine_type")


@query(
    "extract_spec_table",
    "listings",
    f"""
SELECT listing_id AS page_id, key, value FROM (
  SELECT listing_id, 'Двигатель' AS key, 'бензин, ' || CASE WHEN engine_volume IS NULL THEN '2,5'
    ELSE CAST(CAST(engine_volume AS DECIMAL(3,1)) AS VARCHAR) END || ' л' AS value FROM listings
  UNION ALL SELECT listing_id, 'Мощность', CAST(coalesce(power_hp, 75) AS VARCHAR) || ' л.с.,налог' FROM listings
  UNION ALL SELECT listing_id, 'Коробка передач', coalesce(trim(transmission), '') FROM listings
  UNION ALL SELECT listing_id, 'Привод', coalesce(drive_type, '') FROM listings
  UNION ALL SELECT listing_id, 'Тип кузова', coalesce(body_type, '') FROM listings
  UNION ALL SELECT listing_id, 'Владельцы', CAST(owners_count AS VARCHAR) || ' и более' FROM listings
  UNION ALL SELECT listing_id, 'Растаможен', CASE WHEN listing_id % 2 = 0 THEN 'Да' ELSE 'нет' END FROM listings
) t WHERE listing_id % 3 <> 0
""",
)
def _(spark, sf):
    return RD.card_pages(spark, sf).select("page_id", F.explode(X.spec_table(F.col("html"))))


@query("extract_card_links", "listings", f"SELECT external_id AS ad_id, CAST(floor(listing_id / 500) AS BIGINT) AS page_id, {CARD} AS url FROM listings")
def _(spark, sf):
    return X.extract_card_links(RD.list_pages(spark, sf))


@query(
    "extract_card_links_capped",
    "listings",
    f"""
SELECT external_id AS ad_id, CAST(floor(listing_id / 500) AS BIGINT) AS page_id, {CARD} AS url FROM
  (SELECT *, row_number() OVER (PARTITION BY floor(listing_id / 500) ORDER BY listing_id) AS rn FROM listings) t WHERE rn <= 20
""",
)
def _(spark, sf):
    return X.extract_card_links(RD.list_pages(spark, sf), max_cards=20)


@query(
    "page_links",
    None,
    """
SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) t GROUP BY href
""",
)
def _(spark, sf):
    return X.page_links(D.table(spark, sf, "pages")).groupBy("href").agg(F.count("*").alias("n"))


@query(
    "page_title",
    None,
    r"""
SELECT page_id, regexp_replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'),
  '&amp;', '&'), '^\s+|\s+$', '', 'g') AS title FROM pages
""",
)
def _(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", X.page_title(F.col("html")).alias("title"))


@query("extract_photos_card", "listings", f"""
SELECT listing_id AS page_id, CASE WHEN photo_count > 7 AND listing_id % 3 <> 0 THEN {PHOTO} || '_1.jpg,' || {PHOTO} || '_2.jpg' ELSE '' END AS photos
FROM listings""")
def _(spark, sf):
    return RD.card_pages(spark, sf).select("page_id", F.array_join(X.card_photos(F.col("html")), ",").alias("photos"))


# ------------------------------------------------------------------ detail pages
@query(
    "extract_attribute_blocks",
    "listings",
    f"""
SELECT listing_id AS page_id, key, value FROM (
  SELECT listing_id, 'mileage_raw' AS key, replace(format('{{:,}}', mileage), ',', ',') || ' км' AS value FROM listings WHERE mileage IS NOT NULL
  UNION ALL SELECT listing_id, 'transmission', trim(transmission) FROM listings WHERE transmission IS NOT NULL
  UNION ALL SELECT listing_id, 'drive_type', drive_type FROM listings WHERE drive_type IS NOT NULL
  UNION ALL SELECT listing_id, 'engine_raw', CASE WHEN engine_volume IS NULL THEN '1,6' ELSE CAST(CAST(engine_volume AS DECIMAL(3,1)) AS VARCHAR) END
    || ' л / ' || CAST(coalesce(power_hp, 90) AS VARCHAR) || ' л.с. / Бензин' FROM listings
  UNION ALL SELECT listing_id, 'owners_raw', CAST(owners_count AS VARCHAR) || ' владельца' FROM listings
  UNION ALL SELECT listing_id, 'customs_raw', CASE WHEN listing_id % 2 = 0 THEN 'Да' ELSE 'Нет' END FROM listings
  UNION ALL SELECT listing_id, 'body_type', coalesce(body_type, 'unknown') FROM listings) t
""",
)
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", F.explode(X.attribute_fields(F.col("html"))))


@query("extract_unmapped_attributes", "listings", "SELECT listing_id AS page_id, 'Особая метка' AS key, 'm' || CAST(listing_id % 5 AS VARCHAR) AS value FROM listings")
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", F.explode(X.extract_unmapped_attributes(F.col("html"))))


@query(
    "extract_description",
    "listings",
    """SELECT listing_id AS page_id, 'First line of ' || external_id || chr(10) || 'and a "quoted" word' AS description FROM listings""",
)
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", X.extract_description(F.col("html")).alias("description"))


IMG = "'https://00.img.cars.example/image/1/' || external_id"


@query("extract_photos", "listings", f"SELECT listing_id AS page_id, {IMG} || '.big,' || {IMG} || '.2' AS photos FROM listings")
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", F.array_join(X.extract_photos(F.col("html")), ",").alias("photos"))


@query(
    "extract_seller",
    "listings",
    """
SELECT listing_id AS page_id, 'Seller ' || CAST(listing_id % 10 AS VARCHAR) AS name, CASE WHEN is_dealer THEN 'dealer' ELSE 'private' END AS type,
  false AS is_dealer, CAST(listing_id % 1000 AS VARCHAR) AS id, '4.5' AS rating, CAST(listing_id % 7 AS VARCHAR) AS reviews_count FROM listings
""",
)
def _(spark, sf):
    seller = RD.detail_pages(spark, sf).select("page_id", X.extract_seller(F.col("html")).alias("s"))
    return seller.select("page_id", "s.name", "s.type", "s.is_dealer", "s.id", "s.rating", "s.reviews_count")


@query("extract_location", "listings", "SELECT listing_id AS page_id, city, 'Region' AS region FROM listings")
def _(spark, sf):
    place = RD.detail_pages(spark, sf).select("page_id", X.extract_location(F.col("html")).alias("l"))
    return place.select("page_id", "l.city", "l.region")


@query(
    "extract_listing_date",
    "listings",
    "SELECT listing_id AS page_id, strftime(make_timestamp((1600000000 + listing_id) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published FROM listings",
)
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", X.extract_listing_date(F.col("html")).alias("published"))


@query("extract_price_estimate", "listings", "SELECT listing_id AS page_id, price + 5000 AS estimate FROM listings")
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", X.extract_price_estimate(F.col("html")).alias("estimate"))


@query(
    "extract_view_counts",
    "listings",
    "SELECT listing_id AS page_id, CAST(listing_id % 1000 AS INTEGER) AS total_views, CAST(listing_id % 10 AS INTEGER) AS today_views FROM listings",
)
def _(spark, sf):
    views = RD.detail_pages(spark, sf).select("page_id", X.extract_view_counts(F.col("html")).alias("v"))
    return views.select("page_id", "v.total_views", "v.today_views")


@query("extract_seller_slug", "listings", "SELECT listing_id AS page_id, 'shop-' || CAST(listing_id % 13 AS VARCHAR) AS slug FROM listings")
def _(spark, sf):
    return RD.detail_pages(spark, sf).select("page_id", X.extract_seller_slug(F.col("html")).alias("slug"))


@query(
    "enrich_from_detail",
    "listings",
    """
SELECT listing_id, coalesce(mileage, CAST(NULL AS INTEGER)) AS mileage, coalesce(nullif(transmission, ''), 'x') AS transmission,
  coalesce(engine_volume, 1.6) AS engine_volume, coalesce(power_hp, 90) AS power_hp, owners_count,
  coalesce(body_type, 'unknown') AS body_type, 'Бензин' AS engine_type, price + 5000 AS source_estimate, 2 AS photo_count
FROM (SELECT * REPLACE (CASE WHEN listing_id % 2 = 0 THEN transmission ELSE trim(transmission) END AS transmission) FROM listings) t
""",
)
def _(spark, sf):
    ads = D.listings(spark, sf).select(
        "listing_id", F.col("listing_id").alias("page_id"),
        F.when(F.col("listing_id") % 3 == 0, F.col("mileage")).alias("mileage"),
        F.when(F.col("listing_id") % 2 == 0, F.col("transmission")).alias("transmission"),
        "engine_volume", "power_hp", F.lit(None).cast("int").alias("owners_count"), "body_type", "is_dealer",
    )
    out = X.enrich_from_detail(ads, RD.detail_pages(spark, sf))
    return out.select(
        "listing_id", "mileage", F.coalesce("transmission", F.lit("x")).alias("transmission"), "engine_volume", "power_hp",
        "owners_count", "body_type", "engine_type", "source_estimate", "photo_count",
    )


# ------------------------------------------------------------------ catalogue and offers
def _items(spark, sf):
    return X.scan_catalogue_items(RD.catalogue_pages(spark, sf))


@query("scan_catalogue_items", "listings", "SELECT CAST(floor(listing_id / 500) AS BIGINT) AS page_id, listing_id AS id, title, CAST(price AS BIGINT) AS price FROM listings WHERE listing_id % 50 <> 0")
def _(spark, sf):
    return _items(spark, sf).select("page_id", "item.id", "item.title", F.col("item.priceDetailed.value").alias("price"))


@query("flag_promoted", "listings", "SELECT listing_id AS id, listing_id % 4 = 0 AS is_promoted FROM listings WHERE listing_id % 50 <> 0")
def _(spark, sf):
    return _items(spark, sf).select("item.id", X.flag_promoted(F.col("item")).alias("is_promoted"))


@query("largest_image", "listings", "SELECT listing_id AS id, 'https://i.example/l/' || external_id AS image FROM listings WHERE listing_id % 50 <> 0")
def _(spark, sf):
    return _items(spark, sf).select("item.id", X.largest_image(F.get("item.images", 0)).alias("image"))


@query(
    "item_to_ad",
    "listings",
    """
SELECT external_id, brand, model, year, price, 'https://cars.example/cars/' || external_id AS url, city, 'https://i.example/m/' || external_id AS photos
FROM listings WHERE listing_id % 50 <> 0
""",
)
def _(spark, sf):
    ads = X.item_to_ad(_items(spark, sf))
    return ads.select("external_id", "brand", "model", "year", "price", "url", "city", F.array_join("photos", ",").alias("photos"))


@query(
    "export_ads_sheet",
    "listings",
    """
SELECT title, CAST(price AS BIGINT) AS price, 'https://cars.example//cars/' || external_id AS url,
  CASE WHEN listing_id % 9 = 0 THEN '''=SUM(A1)' ELSE 'text ' || external_id END AS description, created_at AS published,
  CASE WHEN listing_id % 3 = 0 THEN 'shop-' || CAST(listing_id % 13 AS VARCHAR) ELSE '' END AS seller, city AS address,
  'at ' || city AS user_address, CAST(listing_id % 90 AS VARCHAR) || ';' || CAST(listing_id % 180 AS VARCHAR) AS coordinates,
  'https://i.example/l/' || external_id AS images, CASE WHEN listing_id % 4 = 0 THEN 'Да' ELSE 'Нет' END AS promoted,
  CAST(nullif(listing_id % 7, 0) AS INTEGER) AS total_views, CAST(NULL AS INTEGER) AS today_views,
  CASE WHEN listing_id % 5 = 0 THEN '''+7 (900) 123-45-67' ELSE '' END AS phone
FROM listings WHERE listing_id % 50 <> 0
""",
)
def _(spark, sf):
    items = _items(spark, sf)
    full = items.select(
        "item", X.extract_seller_slug(F.col("item.userLogo.link")).alias("seller_id"), X.flag_promoted(F.col("item")).alias("is_promoted"),
        (F.col("item.id") % 7).cast("int").alias("total_views"), F.lit(None).cast("int").alias("today_views"),
    )
    return W.ads_sheet(full)


@query(
    "export_partitioned_by_link",
    None,
    """
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) || '_' || substr(md5(url), 1, 10) AS link_key, count(*) AS n FROM pages GROUP BY 1
""",
)
def _(spark, sf):
    import uuid

    from kerbside.common import shared_folder

    path = f"{shared_folder(spark)}/by_link/{uuid.uuid4().hex}"
    pages = D.table(spark, sf, "pages").select("page_id", "url")
    W.export_partitioned_by_link(pages, path, link="url")
    return spark.read.parquet(path).groupBy("link_key").agg(F.count("*").alias("n"))


@query(
    "flatten_offer_json",
    "listings",
    """
SELECT external_id, brand, model, year, price,
  'https://cars.example/cars/used/sale/' || lower(brand) || '/' || lower(model) || '/' || external_id || '/' AS url, mileage,
  upper(engine_type) AS engine_type, CASE WHEN listing_id % 3 = 0 THEN engine_volume END AS engine_volume, power_hp, transmission,
  drive_type, body_type, 'black' AS color, owners_count, is_dealer, strftime(listing_date + INTERVAL 3650 DAY, '%Y-%m-%d') AS listing_date, city,
  city AS region, 'II' AS generation, 5 AS photo_count
FROM listings WHERE listing_id % 40 <> 0
""",
)
def _(spark, sf):
    return X.flatten_offer_json(RD.offers(spark, sf)).select(
        "external_id", "brand", "model", "year", "price", "url", "mileage", "engine_type", "engine_volume", "power_hp",
        "transmission", "drive_type", "body_type", "color", "owners_count", "is_dealer", "listing_date", "city", "region",
        "generation", "photo_count",
    )
