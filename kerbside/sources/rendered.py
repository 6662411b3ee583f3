"""Pages, offers and model answers rendered from the given tables.

The given pages hold no vehicle data, so Spark writes the carriers itself: one card page, detail page, catalogue
item and offer per listing, one model answer per labelled document. Reading them back must give the listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.sources import driver_tables as tables

CITY_SLUGS = ["moscow", "spb", "kazan", "elsewhere"]


def slug(column: Column) -> Column:
    return F.lower(F.regexp_replace(column, r"[^A-Za-z0-9_]", ""))


def _row(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"<tr><th>{key}</th><td> "), F.coalesce(value.cast("string"), F.lit("")), F.lit("</td></tr>\n"))


def card_url() -> Column:
    city = F.element_at(F.array(*[F.lit(c) for c in CITY_SLUGS]), (F.col("listing_id") % 4 + 1).cast("int"))
    return F.concat(
        F.lit("https://auto.cars.example/"), city, F.lit("/"), slug(F.col("brand")), F.lit("/"), slug(F.col("model")),
        F.lit("/"), F.col("external_id"), F.lit(".html"),
    )


def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds carry a vehicle object and a spec table, one third a state object."""
    volume = F.coalesce(F.col("engine_volume").cast("string"), F.lit("2,5"))
    engine = F.concat(F.lit("бензин, "), volume, F.lit(" л"))
    power = F.concat(F.coalesce(F.col("power_hp"), F.lit(75)).cast("string"), F.lit(" л.с.,налог"))
    odometer = F.concat(F.format_number(F.col("mileage"), 0), F.lit(" км"))
    photo = F.concat(F.lit("https://s1.cars.example/photo/"), F.col("external_id"))
    car = F.to_json(
        F.struct(
            F.lit("Car").alias("@type"),
            F.struct(F.col("brand").alias("name")).alias("brand"),
            F.col("model").alias("model"),
            F.col("year").cast("string").alias("vehicleModelDate"),
            F.struct(F.col("price"), F.date_format("listing_date", "yyyy-MM-dd").alias("validFrom")).alias("offers"),
            F.struct(odometer.alias("value")).alias("mileageFromOdometer"),
            F.concat(F.lit("VIN"), F.col("external_id")).alias("vehicleIdentificationNumber"),
            F.struct(F.concat(photo, F.lit("_main.jpg")).alias("url")).alias("image"),
            F.concat(F.lit('About "'), F.col("title"), F.lit('"')).alias("description"),
        )
    )
    table = F.concat(
        F.lit("<table class=specs>"),
        _row("Двигатель", engine),
        _row("Мощность", power),
        _row("Коробка передач", F.col("transmission")),
        _row("Привод", F.col("drive_type")),
        _row("Тип кузова", F.col("body_type")),
        _row("Владельцы", F.concat(F.col("owners_count").cast("string"), F.lit(" и более"))),
        _row("Растаможен", F.when(F.col("listing_id") % 2 == 0, "Да").otherwise("нет")),
        F.lit("<tr><td>one</td><td>two</td><td>three</td></tr></table>"),
    )
    gallery = F.when(
        F.col("photo_count") > 7,
        F.concat(
            F.lit('<img src="'), photo, F.lit('_1.jpg"><a href="'), photo, F.lit('_2.jpg">x</a><img src="'), photo,
            F.lit('_1.jpg">'),
        ),
    ).otherwise("")
    seller = F.when(F.col("is_dealer"), '<p>Официальный дилер</p><a href="/dealer/7">Auto <b>House</b></a>').otherwise(
        "<p>Частное лицо</p>"
    )
    state = F.to_json(
        F.struct(
            F.struct(
                F.col("title"),
                F.col("price"),
                F.array(
                    F.struct(F.lit("Двигатель").alias("title"), F.concat(volume, F.lit(" л, 150 л.с., дизель")).alias("value")),
                    F.struct(F.lit("Пробег").alias("title"), F.coalesce(odometer, F.lit("-")).alias("value")),
                    F.struct(F.lit("КПП").alias("title"), F.coalesce("transmission", F.lit("")).alias("value")),
                    F.struct(F.lit("Кузов").alias("title"), F.coalesce("body_type", F.lit("")).alias("value")),
                    F.struct(F.lit("Владельцы").alias("title"), F.col("owners_count").cast("string").alias("value")),
                ).alias("fields"),
                F.date_format("listing_date", "yyyy-MM-dd").alias("date"),
            ).alias("bullDescription"),
            F.struct(F.lit("Shop").alias("name"), F.col("is_dealer").alias("isDealer")).alias("seller"),
        )
    )
    has_car = F.col("listing_id") % 3 != 0
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("title"), F.lit("</title></head><body>"),
        F.when(
            has_car, F.concat(F.lit('<script type="application/ld+json">'), car, F.lit("</script>"), table, gallery, seller)
        ).otherwise(F.concat(F.lit("<script>window.__preloaded_state__ = "), state, F.lit(";</script>"))),
        F.lit("</body></html>"),
    )
    return tables.listings(spark, sf_dir).select(F.col("listing_id").alias("page_id"), card_url().alias("url"), html.alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages linking to card pages; an ad with an even id is linked twice."""
    link = F.concat(F.lit('<a class="x" href="'), card_url(), F.lit('">car</a>'))
    links = tables.listings(spark, sf_dir).select(
        F.floor(F.col("listing_id") / 500).alias("page_id"),
        "listing_id",
        F.when(F.col("listing_id") % 2 == 0, F.concat(link, link)).otherwise(link).alias("link"),
    )
    # a page covers an id range of 500, so it never holds more than that
    return links.groupBy("page_id").agg(
        F.concat(
            F.lit("<html><body><a href='/help'>help</a>"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_id", "link"))), lambda e: e["link"]), " "),
            F.lit("</body></html>"),
        ).alias("html")
    ).withColumn("url", F.concat(F.lit("https://moscow.cars.example/all/page"), F.col("page_id").cast("string")))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped JSON with attribute blocks, seller, place, time and valuation, plus a plain description."""

    def block(number: int, title: str, value: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.concat(
                F.lit(f'{{"attributeId":{number},"description":"'), value.cast("string"), F.lit(f'","title":"{title}"}},')
            ),
        ).otherwise("")

    listing = F.col("listing_id")
    volume = F.coalesce(F.col("engine_volume").cast("string"), F.lit("1,6"))
    state = F.concat(
        F.lit('{"params":['),
        block(1, "Пробег", F.concat(F.format_number(F.col("mileage"), 0), F.lit(" км"))),
        block(2, "Коробка передач", F.trim("transmission")),
        block(3, "Привод", F.col("drive_type")),
        block(4, "Двигатель", F.concat(volume, F.lit(" л / "), F.coalesce("power_hp", F.lit(90)).cast("string"), F.lit(" л.с. / Бензин"))),
        block(5, "Владельцы", F.concat(F.col("owners_count").cast("string"), F.lit(" владельца"))),
        block(6, "Владельцы", F.lit("99")),
        block(7, "Растаможен", F.when(listing % 2 == 0, "Да").otherwise("Нет")),
        block(8, "Особая метка", F.concat(F.lit("m"), (listing % 5).cast("string"))),
        F.lit('{"x":1}],"group":{"descriptions":["'), F.coalesce("body_type", F.lit("unknown")), F.lit('"],"title":"Тип кузова"},'),
        F.lit('"sellerName":"Seller '), (listing % 10).cast("string"),
        F.lit('","sellerType":"'), F.when(F.col("is_dealer"), "company").otherwise("private"),
        F.lit('","sellerId":'), (listing % 1000).cast("string"),
        F.lit(',"sellerRating":4.5,"reviewsCount":'), (listing % 7).cast("string"),
        F.lit(',"location":{"id":1,"name":"'), F.col("city"), F.lit('","parentName":"Region"},'),
        F.lit('"sortTimeStamp":'), (F.lit(1_600_000_000_000) + listing * 1000).cast("string"),
        F.lit(',"marketPrice":{"value":'), (F.col("price") + 5000).cast("string"), F.lit("}}"),
    )
    photo = F.concat(F.lit("https://00.img.cars.example/image/1/"), F.col("external_id"))
    html = F.concat(
        F.lit('<html><script>window.__state__="'), F.replace(state, F.lit('"'), F.lit('\\"')), F.lit('";</script>'),
        F.lit('<script>{"description":"short","images":[{"1280x960":"'), photo, F.lit('.big","64x48":"https://a/b"}],'),
        F.lit('"origImage":"https://x.example/avatar/1.png","u":"'), photo, F.lit('.2"}</script>'),
        F.lit('<script>{"description":"First line of '), F.col("external_id"), F.lit(r'\nand a \"quoted\" word"}</script>'),
        F.lit('<span data-marker="item-view/total-views">'), (listing % 1000).cast("string"), F.lit(" просмотров</span>"),
        F.lit('<span class="v" data-marker="item-view/today-views">(+'), (listing % 10).cast("string"), F.lit(" сегодня)</span>"),
        F.lit('<a href="/brands/shop-'), (listing % 13).cast("string"), F.lit('?x=1">shop</a></html>'),
    )
    return tables.listings(spark, sf_dir).select(F.col("listing_id").alias("page_id"), "url", html.alias("html"))


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages with an embedded catalogue blob; every 50th item has no id."""
    listing = F.col("listing_id")
    images = F.array(
        F.create_map(
            F.lit("208x156"), F.concat(F.lit("https://i.example/s/"), F.col("external_id")),
            F.lit("1280x960"), F.concat(F.lit("https://i.example/l/"), F.col("external_id")),
            F.lit("640x480"), F.concat(F.lit("https://i.example/m/"), F.col("external_id")),
        )
    )
    vas = F.array(F.struct(F.when(listing % 4 == 0, "Продвинуто").otherwise("XL").alias("title")))
    item = F.struct(
        F.when(listing % 50 != 0, listing).alias("id"),
        F.col("title"),
        F.concat(F.lit("/cars/"), F.col("external_id")).alias("urlPath"),
        F.when(listing % 9 == 0, "=SUM(A1)").otherwise(F.concat(F.lit("text "), F.col("external_id"))).alias("description"),
        (F.unix_seconds("created_at") * 1000).alias("sortTimeStamp"),
        F.struct(F.col("price").alias("value")).alias("priceDetailed"),
        F.struct(F.col("city").alias("name")).alias("location"),
        F.struct(F.concat(F.col("city"), F.lit(", Main street")).alias("formattedAddress")).alias("geo"),
        images.alias("images"),
        F.create_map(
            F.lit("lat"), (listing % 90).cast("string"), F.lit("lng"), (listing % 180).cast("string"),
            F.lit("address_user"), F.concat(F.lit("at "), F.col("city")),
        ).alias("coords"),
        (listing % 11 == 0).alias("isReserved"),
        F.struct(F.when(listing % 3 == 0, F.concat(F.lit("/brands/shop-"), (listing % 13).cast("string"), F.lit("?a=1"))).alias("link")).alias("userLogo"),
        F.when(listing % 5 == 0, "+7 (900) 123-45-67").alias("phone"),
        F.struct(F.array(F.struct(F.struct(vas.alias("vas")).alias("payload"))).alias("DateInfoStep")).alias("iva"),
    )
    rows = tables.listings(spark, sf_dir).select(F.floor(listing / 500).alias("page_id"), "listing_id", item.alias("item"))
    blob = F.to_json(
        F.struct(
            F.struct(F.lit("true").alias("hasMessages")).alias("i18n"),
            F.struct(
                F.struct(
                    F.struct(F.transform("entries", lambda e: e["item"]).alias("items")).alias("catalog")
                ).alias("data")
            ).alias("state"),
        )
    )
    # at most 500 ids per page
    pages = rows.groupBy("page_id").agg(F.collect_list(F.struct("item")).alias("entries"))
    return _catalogue_html(pages, blob)


def _catalogue_html(pages: DataFrame, blob: Column) -> DataFrame:
    escaped = F.replace(F.replace(blob, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    html = F.concat(
        F.lit("<html><script type='mime/invalid' data-mfe-state='true'>{\"sandbox\":1}</script>"),
        F.lit('<script type="mime/invalid" data-mfe-state="true">'), escaped, F.lit("</script></html>"),
    )
    return pages.select(
        "page_id", F.concat(F.lit("https://cars.example/all?p="), F.col("page_id").cast("string")).alias("url"), html.alias("html")
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested offer per listing, with the fields in varying places."""
    listing = F.col("listing_id")
    tech = F.struct(
        F.upper("engine_type").alias("engine_type"),
        F.when(listing % 2 == 0, F.col("transmission")).alias("transmission"),
        F.when(listing % 3 == 0, (F.col("engine_volume") * 1000).cast("int")).alias("displacement"),
        F.col("power_hp").alias("power"),
    )
    vehicle = F.struct(
        F.struct(F.when(listing % 40 != 0, F.col("brand")).alias("name")).alias("mark_info"),
        F.struct(F.col("model").alias("name")).alias("model_info"),
        tech.alias("tech_param"),
        F.struct(F.col("body_type")).alias("configuration"),
        F.struct(F.lit("II").alias("name"), F.col("year").alias("year_from")).alias("super_gen"),
        F.col("transmission").alias("transmission"),
        F.col("drive_type").alias("drive"),
        F.lit("040001").alias("color_hex"),
    )
    offer = F.struct(
        F.col("external_id").alias("id"),
        F.struct(F.when(listing % 2 == 0, F.col("price")).alias("RUR"), F.col("price").alias("price")).alias("price_info"),
        F.struct(F.when(listing % 2 == 1, F.col("year")).alias("year"), F.col("owners_count").alias("owners_number")).alias("documents"),
        F.struct(F.col("mileage")).alias("state"),
        F.transform(
            F.sequence(F.lit(1), F.lit(7)),
            lambda i: F.struct(
                F.create_map(F.lit("456x342"), F.concat(F.col("external_id"), F.lit("/"), i.cast("string"))).alias("sizes")
            ),
        ).alias("photos"),
        F.when(F.col("is_dealer"), "COMMERCIAL").otherwise("PRIVATE").alias("seller_type"),
        F.struct(
            F.lit("S").alias("name"), F.struct(F.struct(F.col("city").alias("name")).alias("region_info")).alias("location")
        ).alias("seller"),
        F.struct(((F.unix_seconds("listing_date") + 3650 * 86_400) * 1000).cast("string").alias("creation_date")).alias("additional_info"),
        vehicle.alias("vehicle_info"),
    )
    return tables.listings(spark, sf_dir).select("listing_id", F.to_json(offer).alias("offer"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per labelled document, in six shapes: plain, fenced, embedded, legacy name, cut off, junk."""
    doc = F.col("doc_id")
    alias = (
        F.when(F.col("category") == "damaged_body", "Junk")
        .when(F.col("category") == "debtor", "Owner-Debtor")
        .otherwise(F.col("category"))
    )

    def body(name: Column) -> Column:
        return F.to_json(
            F.struct(
                name.alias("category"),
                F.col("confidence"),
                F.array(F.lit("f1"), F.lit("f2")).alias("flags"),
                F.lit("because").alias("reasoning"),
            )
        )

    plain = body(F.col("category"))
    raw = (
        F.when(doc % 6 == 0, plain)
        .when(doc % 6 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(doc % 6 == 2, F.concat(F.lit("Here you are: "), plain, F.lit(" Good luck.")))
        .when(doc % 6 == 3, body(alias))
        .when(doc % 6 == 4, F.expr("substring(plain, 1, length(plain) - 5)"))
        .otherwise("I cannot say")
    )
    return (
        tables.document_analysis(spark, sf_dir)
        .withColumn("plain", plain)
        .select("doc_id", F.col("category").alias("true_category"), F.col("confidence").alias("true_confidence"), raw.alias("raw"))
    )


def batch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers covering up to twenty documents each (an id range), some fenced."""
    item = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.col("category"),
        F.col("confidence"),
    )
    grouped = (
        tables.document_analysis(spark, sf_dir)
        .groupBy(F.floor(F.col("doc_id") / 20).alias("batch_id"))
        .agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"))
    )
    return grouped.select(
        "batch_id",
        F.when(F.col("batch_id") % 3 == 0, F.col("body"))
        .when(F.col("batch_id") % 3 == 1, F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```")))
        .otherwise(F.concat(F.lit("Answer: "), F.col("body"), F.lit(" done")))
        .alias("raw"),
    )
