"""Structured fields from raw pages, as column expressions over a ``pages(page_id, url, html)`` table.

Everything is narrow: no shuffle, no Python in the row path. The carriers read are embedded JSON (JSON-LD, state
objects, attribute blocks, catalogue blobs), plain key/value tables, links and meta tags; arbitrary DOM is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import blank_to_null, computed, contains_any, let, lookup
from kerbside.functions import text as T
from kerbside.schema import ATTRIBUTE_JSON, CAR_JSON, CATALOGUE_STATE, OFFER, PHOTO_SIZES, STATE_JSON, VEHICLE

# Page formats. A card address ends in /<make>/<model>/<id>.html below the city.
CARD_URL = r"https?://[\w.]+/\w+/\w+/\w+/(\d+)\.html"
CARD_PHOTO_URL = r"https?://[a-z0-9]+\.[a-z0-9.]+/(?:photo|pics)/[^\s\"']+"
CDN_PHOTO_URL = r'"(https?://\d+\.img\.[a-z0-9.]+/image/\d+/[^"]+)"'
STATE_VARIABLE = "__preloaded_state__"


def unescape(html: Column) -> Column:
    """Undo one level of JSON string escaping."""
    return F.replace(F.replace(html, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


WHITESPACE = " \t\n\r\f\v\u00a0\u2002\u2003\u2009\u3000"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_text(fragment: Column) -> Column:
    """Visible text of a fragment: tags out, the basic entities decoded, ends trimmed. Plain text passes quickly."""

    def decoded(text: Column) -> Column:
        out = text
        for entity, char in ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)

    def untagged(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<[^>]*+>", "")).otherwise(text)

    return F.btrim(let(let(fragment, untagged), decoded), F.lit(WHITESPACE))


def all_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


# ------------------------------------------------------------------ links
def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page in page order."""
    hrefs = all_found(F.col("html"), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""")
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def extract_card_links(pages: DataFrame, pattern: str = CARD_URL, max_cards: int | None = None) -> DataFrame:
    """First address per ad id among links matching ``pattern`` (group 1 = id), at most ``max_cards`` per page.

    The cap counts a page's distinct matching addresses, in page order, inside the row.
    """
    hrefs = all_found(F.col("html"), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""")
    cards = F.array_distinct(F.filter(hrefs, lambda h: F.regexp_like(h, F.lit(pattern))))
    if max_cards is not None:
        cards = F.slice(cards, 1, max_cards)
    found = pages.select("page_id", F.posexplode(cards).alias("pos", "href")).withColumn(
        "ad_id", F.regexp_extract("href", pattern, 1)
    )
    first = F.min(F.struct("page_id", "pos", "href"))
    return found.groupBy("ad_id").agg(first.alias("f")).select("ad_id", "f.page_id", F.col("f.href").alias("url"))


def page_title(html: Column) -> Column:
    return html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_content(html: Column, names: Sequence[str]) -> Column:
    """Content of the first meta tag (page order) whose property or name is one of ``names``."""
    options = "|".join(n.replace(".", r"\.") for n in names)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    named = F.filter(
        tags,
        lambda t: F.regexp_like(t, F.lit(rf"""(?is)\b(?:property|name)\s*=\s*["'](?:{options})["']"""))
        & F.regexp_like(t, F.lit(r"""(?is)\bcontent\s*=\s*["'][^"']+["']""")),
    )
    return T.found(F.try_element_at(named, F.lit(1)), r"""(?is)\bcontent\s*=\s*["']([^"']+)["']""")


# ------------------------------------------------------------------ card pages
def spec_table(html: Column) -> Column:
    """Two-cell rows of tables with at least four rows, as a map; the last value of a key wins."""
    tables = all_found(html, r"(?is)<table\b[^>]*>(.*?)</table>")
    rows = F.flatten(
        F.transform(
            F.filter(
                F.transform(tables, lambda t: all_found(t, r"(?is)<tr\b[^>]*>(.*?)</tr>")), lambda r: F.size(r) >= 4
            ),
            lambda r: F.transform(r, lambda row: all_found(row, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>")),
        )
    )
    pairs = F.transform(
        F.filter(rows, lambda cells: F.size(cells) == 2),
        lambda cells: F.struct(html_text(cells[0]).alias("k"), html_text(cells[1]).alias("v")),
    )
    return last_wins(F.filter(pairs, lambda p: p["k"] != ""))


def last_wins(pairs: Column) -> Column:
    """Array of (k, v) structs to a map; of equal keys the last stays."""
    return _one_per_key(pairs, 1)


def first_wins(pairs: Column) -> Column:
    """Array of (k, v) structs to a map; of equal keys the first stays."""
    return _one_per_key(pairs, -1)


def _one_per_key(pairs: Column, beside: int) -> Column:
    """Sort by key and place, and keep what has no equal key on the given side: n log n in the number of pairs."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    alone = lambda line: F.filter(line, lambda p, i: ~F.get(line, i + beside)["k"].eqNullSafe(p["k"]))
    kept = let(placed, alone)
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))


def jsonld_car(html: Column) -> Column:
    """The first embedded vehicle object of the page."""
    scripts = all_found(html, r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""")
    cars = F.filter(F.transform(scripts, lambda s: F.from_json(s, CAR_JSON)), lambda c: c["@type"] == "Car")
    return F.try_element_at(cars, F.lit(1))


def card_photos(html: Column) -> Column:
    """Gallery addresses in img sources, then in links; page order, no repeats."""
    images = all_found(html, r"""(?is)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""")
    links = all_found(html, r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""")
    return F.array_distinct(
        F.filter(F.concat(images, links), lambda u: F.regexp_like(u, F.lit(CARD_PHOTO_URL)))
    )


def card_seller(html: Column) -> Column:
    """Seller type, name and dealer flag from the visible text and dealer links of a card page."""
    text = F.lower(html_text(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")))
    names = F.filter(
        F.transform(
            all_found(
                html, r"""(?is)(<a\b[^>]*?\bhref\s*=\s*["'][^"']*/(?:dealer|salon|company)/[^"']*["'][^>]*>.*?</a>)"""
            ),
            html_text,
        ),
        lambda n: F.length(n) > 2,
    )

    def seller(found: Column) -> Column:
        dealer, private, name = found["dealer"], found["private"], found["name"]
        return F.struct(
            F.when(dealer, "дилер").when(private, "частное лицо").when(name.isNotNull(), "дилер").alias("seller_type"),
            name.alias("seller_name"),
            (dealer | name.isNotNull()).alias("is_dealer"),
        )

    def signs(t: Column) -> Column:
        return F.struct(
            contains_any(t, fixed.PAGE_DEALER_WORDS).alias("dealer"),
            F.contains(t, F.lit("частное лицо")).alias("private"),
            F.try_element_at(names, F.lit(1)).alias("name"),
        )

    return let(text, lambda t: let(signs(t), seller))


# Meta tags that carry a publication date.
META_DATES = ["article:published_time", "datePublished", "og:updated_time"]


def card_date(car: Column, meta_date: Column) -> Column:
    return F.coalesce(
        blank_to_null(F.get_json_object(car["offers"], "$.validFrom")),
        blank_to_null(F.get_json_object(car["offers"], "$.availabilityStarts")),
        blank_to_null(car["datePosted"]),
        blank_to_null(car["datePublished"]),
        meta_date,
    )


def _engine_fields(engine: Column, power: Column) -> dict[str, Column]:
    parsed = T.parse_engine_list(engine)
    return {
        "engine_type": parsed["engine_type"],
        "engine_volume": parsed["engine_volume"],
        "power_hp": T.horse_power(power),
    }


def _with_car(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Pages with their vehicle object, which is read once."""
    return computed(pages, [*keep, "html"], car=jsonld_car(F.col("html")))


def _with_card_parts(pages: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """What else a card page gives, for pages with a vehicle object."""
    html, has = F.col("html"), F.col("car").isNotNull()
    parts = {"specs": spec_table(html), "gallery": card_photos(html), "seller": card_seller(html), "meta_date": meta_content(html, META_DATES)}
    return computed(pages, [*keep, "car"], **{name: F.when(has, part) for name, part in parts.items()}, **more)


def extract_jsonld_car(pages: DataFrame, site: str = "cars.example", card_url: str = CARD_URL) -> DataFrame:
    """Card page with an embedded vehicle object -> one ad row; pages without id or brand yield nothing."""
    with_car = _with_car(pages, ["page_id", "url"]).filter(F.col("car").isNotNull())
    rows = _with_card_parts(with_car, ["page_id", "url"]).select("page_id", "url", *_named(_car_fields(site, card_url)))
    return _cards(rows)


def _named(fields: dict[str, Column]) -> list[Column]:
    return [value.alias(name) for name, value in fields.items()]


def _cards(rows: DataFrame) -> DataFrame:
    """Ads with an id and a make; pages without yield nothing."""
    return rows.filter(F.col("external_id").isNotNull() & F.col("brand").isNotNull()).withColumn("photo_count", F.array_size("photos"))


def _car_fields(site: str, card_url: str) -> dict[str, Column]:
    car, specs = F.col("car"), F.col("specs")

    def spec(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at(specs, F.lit(k)) for k in keys])

    brand = F.when(F.startswith(car["brand"], F.lit("{")), F.get_json_object(car["brand"], "$.name")).otherwise(
        car["brand"]
    )
    image = F.coalesce(
        blank_to_null(F.get_json_object(car["image"], "$.url")),
        F.when(~F.startswith(car["image"], F.lit("{")), blank_to_null(car["image"])),
    )
    photos = F.when(F.size("gallery") > 0, F.col("gallery")).otherwise(F.array_compact(F.array(image)))
    customs = spec("Растаможен", "Таможня")
    engine = _engine_fields(spec("Двигатель"), spec("Мощность"))
    return {
        "external_id": T.found(F.col("url"), card_url),
        "brand": blank_to_null(brand),
        "model": F.coalesce(car["model"], F.lit("")),
        "year": F.coalesce(car["vehicleModelDate"].try_cast("int"), F.lit(0)),
        "price": F.coalesce(F.get_json_object(car["offers"], "$.price").try_cast("double").cast("int"), F.lit(0)),
        "mileage": T.digits(F.get_json_object(car["mileageFromOdometer"], "$.value")).cast("int"),
        "vin": car["vehicleIdentificationNumber"],
        "description": car["description"],
        "photos": photos,
        "city": T.city_from_url(F.col("url"), site),
        "region": T.region_from_url(F.col("url"), site),
        "engine_type": engine["engine_type"],
        "engine_volume": engine["engine_volume"],
        "power_hp": engine["power_hp"],
        "transmission": spec("Коробка передач"),
        "drive_type": spec("Привод"),
        "body_type": spec("Тип кузова"),
        "color": spec("Цвет"),
        "steering_wheel": spec("Руль"),
        "owners_count": T.digits(spec("Владельцы")).cast("int"),
        "generation": spec("Поколение"),
        "modification": spec("Комплектация"),
        "pts_type": spec("ПТС"),
        "condition": spec("Состояние"),
        "customs_cleared": T.yes_no_short(customs),
        "seller_type": F.col("seller.seller_type"),
        "seller_name": F.col("seller.seller_name"),
        "is_dealer": F.col("seller.is_dealer"),
        "listing_date": card_date(car, F.col("meta_date")),
        "attrs": specs,
    }


def _state(html: Column, variable: str) -> Column:
    """The state object of a page's script."""
    return let(F.regexp_extract(html, rf"(?s)window\.{variable}\s*=\s*(\{{.*?\}});", 1), lambda b: F.from_json(blank_to_null(b), STATE_JSON))


def _with_state_fields(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Pages with the named fields of their state object ``s``."""
    stated = F.coalesce(F.col("s.bullDescription.fields"), F.array().cast("array<struct<title:string,value:string>>"))
    pairs = F.transform(stated, lambda f: F.struct(F.coalesce(f["title"], F.lit("")).alias("k"), F.coalesce(f["value"], F.lit("")).alias("v")))
    return computed(pages, [*keep, "s"], fields=last_wins(pairs))


def extract_preloaded_state(
    pages: DataFrame, site: str = "cars.example", card_url: str = CARD_URL, variable: str = STATE_VARIABLE
) -> DataFrame:
    """Fallback carrier: a state object in a script -> one ad row."""
    base = computed(pages, ["page_id", "url"], s=_state(F.col("html"), variable)).filter(F.col("s").isNotNull())
    return _cards(_with_state_fields(base, ["page_id", "url"]).select("page_id", "url", *_named(_state_fields(site, card_url))))


def _state_fields(site: str, card_url: str) -> dict[str, Column]:
    desc, seller = F.col("s.bullDescription"), F.col("s.seller")

    def field(*keys: str) -> Column:
        return F.coalesce(*[blank_to_null(F.try_element_at(F.col("fields"), F.lit(k))) for k in keys])

    brand, model = T.card_title_brand_model(F.coalesce(desc["title"], F.lit("")))
    engine = T.parse_engine_list(field("Двигатель"))
    customs = field("Растаможен", "Таможня")
    dealer = F.coalesce(seller["isDealer"], F.lit(False)) | F.coalesce(
        F.lower(seller["type"]).isin("дилер", "dealer", "салон"), F.lit(False)
    )
    photos = F.filter(
        F.transform(
            F.coalesce(F.col("s.gallery.photos.images"), F.array().cast("array<struct<src:string>>")), lambda i: i["src"]
        ),
        lambda u: F.coalesce(u, F.lit("")) != "",
    )
    return {
        "external_id": T.found(F.col("url"), card_url),
        "brand": blank_to_null(brand),
        "model": model,
        "year": T.title_year(F.coalesce(desc["title"], F.lit(""))),
        "price": F.coalesce(desc["price"], F.lit(0.0)).cast("int"),
        "mileage": T.digits(field("Пробег")).cast("int"),
        "vin": F.coalesce(blank_to_null(desc["vin"]), F.col("s.vin")),
        "description": F.coalesce(blank_to_null(desc["description"]), desc["text"]),
        "photos": photos,
        "city": T.city_from_url(F.col("url"), site),
        "region": T.region_from_url(F.col("url"), site),
        "engine_type": engine["engine_type"],
        "engine_volume": engine["engine_volume"],
        "power_hp": engine["power_hp"],
        "transmission": field("Коробка передач", "КПП"),
        "drive_type": field("Привод"),
        "body_type": field("Кузов", "Тип кузова"),
        "color": field("Цвет"),
        "steering_wheel": field("Руль"),
        "owners_count": T.digits(field("Владельцы", "Владельцев по ПТС")).cast("int"),
        "generation": field("Поколение"),
        "modification": field("Комплектация"),
        "pts_type": field("ПТС"),
        "condition": field("Состояние"),
        "customs_cleared": T.yes_no_short(customs),
        "seller_type": F.coalesce(blank_to_null(seller["type"]), F.when(dealer, "дилер")),
        "seller_name": F.coalesce(blank_to_null(seller["name"]), seller["title"]),
        "is_dealer": dealer,
        "listing_date": F.coalesce(blank_to_null(desc["date"]), desc["datePublished"]),
        "attrs": F.col("fields"),
    }


def extract_cards(pages: DataFrame, site: str = "cars.example", card_url: str = CARD_URL, variable: str = STATE_VARIABLE) -> DataFrame:
    """Vehicle object when the page has one, state object otherwise. A page is read once, and only for what it needs."""
    keep = ["page_id", "url"]
    state = F.when(F.col("car").isNull(), _state(F.col("html"), variable))
    base = _with_state_fields(_with_card_parts(_with_car(pages, keep), keep, s=state), [*keep, "car", "specs", "gallery", "seller", "meta_date"])
    kinds = dict(extract_jsonld_car(pages, site, card_url).dtypes)
    car, stated = _car_fields(site, card_url), _state_fields(site, card_url)
    row = F.when(F.col("car").isNotNull(), F.struct(*[car[c].cast(kinds[c]).alias(c) for c in car]))
    row = row.when(F.col("s").isNotNull(), F.struct(*[stated[c].cast(kinds[c]).alias(c) for c in car]))
    return _cards(computed(base, keep, row=row).filter(F.col("row").isNotNull()).select(*keep, "row.*"))


# ------------------------------------------------------------------ detail pages
def attribute_pairs(page: Column) -> Column:
    """(title, description) pairs of attribute blocks of an unescaped page, in page order, as an array of (k, v)."""
    blocks = F.regexp_extract_all(page, F.lit(r'\{"attributeId"\s*:\s*\d+[^}]*\}'), 0)
    return F.transform(
        blocks,
        lambda b: let(
            F.from_json(b, ATTRIBUTE_JSON),
            lambda o: F.struct(
                F.coalesce(o["title"], T.found(b, r'"title"\s*:\s*"([^"]*)"')).alias("k"),
                F.coalesce(o["description"], T.found(b, r'"description"\s*:\s*"([^"]*)"')).alias("v"),
            ),
        ),
    )


def described_pairs(page: Column) -> Column:
    """The second spelling: "descriptions":["V"],"title":"T"."""
    spots = F.regexp_extract_all(
        page, F.lit(r'"descriptions"\s*:\s*\["[^"]+"\]\s*,\s*"title"\s*:\s*"[^"]+"'), 0
    )
    return F.transform(
        spots,
        lambda s: F.struct(
            F.regexp_extract(s, r'"title"\s*:\s*"([^"]+)"$', 1).alias("k"),
            F.regexp_extract(s, r'\["([^"]+)"\]', 1).alias("v"),
        ),
    )


def _usable(pairs: Column) -> Column:
    return F.filter(
        pairs, lambda p: (F.coalesce(p["k"], F.lit("")) != "") & (F.coalesce(p["v"], F.lit("")) != "")
    )


def attribute_fields(html: Column, fields: dict[str, str] = fixed.ATTRIBUTE_FIELD) -> Column:
    """Known attributes as a map field -> text; the first value of a field wins, blocks before the second spelling."""
    pairs = let(unescape(html), lambda page: F.concat(attribute_pairs(page), described_pairs(page)))
    known = F.filter(_usable(pairs), lambda p: p["k"].isin(list(fields)))
    return first_wins(F.transform(known, lambda p: F.struct(lookup(p["k"], fields).alias("k"), p["v"].alias("v"))))


def extract_unmapped_attributes(html: Column, fields: dict[str, str] = fixed.ATTRIBUTE_FIELD) -> Column:
    """Attributes without a field of their own, title -> text."""
    return first_wins(F.filter(_usable(attribute_pairs(unescape(html))), lambda p: ~p["k"].isin(list(fields))))


def extract_description(html: Column) -> Column:
    """First JSON description of at least 20 characters, un-escaped.

    The closing quote is found by look-behind over a lazy scan, which runs in constant stack on texts of any length.
    """
    bodies = all_found(html, r'(?s)"description"\s*:\s*"(.*?(?<!\\)(?:\\\\)*+)"')
    long_enough = F.filter(bodies, lambda d: F.length(F.regexp_replace(d, r"(?s)\\.", "x")) >= 20)
    raw = F.try_element_at(long_enough, F.lit(1))
    text = F.get_json_object(F.concat(F.lit('{"d":"'), raw, F.lit('"}')), "$.d")
    return F.when(F.length(text) > 20, text)


def extract_photos(html: Column) -> Column:
    """Photo addresses: sized image objects, then full-image fields, then image-server links; no repeats.

    A match reaches over an opening brace only by an address that holds one. So the page is cut at its opening braces and
    only its head and the pieces with a quoted address are unescaped and searched; where such a piece ends inside an address,
    the page is searched whole.
    """

    def searched(pieces: Column) -> Column:
        reaches_over = F.exists(pieces, lambda p: F.regexp_like(p, F.lit(r'"https?://[^"]*+\z')))
        return let(unescape(F.when(reaches_over, html).otherwise(F.array_join(pieces, "{"))), _extract_photos)

    return let(F.filter(F.split(html, r"\{"), lambda p, i: (i == 0) | F.contains(p, F.lit('"http'))), searched)


def _extract_photos(page: Column) -> Column:
    sized = all_found(page, r'\{[^{}]*"(?:1280x960|640x480)"\s*:\s*"(https?://[^"]+)"[^{}]*\}')
    named = all_found(page, r'"(?:\w*[Ff]ull[Ii]mage(?:Url)?|origImage|image1280x960)"\s*:\s*"(https?://[^"]+)"')
    linked = all_found(page, CDN_PHOTO_URL)
    proper = F.filter(F.concat(named, linked), lambda u: ~contains_any(u, fixed.PHOTO_SKIP_WORDS))
    return F.array_distinct(F.concat(sized, proper))


def extract_seller(html: Column) -> Column:
    """Seller struct: name, type, is_dealer, id, rating, reviews_count, registered_date."""
    return let(unescape(html), _extract_seller)


def _extract_seller(page: Column) -> Column:
    name = T.first_found(
        page,
        [
            r'"sellerName"\s*:\s*"([^"]+)"',
            r'"seller"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"',
            r'"shopName"\s*:\s*"([^"]+)"',
        ],
    )
    raw_type = F.lower(
        T.first_found(page, [r'"sellerType"\s*:\s*"([^"]+)"', r'"seller"\s*:\s*\{[^}]*"type"\s*:\s*"([^"]+)"'])
    )
    shop = T.found(page, r'"(?:shopId|isShop|isDealerPage)"\s*:\s*(\w+)')
    dealer = F.coalesce(~shop.isin("null", "false", "0"), F.lit(False)) | F.regexp_like(
        page, F.lit(r'"isCompany"\s*:\s*true')
    )
    kind = (
        F.when(raw_type.isin(fixed.SELLER_PRIVATE_WORDS), "private")
        .when(raw_type.isin(fixed.SELLER_DEALER_WORDS), "dealer")
        .otherwise(raw_type)
    )
    return F.struct(
        name.alias("name"),
        F.coalesce(kind, F.when(dealer, "dealer")).alias("type"),
        dealer.alias("is_dealer"),
        T.found(page, r'"sellerId"\s*:\s*(\d+)').alias("id"),
        T.found(page, r'"sellerRating"\s*:\s*([\d.]+)').alias("rating"),
        T.found(page, r'"reviewsCount"\s*:\s*(\d+)').alias("reviews_count"),
        T.found(page, r'"registrationDate"\s*:\s*"([^"]+)"').alias("registered_date"),
    )


def extract_location(html: Column) -> Column:
    """City and region struct."""
    return let(unescape(html), _extract_location)


def _extract_location(page: Column) -> Column:
    address = T.found(page, r'"address"\s*:\s*"([^"]+)"')
    return F.struct(
        F.coalesce(
            T.found(page, r'"location"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"'), F.trim(F.split(address, ",")[0])
        ).alias("city"),
        T.first_found(
            page,
            [
                r'"location"\s*:\s*\{[^}]*"parentName"\s*:\s*"([^"]+)"',
                r'"geoReferences"\s*:\s*\[[^\]]*"content"\s*:\s*"([^"]+)"',
            ],
        ).alias("region"),
    )


# Plausible publication times, in epoch seconds.
EPOCH_RANGE = (1_577_836_800, 2_000_000_000)


def epoch_seconds(value: Column) -> Column:
    """Milliseconds above 1e12 become seconds."""
    return F.when(value > 1_000_000_000_000, F.floor(value / 1000)).otherwise(value).cast("bigint")


def extract_listing_date(html: Column) -> Column:
    """Publication time as text: an ISO value when there is one, else the first plausible epoch, in ISO form."""
    return let(unescape(html), _extract_listing_date)


def _extract_listing_date(page: Column) -> Column:
    iso = [rf'"{key}"\s*:\s*"(\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}[^"]*)"' for key in ("publishedAt", "createdAt", "created")]
    stamps = [
        T.found(page, rf'"{key}"\s*:\s*(\d{{10,13}})').try_cast("bigint")
        for key in ("sortTimeStamp", "time", "createTime")
    ]
    low, high = EPOCH_RANGE

    def within(stamp: Column) -> Column:
        return let(let(stamp, epoch_seconds), lambda s: F.when((s > low) & (s < high), s))

    plausible = F.coalesce(*[within(s) for s in stamps])
    return F.coalesce(
        T.first_found(page, iso), F.date_format(F.timestamp_seconds(plausible), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    )


def offer_date(raw: Column) -> Column:
    """Epoch text or ISO text -> yyyy-MM-dd; anything else NULL."""
    stamp = epoch_seconds(F.when(F.regexp_like(raw, F.lit(r"^\d{10,}$")), raw).try_cast("bigint"))
    return F.when(
        F.regexp_like(raw, F.lit(r"^\d{10,}$")), F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd")
    ).when(F.contains(raw, F.lit("T")) | F.contains(raw, F.lit("-")), F.substring(raw, 1, 10))


# Plausible price estimates.
ESTIMATE_RANGE = (10_000, 50_000_000)


def extract_price_estimate(html: Column) -> Column:
    """The source's own valuation: first pattern with a plausible value."""
    return let(F.replace(html, F.lit('\\"'), F.lit('"')), _extract_price_estimate)


def _extract_price_estimate(page: Column) -> Column:
    values = [
        T.found(page, pattern).try_cast("bigint")
        for pattern in (
            r'"marketPrice"\s*:\s*\{"value"\s*:\s*(\d+)',
            r'"priceEstimate"\s*:\s*(\d+)',
            r'"valuationPrice"\s*:\s*(\d+)',
            r'"marketValue"\s*:\s*(\d+)',
            r'"estimatedPrice"\s*:\s*(\d+)',
        )
    ]
    low, high = ESTIMATE_RANGE
    return F.coalesce(*[let(v, lambda x: F.when((x > low) & (x < high), x)) for v in values]).cast("int")


def extract_view_counts(html: Column) -> Column:
    """Struct (total_views, today_views) from the marked elements."""

    def views(marker: str) -> Column:
        return T.digits(
            html_text(T.found(html, rf'(?is)data-marker="item-view/{marker}"[^>]*>(.*?)</'))
        ).cast("int")

    return F.struct(views("total-views").alias("total_views"), views("today-views").alias("today_views"))


def extract_seller_slug(item: Column) -> Column:
    return T.found(item, r"/brands/([^/?#\"']+)")


def detail_fields(pages: DataFrame) -> DataFrame:
    """Everything a detail page gives, one row per page."""
    html = F.col("html")
    base = computed(
        pages,
        ["page_id"],
        a=attribute_fields(html),
        seller=extract_seller(html),
        loc=extract_location(html),
        description=extract_description(html),
        photos=extract_photos(html),
        listing_date=extract_listing_date(html),
        source_estimate=extract_price_estimate(html),
        extra_attrs=extract_unmapped_attributes(html),
    )

    def attr(name: str) -> Column:
        return F.try_element_at(F.col("a"), F.lit(name))

    engine = T.parse_engine(attr("engine_raw"))
    seller_extra = F.struct("seller.id", "seller.rating", "seller.reviews_count", "seller.registered_date")
    return base.select(
        "page_id",
        T.digits(attr("mileage_raw")).cast("int").alias("mileage"),
        attr("transmission").alias("transmission"),
        attr("drive_type").alias("drive_type"),
        attr("body_type").alias("body_type"),
        attr("color").alias("color"),
        F.coalesce(attr("engine_type"), engine["engine_type"]).alias("engine_type"),
        F.coalesce(engine["engine_volume"], T.litres(attr("engine_volume_raw"))).alias("engine_volume"),
        F.coalesce(
            engine["power_hp"], T.digits(attr("power_raw")).cast("int"), T.horse_power(attr("modification"))
        ).alias("power_hp"),
        attr("vin").alias("vin"),
        T.digits(attr("owners_raw")).cast("int").alias("owners_count"),
        attr("steering").alias("steering_wheel"),
        attr("condition").alias("condition"),
        attr("pts_type").alias("pts_type"),
        T.yes_no(attr("customs_raw")).alias("customs_cleared"),
        attr("generation").alias("generation"),
        attr("modification").alias("modification"),
        "description",
        "photos",
        F.col("seller.name").alias("seller_name"),
        F.col("seller.type").alias("seller_type"),
        F.col("seller.is_dealer").alias("is_dealer"),
        seller_extra.alias("seller_extra"),
        F.col("loc.city").alias("city"),
        F.col("loc.region").alias("region"),
        "listing_date",
        "source_estimate",
        attr("damage_raw").alias("damage"),
        attr("accidents_raw").alias("accidents"),
        attr("warranty_raw").alias("warranty"),
        attr("exchange_raw").alias("exchange"),
        "extra_attrs",
    )


def enrich_from_detail(ads: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill only what an ad lacks from its detail page (joined on ``page_id``); new columns are added as they are.

    The parsed pages grow with the ads and take far more than the files they come from, by which Spark would judge whether
    to broadcast them: the join is told to merge.
    """
    detail = detail_fields(pages)
    renamed = detail.select("page_id", *[F.col(c).alias(f"d_{c}") for c in detail.columns if c != "page_id"])
    joined = ads.join(renamed.hint("merge"), "page_id", "left")
    types = dict(ads.dtypes)
    filled: dict[str, Column] = {}
    for c in detail.columns:
        if c == "page_id":
            continue
        if c not in types:
            filled[c] = F.col(f"d_{c}")
        elif c == "is_dealer":
            filled[c] = F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"d_{c}"), F.lit(False))
        elif c == "photos":
            filled[c] = F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.col(f"d_{c}"))
        elif types[c] == "string":
            filled[c] = F.coalesce(blank_to_null(F.col(c)), F.col(f"d_{c}"))
        else:
            filled[c] = F.coalesce(F.col(c), F.col(f"d_{c}").cast(types[c]))
    out = joined.withColumns(filled).drop(*[f"d_{c}" for c in detail.columns if c != "page_id"])
    return out.withColumn("photo_count", F.coalesce(F.array_size("photos"), F.lit(0)))


# ------------------------------------------------------------------ offers and catalogue items
def flatten_offer_json(offers: DataFrame, column: str = "offer", page_url: str = "https://cars.example") -> DataFrame:
    """Nested offer JSON -> flat ad row; rows without price or brand are dropped."""
    parsed = computed(offers, [], o=F.from_json(column, OFFER)).filter(F.col("o").isNotNull())
    base = computed(parsed, ["o"], v=F.from_json(F.coalesce("o.vehicle_info", "o.car_info"), VEHICLE))
    o, v = F.col("o"), F.col("v")

    def first_of(*values: Column) -> Column:
        """First value that is neither NULL, empty nor zero."""
        return F.coalesce(*[F.nullif(blank_to_null(x), F.lit("0")) for x in values])

    year = F.coalesce(first_of(o["documents"]["year"], v["super_gen"]["year_from"]).try_cast("int"), F.lit(0))
    price = F.coalesce(
        F.coalesce(o["price_info"]["RUR"], o["price_info"]["price"], o["price_info"]["price_rur"])
        .try_cast("double")
        .cast("int"),
        F.lit(0),
    )
    brand, model = v["mark_info"]["name"], F.coalesce(v["model_info"]["name"], F.lit(""))
    offer_id = F.coalesce(o["id"], F.lit(""))
    url = F.coalesce(
        blank_to_null(o["url"]),
        F.when(
            offer_id != "",
            F.concat(
                F.lit(f"{page_url}/cars/used/sale/"), F.lower(brand), F.lit("/"), F.lower(model), F.lit("/"), offer_id,
                F.lit("/"),
            ),
        ),
        F.lit(""),
    )
    listed = F.when(F.size(o["state"]["image_urls"]) > 0, o["state"]["image_urls"]).otherwise(o["photos"])
    by_size = lambda sizes: F.coalesce(*[blank_to_null(F.try_element_at(sizes, F.lit(s))) for s in ("1200x900", "456x342", "320x240")])
    photos = F.filter(
        F.transform(
            F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, 5),
            # a photo is parsed once, however many sizes are asked for
            lambda p: F.when(F.startswith(p, F.lit("{")), let(F.from_json(p, PHOTO_SIZES)["sizes"], by_size)).otherwise(p),
        ),
        lambda u: F.coalesce(u, F.lit("")) != "",
    )
    tech = v["tech_param"]
    cc = first_of(tech["displacement"], v["engine_volume"]).try_cast("double").cast("int")
    color = F.coalesce(blank_to_null(o["color"]["name"]), T.color_from_hex(blank_to_null(v["color_hex"])))
    place = o["seller"]["location"]
    rows = base.select(
        offer_id.alias("external_id"),
        brand.alias("brand"),
        model.alias("model"),
        year.alias("year"),
        price.alias("price"),
        url.alias("url"),
        o["state"]["mileage"].cast("int").alias("mileage"),
        F.coalesce(blank_to_null(o["description"]), blank_to_null(o["seller_comment"])).alias("description"),
        photos.alias("photos"),
        first_of(tech["engine_type"], v["engine_type"]).alias("engine_type"),
        T.displacement_litres(cc).alias("engine_volume"),
        first_of(tech["power"], tech["horse_power"]).try_cast("double").cast("int").alias("power_hp"),
        first_of(tech["transmission"], v["transmission"]).alias("transmission"),
        first_of(tech["gear_type"], v["drive"]).alias("drive_type"),
        first_of(v["configuration"]["body_type"], v["body_type"]).alias("body_type"),
        color.alias("color"),
        o["documents"]["vin"].alias("vin"),
        v["steering_wheel"].alias("steering_wheel"),
        first_of(o["documents"]["owners_number"], o["documents"]["owners_count"]).try_cast("int").alias("owners_count"),
        first_of(o["documents"]["pts"], o["documents"]["pts_type"]).alias("pts_type"),
        o["documents"]["custom_cleared"].alias("customs_cleared"),
        o["seller_type"].alias("seller_type"),
        o["seller"]["name"].alias("seller_name"),
        F.coalesce(o["seller_type"].isin("COMMERCIAL", "DEALER"), F.lit(False)).alias("is_dealer"),
        offer_date(first_of(o["additional_info"]["creation_date"], o["created"])).alias("listing_date"),
        F.coalesce(blank_to_null(place["city"]), place["region_info"]["name"]).alias("city"),
        place["region_info"]["name"].alias("region"),
        v["super_gen"]["name"].alias("generation"),
    )
    kept = rows.filter((F.col("price") != 0) & blank_to_null(F.col("brand")).isNotNull())
    return kept.withColumn("photo_count", F.array_size("photos"))


def html_unescape(text: Column) -> Column:
    out = text
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def scan_catalogue_items(pages: DataFrame) -> DataFrame:
    """Catalogue blob of a search page -> one row per item; items without an id are dropped."""
    scripts = all_found(
        F.col("html"), r"""(?is)(<script\b[^>]*type\s*=\s*["']mime/invalid["'][^>]*>.*?</script>)"""
    )
    usable = F.filter(
        scripts,
        lambda s: F.regexp_like(s, F.lit(r"""(?is)^<script[^>]*data-mfe-state\s*=\s*["']true["']"""))
        & ~F.contains(s, F.lit("sandbox")),
    )
    states = F.transform(
        usable, lambda s: F.from_json(html_unescape(F.regexp_extract(s, r"(?is)^<script[^>]*>(.*)</script>$", 1)), CATALOGUE_STATE)
    )
    filled = F.filter(
        states,
        lambda s: (F.coalesce(s["i18n"]["hasMessages"], F.lit("false")).isin("false", "{}", "") == F.lit(False))
        & (F.size(s["state"]["data"]["catalog"]["items"]) > 0),
    )
    items = F.try_element_at(filled, F.lit(1))["state"]["data"]["catalog"]["items"]
    return pages.select("page_id", "url", F.explode(items).alias("item")).filter(
        F.coalesce(F.col("item.id"), F.lit(0)) != 0
    )


def flag_promoted(item: Column) -> Column:
    """True when any step of the item sells a promotion."""
    steps = F.coalesce(item["iva"]["DateInfoStep"], F.array().cast("array<struct<payload:struct<vas:array<struct<title:string>>>>>"))
    return F.exists(
        steps,
        lambda s: F.coalesce(F.exists(s["payload"]["vas"], lambda x: x["title"] == fixed.PROMOTED_TITLE), F.lit(False)),
    )


def largest_image(image: Column) -> Column:
    """Address under the WxH key with the largest area."""

    def area(entry: Column) -> Column:
        parts = F.split(entry["key"], "x")
        return F.coalesce(F.get(parts, 0).try_cast("bigint") * F.get(parts, 1).try_cast("bigint"), F.lit(-1))

    sized = F.transform(F.map_entries(image), lambda e: F.struct(area(e).alias("area"), e["value"].alias("url")))
    return F.array_max(sized)["url"]


def preferred_image(image: Column) -> Column:
    """640x480, else 208x156, else any."""
    return F.coalesce(
        blank_to_null(F.try_element_at(image, F.lit("640x480"))),
        blank_to_null(F.try_element_at(image, F.lit("208x156"))),
        F.get(F.map_values(image), 0),
    )


def item_to_ad(items: DataFrame, base_url: str = "https://cars.example", source: str = "src_a") -> DataFrame:
    """Catalogue item -> ad row; dropped without id or title."""
    item = F.col("item")
    photos = F.filter(
        F.transform(
            F.slice(F.coalesce(item["images"], F.array().cast("array<map<string,string>>")), 1, 5), preferred_image
        ),
        lambda u: u.isNotNull(),
    )
    path = blank_to_null(item["urlPath"])
    return items.filter((F.coalesce(item["id"], F.lit(0)) != 0) & blank_to_null(item["title"]).isNotNull()).select(
        F.lit(source).alias("source"),
        item["id"].cast("string").alias("external_id"),
        T.title_brand(item["title"]).alias("brand"),
        T.title_model(item["title"]).alias("model"),
        T.title_year(item["title"]).alias("year"),
        F.coalesce(item["priceDetailed"]["value"], F.lit(0)).cast("int").alias("price"),
        F.when(path.isNotNull(), F.concat(F.lit(base_url), path)).otherwise("").alias("url"),
        item["description"].alias("description"),
        photos.alias("photos"),
        item["location"]["name"].alias("city"),
        item["title"].alias("title"),
    )
