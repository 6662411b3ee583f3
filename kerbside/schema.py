"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

PRICE_POINT = T.StructType([T.StructField("price", T.IntegerType()), T.StructField("date", T.DateType())])

LISTING = T.StructType(
    [
        T.StructField("listing_id", T.LongType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("external_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("mileage", T.IntegerType()),
        T.StructField("price", T.IntegerType()),
        T.StructField("engine_volume", T.DoubleType()),
        T.StructField("engine_type", T.StringType()),
        T.StructField("power_hp", T.IntegerType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("drive_type", T.StringType()),
        T.StructField("body_type", T.StringType()),
        T.StructField("owners_count", T.IntegerType()),
        T.StructField("photo_count", T.IntegerType()),
        T.StructField("city", T.StringType()),
        T.StructField("is_dealer", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("listing_date", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("listing_id", T.LongType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("reasoning", T.StringType()),
    ]
)

CATEGORY_RESULT = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("flags", T.ArrayType(T.StringType())),
        T.StructField("reasoning", T.StringType()),
    ]
)
CATEGORY_RESULT_WITH_ID = T.StructType([T.StructField("id", T.StringType()), *CATEGORY_RESULT.fields])

# Embedded vehicle object of a card page.
CAR_JSON = T.StructType(
    [
        T.StructField("@type", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("vehicleModelDate", T.StringType()),
        T.StructField("offers", T.StringType()),
        T.StructField("mileageFromOdometer", T.StringType()),
        T.StructField("vehicleIdentificationNumber", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("datePosted", T.StringType()),
        T.StructField("datePublished", T.StringType()),
    ]
)

# State object of a card page, the fallback carrier.
_TITLE_VALUE = T.StructType([T.StructField("title", T.StringType()), T.StructField("value", T.StringType())])
STATE_JSON = T.StructType(
    [
        T.StructField(
            "bullDescription",
            T.StructType(
                [
                    T.StructField("title", T.StringType()),
                    T.StructField("price", T.DoubleType()),
                    T.StructField("fields", T.ArrayType(_TITLE_VALUE)),
                    T.StructField("vin", T.StringType()),
                    T.StructField("description", T.StringType()),
                    T.StructField("text", T.StringType()),
                    T.StructField("date", T.StringType()),
                    T.StructField("datePublished", T.StringType()),
                ]
            ),
        ),
        T.StructField("vin", T.StringType()),
        T.StructField(
            "gallery",
            T.StructType(
                [
                    T.StructField(
                        "photos",
                        T.StructType(
                            [
                                T.StructField(
                                    "images",
                                    T.ArrayType(T.StructType([T.StructField("src", T.StringType())])),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField(
            "seller",
            T.StructType(
                [
                    T.StructField("name", T.StringType()),
                    T.StructField("title", T.StringType()),
                    T.StructField("type", T.StringType()),
                    T.StructField("isDealer", T.BooleanType()),
                ]
            ),
        ),
    ]
)

ATTRIBUTE_JSON = T.StructType([T.StructField("title", T.StringType()), T.StructField("description", T.StringType())])

# Catalogue item (only the parts any operator reads; the rest of the blob is ignored by from_json).
_VAS = T.StructType([T.StructField("title", T.StringType())])
CATALOGUE_ITEM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("urlPath", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("sortTimeStamp", T.LongType()),
        T.StructField("priceDetailed", T.StructType([T.StructField("value", T.LongType())])),
        T.StructField("location", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("geo", T.StructType([T.StructField("formattedAddress", T.StringType())])),
        T.StructField("images", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("coords", T.MapType(T.StringType(), T.StringType())),
        T.StructField("isReserved", T.BooleanType()),
        T.StructField("userLogo", T.StructType([T.StructField("link", T.StringType())])),
        T.StructField("phone", T.StringType()),
        T.StructField(
            "iva",
            T.StructType(
                [
                    T.StructField(
                        "DateInfoStep",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "payload", T.StructType([T.StructField("vas", T.ArrayType(_VAS))])
                                    )
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)
CATALOGUE_STATE = T.StructType(
    [
        T.StructField("i18n", T.StructType([T.StructField("hasMessages", T.StringType())])),
        T.StructField(
            "state",
            T.StructType(
                [
                    T.StructField(
                        "data",
                        T.StructType(
                            [
                                T.StructField(
                                    "catalog",
                                    T.StructType([T.StructField("items", T.ArrayType(CATALOGUE_ITEM))]),
                                )
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)

# Nested offer of the third marketplace kind. Ragged leaves stay strings and are cast where used.
_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OFFER = _struct(
    id=_S,
    url=_S,
    description=_S,
    seller_comment=_S,
    seller_type=_S,
    created=_S,
    price_info=_struct(RUR=_S, price=_S, price_rur=_S),
    documents=_struct(
        year=_S, vin=_S, pts=_S, pts_type=_S, owners_number=_S, owners_count=_S, custom_cleared=T.BooleanType()
    ),
    state=_struct(mileage=T.LongType(), image_urls=T.ArrayType(_S)),
    photos=T.ArrayType(_S),
    color=_struct(name=_S),
    seller=_struct(name=_S, location=_struct(city=_S, region_info=_struct(name=_S))),
    additional_info=_struct(creation_date=_S),
    vehicle_info=_S,
    car_info=_S,
)
VEHICLE = _struct(
    mark_info=_struct(name=_S),
    model_info=_struct(name=_S),
    tech_param=_struct(engine_type=_S, transmission=_S, gear_type=_S, displacement=_S, power=_S, horse_power=_S),
    configuration=_struct(body_type=_S),
    super_gen=_struct(name=_S, year_from=_S),
    engine_type=_S,
    transmission=_S,
    drive=_S,
    engine_volume=_S,
    body_type=_S,
    steering_wheel=_S,
    color_hex=_S,
)
PHOTO_SIZES = _struct(sizes=T.MapType(_S, _S))
