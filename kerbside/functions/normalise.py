"""Canonical values for brands and categorical fields; sanity limits for numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import blank_to_null, lookup
from kerbside.functions.text import is_dealer_type


def canonical(value: Column, table: Mapping[str, str]) -> Column:
    """Dictionary value of the trimmed, lower-cased text; the trimmed text itself when unknown; NULL when empty."""
    present = blank_to_null(value)
    return F.coalesce(lookup(F.lower(F.trim(present)), dict(table)), F.trim(present))


def canonical_brand(brand: Column, table: Mapping[str, str] = fixed.BRAND) -> Column:
    present = F.trim(blank_to_null(brand))
    key = F.lower(present)
    without_alias = F.trim(F.regexp_replace(key, r"\s*\(.*?\)\s*", ""))
    return F.coalesce(lookup(key, dict(table)), lookup(without_alias, dict(table)), present)


def normalise_categoricals(
    ads: DataFrame, fields: Mapping[str, Mapping[str, str]] = fixed.CATEGORICAL_FIELDS
) -> DataFrame:
    """All categorical fields of the frame in one projection."""
    return ads.withColumns({c: canonical(F.col(c), t) for c, t in fields.items() if c in ads.columns})


def normalise_brand(ads: DataFrame) -> DataFrame:
    return ads.withColumn("brand", F.coalesce(canonical_brand(F.col("brand")), F.col("brand")))


# Sane ranges.
MILEAGE_RANGE = (0, 999_999)
PRICE_RANGE = (10_000, 50_000_000)
YEAR_RANGE = (1970, 2027)


def reject_reason(price: Column) -> Column:
    """Why an ad is dropped; NULL when it is kept. A missing price is dropped as well."""
    low, high = PRICE_RANGE
    return F.when(price.isNull(), "price missing").when(price < low, "price too low").when(
        price > high, "price too high"
    )


def validate_ads(ads: DataFrame) -> DataFrame:
    """Drop garbage prices; blank out impossible mileage and year."""
    mileage, year = F.col("mileage"), F.col("year")
    return ads.filter(reject_reason(F.col("price")).isNull()).withColumns(
        {
            "mileage": F.when(mileage.between(*MILEAGE_RANGE), mileage),
            "year": F.when(year.between(*YEAR_RANGE), year).otherwise(F.lit(0)),
        }
    )


def rejected_ads(ads: DataFrame) -> DataFrame:
    """The ads ``validate_ads`` drops, with the reason."""
    return ads.withColumn("reason", reject_reason(F.col("price"))).filter(F.col("reason").isNotNull())


def normalise_ads(ads: DataFrame) -> DataFrame:
    """Full normalisation of incoming ads: brand, categoricals, limits, derived photo count and dealer flag."""
    out = validate_ads(normalise_categoricals(normalise_brand(ads)))
    if "photos" in out.columns:
        out = out.withColumn("photo_count", F.coalesce(F.array_size("photos"), F.lit(0)))
    if "seller_type" in out.columns:
        known = F.col("is_dealer") if "is_dealer" in out.columns else F.lit(False)
        out = out.withColumn(
            "is_dealer",
            F.when(F.col("seller_type").isNotNull(), is_dealer_type(F.col("seller_type"))).otherwise(known),
        )
    return out
