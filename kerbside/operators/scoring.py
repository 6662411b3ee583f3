"""Attractiveness (0-10) and deal score (0-100)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import missing, seconds_between
from kerbside.functions.text import red_flag_hit
from kerbside.operators.features import category_base


def price_ratio(price: Column, market: Column) -> Column:
    return F.when(market > 0, F.round(price / market, 3))


def diff_from_ratio(ratio: Column) -> Column:
    return F.round((1 - ratio) * 100, 2)


def attractiveness(category: Column, confidence: Column, ratio: Column) -> Column:
    """Category and discount, five points each, damped by the confidence; 0 to 10, one decimal."""
    discount = F.greatest(1 - ratio, F.lit(0.0))
    by_price = F.when(ratio > 0, F.least(discount * 2, F.lit(1.0)) * 5).otherwise(F.lit(2.5))
    raw = (category_base(category) * 5 + by_price) * (F.lit(0.7) + confidence * 0.3)
    return F.round(F.greatest(F.least(raw, F.lit(10.0)), F.lit(0.0)), 1)


def deal_components(as_of: Column, current_year: int = fixed.CURRENT_YEAR) -> dict[str, Column]:
    """Additive parts of the deal score, each a named column.

    Reads price_diff_pct, year, category, mileage, photo_count, body_type, created_at, owners_count, price.
    """
    diff, year, mileage = F.col("price_diff_pct"), F.col("year"), F.col("mileage")
    known_year = F.coalesce(F.nullif(year, F.lit(0)), F.lit(current_year))
    age = F.lit(current_year) - known_year
    damping = F.when(age > 15, 0.5).when(age > 10, 0.75).otherwise(1.0)
    clamped = F.greatest(F.least(diff, F.lit(30.0)), F.lit(-30.0))
    per_year = km_per_year(current_year)
    hours = seconds_between(as_of, F.col("created_at")) / 3600
    gaps = missing_fields()
    price = F.coalesce("price", F.lit(0))
    zero = F.lit(0.0)
    return {
        "part_price": F.coalesce(clamped * damping * 1.5, zero),
        "part_category": F.when(F.col("category") == "clean", 10.0)
        .when(F.col("category") == "complex_but_profitable", 5.0)
        .otherwise(zero),
        "part_mileage": F.when(per_year < 10_000, 5.0).when(per_year > 30_000, -5.0).otherwise(zero),
        "part_photos": F.when(F.col("photo_count") > 10, 5.0).when(F.col("photo_count") > 5, 3.0).otherwise(zero),
        "part_gaps": F.when(gaps >= 2, -8.0).when(gaps == 1, -3.0).otherwise(zero),
        "part_fresh": F.when(hours < 6, 8.0).when(hours < 24, 4.0).when(hours > 72, -3.0).otherwise(zero),
        "part_owners": F.when(F.col("owners_count") == 1, 5.0).when(F.col("owners_count") >= 4, -5.0).otherwise(zero),
        "part_cheap": F.when((price > 0) & (price < 200_000), -5.0).otherwise(zero),
    }


def missing_fields() -> Column:
    """How many of mileage, year and body type are missing."""
    body = F.coalesce("body_type", F.lit("")).isin("", "unknown")
    return missing(F.col("mileage")).cast("int") + missing(F.col("year")).cast("int") + body.cast("int")


def km_per_year(current_year: int = fixed.CURRENT_YEAR) -> Column:
    """NULL unless both mileage and year are known."""
    age = F.greatest(F.lit(current_year) - F.col("year"), F.lit(1))
    return F.when(~missing(F.col("mileage")) & ~missing(F.col("year")), F.col("mileage") / age)


def deal_cap(red_flag: Column, current_year: int = fixed.CURRENT_YEAR) -> Column:
    """Lowest of the hard caps that apply, 100 when none does."""
    none, gaps = F.lit(100.0), missing_fields()
    price = F.coalesce("price", F.lit(0))
    return F.least(
        none,
        F.when(gaps >= 2, 65.0).when(gaps == 1, 80.0).otherwise(none),
        F.when((price > 0) & (price < 100_000), 20.0).otherwise(none),
        F.when(F.col("category") == "damaged_body", 15.0)
        .when(F.col("category").isin("bad_docs", "debtor"), 10.0)
        .otherwise(none),
        F.when(F.col("mileage") >= 300_000, 30.0).when(F.col("mileage") >= 200_000, 55.0).otherwise(none),
        F.when(km_per_year(current_year) > 50_000, 40.0).otherwise(none),
        F.when(F.coalesce(red_flag, F.lit(False)), 15.0).otherwise(none),
    )


def text_red_flag() -> Column:
    """Red flag in the description or the address of the ad."""
    return red_flag_hit(F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("url", F.lit(""))))


def deal_score(
    listings: DataFrame, as_of: Column, red_flag: Column | None = None, current_year: int = fixed.CURRENT_YEAR
) -> DataFrame:
    """Add the component columns and ``deal_score``: 50 plus the parts, capped, clamped to 0-100 and truncated.

    ``red_flag`` may be a column computed earlier (say per description); by default the texts are read here.
    """
    parts = deal_components(as_of, current_year)
    flag = text_red_flag() if red_flag is None else red_flag
    total = sum((F.col(p) for p in parts), F.lit(50.0))
    capped = F.least(total, F.col("score_cap"))
    return (
        listings.withColumns(parts)
        .withColumn("score_cap", deal_cap(flag, current_year))
        .withColumn("deal_score", F.greatest(F.least(capped, F.lit(100.0)), F.lit(0.0)).cast("int"))
    )


def score_deals(
    listings: DataFrame, as_of: Column, red_flag: Column | None = None, current_year: int = fixed.CURRENT_YEAR
) -> DataFrame:
    """Deal score of every non-duplicate listing with a price, in one pass; others get NULL."""
    scored = deal_score(listings, as_of, red_flag, current_year)
    due = ~F.col("is_duplicate") & (F.col("price") > 0)
    dropped = [*deal_components(as_of, current_year), "score_cap"]
    return scored.withColumn("deal_score", F.when(due, F.col("deal_score"))).drop(*dropped)
