"""Defaults, derived features and sample weights of the price model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import lookup, seconds_between

CATEGORICAL = ["brand", "model", "source", "city", "engine_type", "transmission", "drive_type", "body_type"]
ZERO_IS_MISSING = ["mileage", "engine_volume", "power_hp", "owners_count"]

# Price and year limits of a training row.
TRAINING_PRICE = (50_000, 20_000_000)
TRAINING_FIRST_YEAR = 1990


def training_bounds(rows: DataFrame, current_year: int = fixed.CURRENT_YEAR) -> DataFrame:
    return rows.filter(
        F.col("price").between(*TRAINING_PRICE) & F.col("year").between(TRAINING_FIRST_YEAR, current_year + 1)
    )


def fill_defaults(rows: DataFrame) -> DataFrame:
    """Text 'unknown', year 2020, counts 0; a zero that cannot be real becomes NULL (never NaN)."""
    new: dict[str, Column] = {}
    for c in CATEGORICAL:
        new[c] = F.coalesce(F.col(c), F.lit("unknown")) if c in rows.columns else F.lit("unknown")
    for c, default in {"year": 2020, "photo_count": 0}.items():
        new[c] = F.coalesce(F.col(c), F.lit(default)).cast("int") if c in rows.columns else F.lit(default)
    new["is_dealer"] = F.coalesce(F.col("is_dealer").cast("int"), F.lit(0)) if "is_dealer" in rows.columns else F.lit(0)
    for c in ZERO_IS_MISSING:
        value = F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
        new[c] = F.nullif(value, F.lit(0.0))
    return rows.withColumns(new)


def derived_features(rows: DataFrame, current_year: int = fixed.CURRENT_YEAR) -> DataFrame:
    age = F.lit(current_year) - F.col("year")
    month_source = [c for c in ("listing_date", "created_at") if c in rows.columns][:1]
    month = F.coalesce(F.month(month_source[0]), F.lit(0)) if month_source else F.lit(0)
    return rows.withColumns(
        {
            "car_age": age,
            "log_car_age": F.ln(age.cast("double") + 1),
            "log_mileage": F.ln(F.col("mileage") + 1),
            "mileage_per_year": F.col("mileage") / F.greatest(age, F.lit(1)),
            "mileage_ratio": F.col("mileage") / (age * 15_000 + 1),
            "listing_month": month,
            "power_per_liter": F.when(
                F.col("engine_volume").isNotNull(),
                F.col("power_hp") / F.greatest(F.col("engine_volume"), F.lit(0.1)),
            ),
            "is_premium": F.lower("brand").isin(fixed.PREMIUM_BRANDS).cast("int"),
        }
    )


def extra_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "brand_model": F.concat_ws("_", "brand", "model"),
            "log_engine_volume": F.when(
                F.col("engine_volume").isNotNull(), F.ln(F.greatest(F.col("engine_volume"), F.lit(0.1)))
            ),
        }
    )


def time_decay_weight(as_of: Column, reference: Column, rate: float = 0.007) -> Column:
    """exp(-rate * days old); a missing date counts as today."""
    days = seconds_between(as_of, F.coalesce(reference, as_of)) / 86_400
    return F.exp(F.lit(-rate) * days)


def confidence_of(samples: Column) -> Column:
    return F.when(samples >= 50, "high").when(samples >= 15, "medium").otherwise("low")


def segment_sample_counts(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("brand", "model").agg(F.count("*").alias("samples"))
    return counts.withColumn("confidence", confidence_of(F.col("samples")))


def category_base(category: Column) -> Column:
    return F.coalesce(lookup(category, fixed.CATEGORY_BASE_SCORE), F.lit(0.5))
