"""Cleaning of the training set: freshness, IQR and MAD outliers, mileage and price sanity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups, group_quantiles, settle
from kerbside.operators.lifecycle import days_before

SEGMENT = ["brand", "model"]


@dataclass(frozen=True)
class CleaningRules:
    max_age_days: int = 60
    iqr_min_rows: int = 5
    iqr_factor: float = 1.5
    mad_min_rows: int = 10
    mad_limit: float = 3.5
    mad_floor: float = 1e-9
    km_per_year: int = 60_000
    sanity_min_rows: int = 100
    sanity_share: float = 0.3


def fresh(created_at: Column, as_of: Column, days: int) -> Column:
    return created_at >= days_before(as_of, days)


def iqr_bounds(rows: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Price bounds per segment with enough rows."""
    quartiles = group_quantiles(rows, SEGMENT, "price", {"q1": 0.25, "q3": 0.75})
    spread = F.lit(rules.iqr_factor) * (F.col("q3") - F.col("q1"))
    return quartiles.filter(F.col("n") >= rules.iqr_min_rows).select(
        *SEGMENT, "n", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")
    )


def _attach(rows: DataFrame, groups: DataFrame, settled: bool = False) -> DataFrame:
    return attach_groups(rows, groups, SEGMENT, rows="n", spread_by=F.col("listing_id"), settled=settled)


def with_iqr_flag(rows: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Adds ``iqr_outlier``; small segments are never outliers."""
    bounded = _attach(rows, iqr_bounds(rows, rules))
    outside = ~F.col("price").between(F.col("low"), F.col("high"))
    return bounded.withColumn("iqr_outlier", F.coalesce(outside, F.lit(False))).drop("low", "high")


def mad_stats(rows: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Median of ln(price) per segment and the median absolute deviation from it."""
    logged = rows.select(*SEGMENT, "listing_id", F.ln("price").alias("__ln"))
    medians = group_quantiles(logged, SEGMENT, "__ln", {"median_ln": 0.5})
    away = _attach(logged, medians).withColumn("__away", F.abs(F.col("__ln") - F.col("median_ln")))
    mads = group_quantiles(away, [*SEGMENT, "median_ln"], "__away", {"mad": 0.5})
    return mads.filter((F.col("n") >= rules.mad_min_rows) & (F.col("mad") >= rules.mad_floor))


def with_mad_flag(rows: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Adds ``mad_outlier``: |ln price - median| / MAD above the limit, without the usual 0.6745 factor."""
    scored = _attach(rows, mad_stats(rows, rules))
    far = F.abs(F.ln("price") - F.col("median_ln")) / F.col("mad") > rules.mad_limit
    return scored.withColumn("mad_outlier", F.coalesce(far, F.lit(False))).drop("median_ln", "mad")


def bad_mileage(
    current_year: int = fixed.CURRENT_YEAR, limit: int = CleaningRules.km_per_year
) -> Column:
    """More kilometres a year than plausible; an unknown mileage is not bad."""
    age = F.when(F.col("year").isNotNull(), F.greatest(F.lit(current_year) - F.col("year"), F.lit(1)))
    return F.coalesce(F.col("mileage") / age > limit, F.lit(False))


def segment_medians(rows: DataFrame) -> DataFrame:
    return group_quantiles(rows, SEGMENT, "price", {"median_price": 0.5})


def with_segment_median(rows: DataFrame) -> DataFrame:
    return _attach(rows, segment_medians(rows))


def with_price_sanity_flag(rows: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Adds ``price_suspicious``: far below the segment median, only in a set of more than ``sanity_min_rows``."""
    enough = rows.agg(F.count("*") > rules.sanity_min_rows).scalar()
    low = enough & (F.col("price") < F.col("median_price") * rules.sanity_share)
    return with_segment_median(rows).withColumn("price_suspicious", F.coalesce(low, F.lit(False))).drop("median_price")


STEPS = ["stale", "iqr_outlier", "mad_outlier", "bad_mileage", "price_suspicious"]


def cleaning_reasons(
    rows: DataFrame, as_of: Column, rules: CleaningRules = CleaningRules(), current_year: int = fixed.CURRENT_YEAR
) -> DataFrame:
    """Every row with the first step that removes it in ``removed_by`` (NULL = kept).

    Each step's statistics come from the survivors of the steps before it. They are worked out on a narrow copy of
    the rows that is computed once; the statistics are small tables joined onto the full rows, which are therefore
    read once and never shuffled by segment.
    """
    reason = F.when(~fresh(F.col("created_at"), as_of, rules.max_age_days), "stale")
    full = rows.withColumn("removed_by", reason)
    narrow = settle(full.select("listing_id", *SEGMENT, "price", "mileage", "year", "removed_by"))

    def alive() -> DataFrame:
        return narrow.filter(F.col("removed_by").isNull())

    def mark(frame: DataFrame, flag: str, test: Column) -> DataFrame:
        hit = F.col("removed_by").isNull() & F.coalesce(test, F.lit(False))
        return frame.withColumn("removed_by", F.when(hit, flag).otherwise(F.col("removed_by")))

    def step(flag: str, stats: DataFrame, test: Column) -> None:
        nonlocal full, narrow
        stats = settle(stats)
        added = [c for c in stats.columns if c not in (*SEGMENT, "n")]
        narrow = mark(_attach(narrow, stats, settled=True), flag, test).drop(*added)
        full = mark(_attach(full, stats, settled=True), flag, test).drop(*added)

    step("iqr_outlier", iqr_bounds(alive(), rules), ~F.col("price").between(F.col("low"), F.col("high")))
    far = F.abs(F.ln("price") - F.col("median_ln")) / F.col("mad") > rules.mad_limit
    step("mad_outlier", mad_stats(alive(), rules), far)
    worn = bad_mileage(current_year, rules.km_per_year)
    narrow, full = mark(narrow, "bad_mileage", worn), mark(full, "bad_mileage", worn)
    enough = settle(alive().agg((F.count("*") > rules.sanity_min_rows).alias("enough"))).scalar()
    cheap = enough & (F.col("price") < F.col("median_price") * rules.sanity_share)
    step("price_suspicious", segment_medians(alive()), cheap)
    return full


def clean_training_set(
    rows: DataFrame, as_of: Column, rules: CleaningRules = CleaningRules(), current_year: int = fixed.CURRENT_YEAR
) -> DataFrame:
    """The rows no cleaning step removes."""
    return cleaning_reasons(rows, as_of, rules, current_year).filter(F.col("removed_by").isNull()).drop("removed_by")


def cleaning_report(reasons: DataFrame) -> DataFrame:
    """Rows in, rows removed per step and rows kept, in one pass."""
    return reasons.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("removed_by") == step).alias(f"removed_{step}") for step in STEPS],
        F.count_if(F.col("removed_by").isNull()).alias("kept"),
    )
