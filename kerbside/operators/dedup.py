"""The same item advertised on several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.common import attach_groups, blank_to_null

MATCH = ["__brand", "__model", "__year", "__city", "__price", "__mileage"]


def _match_columns(mileage_tolerance: int) -> dict[str, Column]:
    mileage = F.coalesce(F.col("mileage"), F.lit(0))
    if mileage_tolerance > 0:
        mileage = F.floor(mileage / mileage_tolerance).cast("int")
    return {
        "__brand": F.lower("brand"),
        "__model": F.lower("model"),
        "__year": F.col("year"),
        "__city": F.lower("city"),
        "__price": F.col("price"),
        "__mileage": mileage,
    }


def cross_source_groups(listings: DataFrame, mileage_tolerance: int = 0) -> DataFrame:
    """Match keys that occur on more than one source, with the oldest listing of each.

    Every match condition but "different source" is an equality, so inside one key the oldest row is canonical and
    exactly the rows of other sources duplicate it. min(struct) and min/max combine map-side: a key shared by a
    third of all rows still reaches its reducer as one row per task.
    """
    oldest = F.min(F.struct("created_at", "listing_id", "source"))
    return (
        listings.filter(blank_to_null(F.col("city")).isNotNull())
        .select("created_at", "listing_id", "source", *[c.alias(n) for n, c in _match_columns(mileage_tolerance).items()])
        .groupBy(*MATCH)
        .agg(
            oldest.alias("oldest"),
            F.min("source").alias("low"),
            F.max("source").alias("high"),
            F.count("*").alias("rows"),
        )
        .filter(F.col("low") != F.col("high"))
        .select(
            *MATCH,
            F.col("oldest.listing_id").alias("group_id"),
            F.col("oldest.source").alias("group_source"),
            "rows",
        )
    )


def cross_source_dedup(listings: DataFrame, mileage_tolerance: int = 0) -> DataFrame:
    """Add ``is_duplicate`` and ``canonical_id``; rows already flagged keep what they have.

    ``mileage_tolerance`` > 0 compares mileage in steps of that size; 0 means equal mileage.
    """
    groups = cross_source_groups(listings, mileage_tolerance)
    keyed = listings.withColumns(_match_columns(mileage_tolerance))
    joined = attach_groups(keyed, groups, MATCH, rows="rows", spread_by=F.col("listing_id"))
    found = F.coalesce((F.col("source") != F.col("group_source")) & (F.col("city") != ""), F.lit(False))
    before = F.coalesce(F.col("is_duplicate"), F.lit(False)) if "is_duplicate" in listings.columns else F.lit(False)
    kept_id = F.col("canonical_id") if "canonical_id" in listings.columns else F.lit(None).cast("bigint")
    rest = [c for c in listings.columns if c not in ("is_duplicate", "canonical_id")]
    return joined.select(
        *rest,
        (before | found).alias("is_duplicate"),
        F.when(before, kept_id).when(found, F.col("group_id")).alias("canonical_id"),
    )


def group_of(canonical_id: Column, listing_id: Column) -> Column:
    return F.coalesce(canonical_id, listing_id)


def duplicate_membership(marked: DataFrame) -> DataFrame:
    """Every listing in a group of two or more: group, role and group size. Linear in the rows, no pairs."""
    rows = marked.select("listing_id", "canonical_id", group_of(F.col("canonical_id"), F.col("listing_id")).alias("group_id"))
    sizes = (
        rows.filter(F.col("canonical_id").isNotNull())
        .groupBy("group_id")
        .agg((F.count("*") + 1).alias("group_size"))
    )
    joined = attach_groups(
        rows, sizes.withColumn("rows", F.col("group_size")), ["group_id"], rows="rows", spread_by=F.col("listing_id")
    )
    return joined.filter(F.col("group_size").isNotNull()).select(
        "group_id", "listing_id", F.col("canonical_id").isNull().alias("is_canonical"), "group_size"
    )


def duplicate_group_of(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each id in ``wanted`` (column listing_id): the other members of its group."""
    rows = marked.withColumn("group_id", group_of(F.col("canonical_id"), F.col("listing_id")))
    asked = rows.join(wanted.select("listing_id"), "listing_id", "left_semi").select(
        F.col("listing_id").alias("asked_id"), "group_id"
    )
    return asked.join(rows, "group_id").filter(F.col("listing_id") != F.col("asked_id"))
