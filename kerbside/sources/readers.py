"""Reading listings and uniting marketplaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from kerbside.common import union_all
from kerbside.schema import LISTING


def scan_listings(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored listings with the declared schema; unused columns never leave the files."""
    listings = spark.read.schema(LISTING).parquet(path)
    return listings.select(*columns) if columns else listings


def scan_listings_with_analysis(listings: DataFrame, analysis: DataFrame) -> DataFrame:
    """Listings with their analysis, NULL where there is none."""
    return listings.join(analysis, "listing_id", "left")


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Ads of all marketplaces in one frame; columns a source lacks are NULL."""
    return union_all(sources)
