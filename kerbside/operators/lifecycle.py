"""Staleness, enrichment queues and the analysis backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.common import blank_to_null, newest_first
from kerbside.operators.upsert import first_per_key


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def mark_stale(listings: DataFrame, as_of: Column, stale_days: int = 7) -> DataFrame:
    """Flag listings neither created nor re-seen within ``stale_days``; duplicates are left alone."""
    cutoff = days_before(as_of, stale_days)
    stale = (F.col("updated_at") < cutoff) & (F.col("created_at") < cutoff) & ~F.col("is_duplicate")
    return listings.withColumns(
        {"is_stale": F.coalesce(stale, F.lit(False)), "is_hidden": F.coalesce(stale, F.lit(False)) | F.col("is_duplicate")}
    )


def unenriched_listings(listings: DataFrame, source: str, limit: int, lacking: str = "body_type") -> DataFrame:
    """Newest listings of a source whose ``lacking`` column (body type, VIN) is still NULL or 'unknown'."""
    return (
        listings.filter(
            (F.col("source") == source)
            & ~F.col("is_duplicate")
            & (F.col(lacking).isNull() | (F.col(lacking) == "unknown"))
            & blank_to_null(F.col("url")).isNotNull()
        )
        .orderBy(*newest_first("created_at"), "listing_id")
        .limit(limit)
    )


def described_without_analysis(listings: DataFrame, analysis: DataFrame, include_duplicates: bool = False) -> DataFrame:
    """Listings with a description and no analysis row."""
    kept = listings if include_duplicates else listings.filter(~F.col("is_duplicate"))
    return kept.filter(blank_to_null(F.col("description")).isNotNull()).join(
        analysis.select("listing_id"), "listing_id", "left_anti"
    )


def analysis_backlog(listings: DataFrame, analysis: DataFrame) -> DataFrame:
    return described_without_analysis(listings, analysis).agg(F.count("*").alias("backlog"))


def analysis_candidates(
    listings: DataFrame, analysis: DataFrame, limit: int = 50, include_duplicates: bool = False
) -> DataFrame:
    """Newest listings to analyse, with the text to send."""
    text = F.concat_ws("\n", blank_to_null(F.col("title")), F.col("description"))
    fallback = F.concat_ws(" ", "brand", "model", F.col("year").cast("string"))
    return (
        described_without_analysis(listings, analysis, include_duplicates)
        .orderBy(*newest_first("created_at"), "listing_id")
        .limit(limit)
        .select("listing_id", F.coalesce(blank_to_null(text), fallback).alias("text"), "price", "created_at")
    )


def analysis_run_metrics(workers: DataFrame, keep_errors: int = 10) -> DataFrame:
    """Totals over worker rows (processed, failed, errors array) and the first errors in worker order.

    Only ``keep_errors`` rows are ever gathered: each worker contributes at most that many, and the global first
    ones come from a top-n, not from a collected array.
    """
    totals = workers.agg(
        F.count("*").alias("workers"),
        F.sum("processed").alias("total_processed"),
        F.sum("failed").alias("total_failed"),
    )
    first = (
        workers.select("worker_name", F.posexplode(F.slice("errors", 1, keep_errors)).alias("pos", "error"))
        .orderBy("worker_name", "pos")
        .limit(keep_errors)
        .agg(F.array_sort(F.collect_list(F.struct("worker_name", "pos", "error"))).alias("e"))
        .select(F.transform("e", lambda x: x["error"]))
    )
    return totals.withColumn("total_errors", first.scalar())


def insert_analysis(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append analysis rows whose listing has none yet; of several for one listing the smallest row."""
    fresh = first_per_key(incoming, ["listing_id"]).join(stored.select("listing_id"), "listing_id", "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)
