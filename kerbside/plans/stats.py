"""Statistics over the scored listings table; each is one aggregate pass with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.common import group_quantiles


def rounded_avg(value: Column, digits: int) -> Column:
    return F.coalesce(F.round(F.avg(value), digits), F.lit(0.0))


def overview_stats(listings: DataFrame, analysis: DataFrame) -> DataFrame:
    unique = ~F.col("is_duplicate")
    analysed = analysis.agg(F.count("*")).scalar()
    return (
        listings.agg(
            F.count("*").alias("total_listings"),
            F.count_if(unique).alias("unique_listings"),
            F.count_if(F.col("is_duplicate")).alias("duplicates"),
            F.count_if(unique & (F.col("deal_score") >= 70)).alias("hot_deals_count"),
            rounded_avg(F.col("price"), 0).alias("avg_price"),
            rounded_avg(F.col("price_diff_pct"), 2).alias("avg_discount"),
        )
        .withColumn("analyzed_count", analysed)
        .withColumn(
            "analyzed_pct",
            F.coalesce(F.round(F.try_divide(F.col("analyzed_count"), "unique_listings") * 100, 1), F.lit(0.0)),
        )
    )


def dashboard_stats(listings: DataFrame) -> DataFrame:
    diff = F.col("price_diff_pct")
    return listings.filter(~F.col("is_duplicate")).agg(
        F.count("*").alias("total"),
        F.count_if(diff > 0).alias("below_market"),
        F.count_if(diff > 15).alias("hot_deals"),
        F.round(F.avg(diff), 4).alias("avg_diff"),
        F.round(F.avg("price"), 4).alias("avg_price"),
    )


def coverage_stats(listings: DataFrame, analysis: DataFrame) -> DataFrame:
    analysed = analysis.agg(F.count("*")).scalar()
    base = listings.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_duplicate")).alias("total_unique"),
        F.count_if(F.col("is_duplicate")).alias("total_dupes"),
        F.count("market_price").alias("total_priced"),
        F.count_if((F.col("price_diff_pct") > 15) & ~F.col("is_duplicate")).alias("hot_deals"),
    ).withColumn("total_analyzed", analysed)

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.round(F.try_divide(part, whole) * 100, 1), F.lit(0.0))

    return base.withColumns(
        {"priced_pct": share("total_priced", "total"), "analyzed_pct": share("total_analyzed", "total_unique")}
    )


def count_by_source(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_duplicate")).alias("unique")
    )


def count_by_category(analysis: DataFrame) -> DataFrame:
    """Count and share per category; the share is taken over the few category rows."""
    counts = analysis.groupBy("category").agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share_pct", F.round(F.col("count") * 100 / whole, 1))


def top_groups(listings: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return (
        listings.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"), rounded_avg(F.col("price"), 0).alias("avg_price"))
        .orderBy(F.desc("count"), column)
        .limit(limit)
    )


def top_brands(listings: DataFrame, limit: int = 10) -> DataFrame:
    return top_groups(listings, "brand", limit)


def top_cities(listings: DataFrame, limit: int = 10) -> DataFrame:
    return top_groups(listings, "city", limit)


def brand_counts(listings: DataFrame) -> DataFrame:
    return listings.filter(~F.col("is_duplicate")).groupBy("brand").agg(F.count("*").alias("count"))


def city_counts_having(listings: DataFrame, at_least: int = 10) -> DataFrame:
    return (
        listings.filter(~F.col("is_duplicate") & F.col("city").isNotNull())
        .groupBy("city")
        .agg(F.count("*").alias("count"))
        .filter(F.col("count") >= at_least)
    )


def model_counts(listings: DataFrame, brand: str) -> DataFrame:
    return (
        listings.filter(~F.col("is_duplicate") & (F.lower("brand") == brand.lower()))
        .groupBy("model")
        .agg(F.count("*").alias("count"))
    )


def distinct_values(listings: DataFrame, column: str) -> DataFrame:
    return listings.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def price_buckets(listings: DataFrame, width: int = 250_000) -> DataFrame:
    low = (F.floor(F.col("price") / width) * width).cast("bigint")
    return (
        listings.filter(~F.col("is_duplicate"))
        .groupBy(low.alias("bucket_from"))
        .agg(F.count("*").alias("count"))
        .select("bucket_from", (F.col("bucket_from") + width).alias("bucket_to"), "count")
    )


def brand_stats(listings: DataFrame) -> DataFrame:
    return (
        listings.filter(~F.col("is_duplicate"))
        .groupBy("brand")
        .agg(
            F.count("*").alias("count"),
            F.round(F.avg("price"), 2).alias("avg_price"),
            F.round(F.avg("price_diff_pct"), 2).alias("avg_discount"),
        )
    )


def summary_stats(listings: DataFrame, as_of: Column) -> DataFrame:
    """Totals, averages, exact median price, and how many listings are from today and from the last seven days."""
    median = group_quantiles(listings.select("price"), [], "price", {"median_price": 0.5}).select("median_price")
    day = F.date_trunc("day", as_of)
    return listings.agg(
        F.count("*").alias("total_listings"),
        F.count_if(~F.col("is_duplicate")).alias("total_unique"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        F.round(F.avg("mileage"), 2).alias("avg_mileage"),
        F.round(F.avg("price_diff_pct"), 2).alias("avg_discount"),
        F.round(F.avg("deal_score"), 2).alias("avg_score"),
        F.count_if(F.col("created_at") >= day).alias("listings_today"),
        F.count_if(F.col("created_at") >= day - F.make_dt_interval(F.lit(7))).alias("listings_this_week"),
    ).withColumn("median_price", median.scalar())
