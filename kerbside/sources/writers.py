"""Export files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.common import blank_to_null
from kerbside.operators.extract import largest_image


def deals_export(listings: DataFrame, min_score: int = 60, limit: int = 500) -> DataFrame:
    """The 13 export columns of the best deals; at most 1000 rows."""
    from kerbside.plans.search import with_diff_or_none

    return (
        listings.filter(~F.col("is_duplicate") & (F.col("price") > 0) & (F.col("deal_score") >= min_score))
        .orderBy(F.col("deal_score").desc_nulls_last(), "listing_id")
        .limit(min(limit, 1000))
        .select(
            "brand",
            "model",
            "year",
            "price",
            "market_price",
            with_diff_or_none().alias("diff_%"),
            F.nullif(F.col("deal_score"), F.lit(0)).alias("deal_score"),
            F.nullif(F.col("mileage"), F.lit(0)).alias("mileage"),
            blank_to_null(F.col("body_type")).alias("body_type"),
            F.nullif(F.col("owners_count"), F.lit(0)).alias("owners"),
            blank_to_null(F.col("city")).alias("city"),
            "source",
            "url",
        )
    )


def export_deals_csv(listings: DataFrame, path: str, min_score: int = 60, limit: int = 500) -> None:
    """One CSV file with a header; the row cap keeps it small."""
    deals_export(listings, min_score, limit).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sheet_safe(value: Column) -> Column:
    """Text a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), value)).otherwise(value)


def ads_sheet(items: DataFrame, base_url: str = "https://cars.example", time_zone: str = "UTC") -> DataFrame:
    """The 14 export columns of catalogue items (``item`` struct plus seller_id, is_promoted and view counts)."""
    item = F.col("item")
    images = F.transform(
        F.coalesce(item["images"], F.array().cast("array<map<string,string>>")),
        lambda m: F.coalesce(largest_image(m), F.lit("")),
    )
    coords = F.coalesce(item["coords"], F.create_map().cast("map<string,string>"))
    lat, lng = F.try_element_at(coords, F.lit("lat")), F.try_element_at(coords, F.lit("lng"))

    def text(column: Column) -> Column:
        return sheet_safe(F.coalesce(column, F.lit("")))

    return items.select(
        sheet_safe(item["title"]).alias("title"),
        item["priceDetailed"]["value"].alias("price"),
        sheet_safe(F.concat(F.lit(f"{base_url}/"), item["urlPath"])).alias("url"),
        sheet_safe(item["description"]).alias("description"),
        F.from_utc_timestamp(F.timestamp_millis(item["sortTimeStamp"]), time_zone).alias("published"),
        text(F.col("seller_id")).alias("seller"),
        text(item["location"]["name"]).alias("address"),
        text(F.try_element_at(coords, F.lit("address_user"))).alias("user_address"),
        text(F.concat_ws(";", F.when(lng.isNotNull(), lat), F.when(lat.isNotNull(), lng))).alias("coordinates"),
        sheet_safe(F.array_join(images, ";")).alias("images"),
        F.when(F.col("is_promoted"), "Да").otherwise("Нет").alias("promoted"),
        F.nullif(F.col("total_views"), F.lit(0)).alias("total_views"),
        F.nullif(F.col("today_views"), F.lit(0)).alias("today_views"),
        text(item["phone"]).alias("phone"),
    )


def export_ads_sheet(items: DataFrame, path: str, **options) -> None:
    ads_sheet(items, **options).write.mode("overwrite").option("header", True).csv(path)


def link_key(url: Column) -> Column:
    """Host and the first ten hex digits of the address' md5."""
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.concat(host, F.lit("_"), F.substring(F.md5(url), 1, 10))


def link_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def export_partitioned_by_link(ads: DataFrame, path: str, link: str = "link", buckets: int = 64, rows_per_file: int = 1_000_000) -> None:
    """Ads by source link: one folder per hash bucket of links, sorted by link inside, so folders do not grow with links.

    Rows of a big link go to several tasks and files: a bucket is dealt over as many tasks as rows hash to.
    """
    keyed = ads.withColumn("link_key", link_key(F.col(link))).withColumn("bucket", link_bucket(F.col("link_key"), buckets))
    # maps cannot be hashed; the other columns tell rows of one link apart
    plain = [c for c, kind in ads.dtypes if "map<" not in kind]
    spread = keyed.repartition("bucket", F.pmod(F.xxhash64(*plain), F.lit(4)))
    laid = spread.sortWithinPartitions("bucket", "link_key")
    laid.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("bucket").parquet(path)


def read_link(spark: SparkSession, path: str, url: str, buckets: int = 64) -> DataFrame:
    """The exported ads of one link: one bucket's folder, of which the files' statistics leave the link's row groups."""
    wanted = spark.range(1).select(link_key(F.lit(url)).alias("k")).select("k", link_bucket(F.col("k"), buckets).alias("b")).first()
    return spark.read.parquet(path).filter((F.col("bucket") == wanted.b) & (F.col("link_key") == wanted.k))
