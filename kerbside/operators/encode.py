"""Smoothed target encoding of ln(price), in sample and out of fold, and category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups, settle

LEVELS = {
    "brand_model_year": ["brand", "model", "year"],
    "brand_model": ["brand", "model"],
    "brand": ["brand"],
    "city": ["city"],
}


def log_price_sums(rows: DataFrame) -> DataFrame:
    """Sums of ln(price) at the finest grain any level needs: one scan, one map-side combined shuffle."""
    return rows.groupBy("brand", "model", "year", "city").agg(
        F.sum(F.ln("price")).alias("ln_sum"), F.count("*").alias("n")
    )


def smoothed(ln_sum: Column, n: Column, strength: Column, global_mean: Column) -> Column:
    """(n * mean + a * global) / (n + a), written on the sum."""
    return (ln_sum + strength * global_mean) / (n + strength)


def global_log_mean(sums: DataFrame) -> Column:
    return sums.agg(F.sum("ln_sum") / F.sum("n")).scalar()


def target_encoding(rows: DataFrame, smoothing: dict[str, int] = fixed.ENCODING_SMOOTHING) -> dict[str, DataFrame]:
    """One table per level: key columns, ``te`` and the row count ``n``. Levels roll up from one settled table."""
    sums = settle(log_price_sums(rows))
    mean = global_log_mean(sums)
    return {
        level: sums.groupBy(*keys)
        .agg(F.sum("ln_sum").alias("s"), F.sum("n").alias("n"))
        .select(*keys, smoothed(F.col("s"), F.col("n"), F.lit(smoothing[level]), mean).alias("te"), "n")
        for level, keys in LEVELS.items()
    } | {"global": sums.agg((F.sum("ln_sum") / F.sum("n")).alias("te"), F.sum("n").alias("n"))}


def attach_encodings(rows: DataFrame, tables: dict[str, DataFrame], row_id: str = "listing_id") -> DataFrame:
    """Add ``te_<level>``, NULL where the key was never seen in training."""
    out = rows
    for level, keys in LEVELS.items():
        values = tables[level].select(*keys, F.col("te").alias(f"te_{level}"), F.col("n").alias("__n"))
        out = attach_groups(out, values, keys, rows="__n", spread_by=F.col(row_id))
    return out


def apply_target_encoding(rows: DataFrame, tables: dict[str, DataFrame], row_id: str = "listing_id") -> DataFrame:
    """Add ``te_<level>``; a key never seen in training gets the global mean."""
    mean = tables["global"].select("te").scalar()
    return attach_encodings(rows, tables, row_id).withColumns(
        {f"te_{level}": F.coalesce(f"te_{level}", mean) for level in LEVELS}
    )


def target_encoding_oof(
    rows: DataFrame, keys: Sequence[str], fold: str, smoothing: int, row_id: str = "listing_id"
) -> DataFrame:
    """Out-of-fold encoding without a pass per fold: key totals minus the key's own fold.

    The smoothing mean is the mean over all rows, as in the in-sample version.
    """
    table = target_encoding_oof_table(rows, keys, fold, smoothing)
    return attach_groups(rows, table, [*keys, fold], rows="n", spread_by=F.col(row_id))


def target_encoding_oof_table(rows: DataFrame, keys: Sequence[str], fold: str, smoothing: int) -> DataFrame:
    """(keys, fold, ``te_oof``, ``n``): what ``target_encoding_oof`` attaches to the rows."""
    keys = list(keys)
    by_fold = settle(
        rows.groupBy(*keys, fold).agg(F.sum(F.ln("price")).alias("s"), F.count("*").alias("n"))
    )
    mean = by_fold.agg(F.sum("s") / F.sum("n")).scalar()
    totals = by_fold.groupBy(*keys).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return (
        by_fold.join(totals, keys)
        .withColumns({"os": F.col("ts") - F.col("s"), "on": F.col("tn") - F.col("n")})
        .select(
            *keys,
            fold,
            F.when(F.col("on") > 0, smoothed(F.col("os"), F.col("on"), F.lit(smoothing), mean))
            .otherwise(mean)
            .alias("te_oof"),
            "n",
        )
    )


def category_codes(values: DataFrame, column: str) -> DataFrame:
    """Distinct categories with a dense integer code in alphabetical order.

    The distinct values are range-partitioned and numbered by partition offset, so no single task sorts them all.
    """
    distinct = settle(
        values.select(column)
        .filter(F.col(column).isNotNull())
        .distinct()
        .repartitionByRange(column)
        .withColumn("__part", F.spark_partition_id())
    )
    # one small row per partition
    sizes = distinct.groupBy("__part").agg(F.count("*").alias("c"))
    offsets = sizes.select(
        "__part",
        (F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("off"),
    )
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return (
        distinct.withColumn("inside", inside)
        .join(F.broadcast(offsets), "__part")
        .select(column, (F.col("off") + F.col("inside")).cast("int").alias("code"))
    )


def apply_category_codes(rows: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Code per row; -1 for NULL and for categories not in the table."""
    out = attach_groups(rows, codes, [column])
    return out.withColumn(f"{column}_code", F.coalesce("code", F.lit(-1))).drop("code")
