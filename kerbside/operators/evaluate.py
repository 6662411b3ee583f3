"""Error measures of price predictions, weight search and model promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Price bands of the error report.
BANDS = [("<800K", 0, 800_000), ("800K-1.5M", 800_000, 1_500_000), (">1.5M", 1_500_000, 1_000_000_000)]


def relative_error(actual: Column, predicted: Column) -> Column:
    return F.abs((actual - predicted) / actual)


def mape(actual: Column, predicted: Column) -> Column:
    return F.avg(relative_error(actual, predicted)) * 100


def mape_overall(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(mape(F.col("price"), F.col("p50")), 4).alias("mape"))


def mae(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(F.avg(F.abs(F.col("price") - F.col("p50"))), 2).alias("mae"))


def mape_by_fold(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("fold").agg(
        F.count("*").alias("n"), F.round(mape(F.col("price"), F.col("p50")), 4).alias("mape")
    )


def price_band(price: Column) -> Column:
    band = F.lit(None).cast("string")
    for name, low, high in reversed(BANDS):
        band = F.when((price >= low) & (price < high), name).otherwise(band)
    return band


def mape_by_price_segment(predictions: DataFrame, min_rows: int = 20) -> DataFrame:
    return (
        predictions.withColumn("segment", price_band(F.col("price")))
        .filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(F.count("*").alias("n"), F.round(mape(F.col("price"), F.col("p50")), 1).alias("mape"))
        .filter(F.col("n") >= min_rows)
    )


def brand_mape(predictions: DataFrame, min_rows: int = 30) -> DataFrame:
    return (
        predictions.groupBy("brand")
        .agg(F.count("*").alias("n"), mape(F.col("price"), F.col("p50")).alias("mape"))
        .filter(F.col("n") >= min_rows)
    )


def mape_by_brand_top_bottom(
    predictions: DataFrame, worst: int = 7, best: int = 5, min_rows: int = 30
) -> DataFrame:
    """The brands predicted worst and best; two top-n on the small per-brand table."""
    by_brand = brand_mape(predictions, min_rows).withColumn("mape", F.round("mape", 4))
    bottom = by_brand.orderBy(F.desc("mape"), "brand").limit(worst).withColumn("side", F.lit("worst"))
    top = by_brand.orderBy("mape", "brand").limit(best).withColumn("side", F.lit("best"))
    return bottom.unionByName(top)


def weight_grid(step: float = 0.05) -> list[tuple[float, float, float]]:
    """Blend weights that sum to one: first from 0.20, second from 0.15, together at most 0.80."""
    whole, most = round(1 / step), round(0.80 / step)
    grid = []
    for a in range(round(0.20 / step), most + 1):
        for b in range(round(0.15 / step), most - a + 1):
            grid.append((round(a * step, 4), round(b * step, 4), round((whole - a - b) * step, 4)))
    return grid


def stack_weight_search(
    predictions: DataFrame, learners: tuple[str, str, str] = ("p_first", "p_second", "p_third"), step: float = 0.05
) -> DataFrame:
    """Error of every weight triple in one pass: one averaged expression per triple, no row is copied.

    The result has one row per triple, best first.
    """
    a, b, c = (F.col(name) for name in learners)
    grid = weight_grid(step)
    errors = [mape(F.col("price"), a * x + b * y + c * z).alias(f"e{i}") for i, (x, y, z) in enumerate(grid)]
    measured = predictions.agg(*errors)
    entries = [
        F.struct(
            F.lit(x).alias("w_first"),
            F.lit(y).alias("w_second"),
            F.lit(z).alias("w_third"),
            F.round(F.col(f"e{i}"), 6).alias("mape"),
        )
        for i, (x, y, z) in enumerate(grid)
    ]
    return measured.select(F.inline(F.array(*entries))).orderBy("mape", "w_first", "w_second")


def best_run(runs: DataFrame) -> DataFrame:
    """Lowest error among production runs; among all runs when none is in production. NULL with no runs."""
    score = F.col("p50_mape")
    return runs.filter(score.isNotNull() & ~F.isnan(score)).agg(
        F.coalesce(
            F.min(F.when(F.col("status") == "production", score)),
            F.min(score),
        ).alias("best_mape")
    )


def promotion(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Promote a candidate unless it is worse than the best run."""
    best = best_run(runs).scalar()
    worse = F.coalesce(F.col("p50_mape") > best, F.lit(False))
    return candidates.withColumn("best_mape", best).withColumn(
        "decision", F.when(F.col("p50_mape").isNull() | worse, "rejected").otherwise("production")
    )
