"""Market price from encodings, comparison with the asking price, and the ensemble of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups
from kerbside.operators.encode import LEVELS, attach_encodings
from kerbside.operators.features import confidence_of


def price_baseline(rows: DataFrame, encodings: dict[str, DataFrame], row_id: str = "listing_id") -> DataFrame:
    """Market price from the most specific encoding a row has: model year, model, brand, everything."""
    encoded = attach_encodings(rows, encodings, row_id)
    mean = encodings["global"].select("te").scalar()
    specific = F.coalesce("te_brand_model_year", "te_brand_model", "te_brand", mean)
    return encoded.withColumn("p50", F.floor(F.exp(specific)).cast("int")).drop(*[f"te_{level}" for level in LEVELS])


def with_sample_confidence(rows: DataFrame, counts: DataFrame, row_id: str = "listing_id") -> DataFrame:
    """Training rows of the row's make and model, and the confidence they give."""
    narrow = counts.select("brand", "model", "samples", F.col("samples").alias("__n"))
    out = attach_groups(rows, narrow, ["brand", "model"], rows="__n", spread_by=F.col(row_id))
    return out.withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint"))).withColumn(
        "confidence_level", confidence_of(F.col("samples"))
    )


def whole_price(prediction: Column) -> Column:
    """Prediction truncated to a whole, non-negative price."""
    return F.greatest(F.floor(prediction), F.lit(0)).cast("int")


def price_vs_market(price: Column, p50: Column) -> Column:
    """Per cent below market (positive = cheaper), one decimal; NULL unless both are positive."""
    return F.when((p50 > 0) & (price > 0), F.round((1 - price / p50) * 100, 1))


# Ratio of prediction to price beyond which a prediction is not written.
SANE_RATIO = (0.4, 2.5)
SANE_RATIO_LOW_CONFIDENCE = (0.55, 1.8)
DIFF_LIMIT = 999.99


def score_outcome(price: Column, p50: Column, confidence: Column) -> Column:
    ratio = p50 / price
    return (
        F.when(F.coalesce(p50, F.lit(0)) <= 0, "no_prediction")
        .when(~ratio.between(*SANE_RATIO), "skipped_sanity")
        .when((confidence == "low") & ~ratio.between(*SANE_RATIO_LOW_CONFIDENCE), "skipped_low_confidence")
        .otherwise("scored")
    )


def score_prices(rows: DataFrame, model=None) -> DataFrame:
    """Add ``market_price``, ``price_diff_pct`` and the outcome, from ``p50`` and ``confidence_level``.

    With a fitted ``model`` (anything whose ``predict`` adds the two) these come from it. Rows that already have a market price keep it; rows without a price or a plausible year are not scored.
    """
    if model is not None:
        given = [c for c in rows.columns if c not in ("p50", "samples", "confidence_level")]
        rows = model.predict(rows.select(*given)).select(*given, "p50", "samples", "confidence_level")
    has_before = "market_price" in rows.columns
    open_row = (F.col("price") > 0) & (F.col("year") >= 1990)
    if has_before:
        open_row = open_row & F.col("market_price").isNull()
    outcome = F.when(open_row, score_outcome(F.col("price"), F.col("p50"), F.col("confidence_level"))).otherwise("not_due")
    pct = F.greatest(F.least(price_vs_market(F.col("price"), F.col("p50")), F.lit(DIFF_LIMIT)), F.lit(-DIFF_LIMIT))
    scored = F.col("outcome") == "scored"
    old_price = F.col("market_price") if has_before else F.lit(None).cast("int")
    old_pct = F.col("price_diff_pct") if "price_diff_pct" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("outcome", outcome).withColumns(
        {
            "market_price": F.when(scored, F.col("p50")).otherwise(old_price),
            "price_diff_pct": F.when(scored, pct).otherwise(old_pct),
        }
    )


def score_counts(scored: DataFrame) -> DataFrame:
    names = ["scored", "skipped_sanity", "skipped_low_confidence", "no_prediction", "not_due"]
    return scored.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


# Ensemble weights (source estimate, comparables, model) per rule.
ENSEMBLE_WEIGHTS = {
    "source+comparable+model": (0.5, 0.3, 0.2),
    "source+model": (0.5, 0.0, 0.5),
    "source+comparable": (0.5, 0.5, 0.0),
    "comparable+model": (0.0, 0.5, 0.5),
    "model_heavy+comparable": (0.0, 0.3, 0.7),
    "model_only": (0.0, 0.0, 1.0),
    "comparable_only": (0.0, 1.0, 0.0),
    "source_only": (1.0, 0.0, 0.0),
}


def ensemble_price(rows: DataFrame) -> DataFrame:
    """Blend ``source_estimate``, ``median_price`` (with its ``comparables`` count) and ``p50`` for every row.

    The first rule whose inputs are there decides method and weights.
    """
    source, comp, model, n = (F.col(c) for c in ("source_estimate", "median_price", "p50", "comparables"))
    has_source, has_model = source.isNotNull(), model.isNotNull()
    has_comp = comp.isNotNull() & (n >= 1)
    enough = has_comp & (n >= 3)
    rules = {
        "source+comparable+model": has_source & enough & has_model,
        "source+model": has_source & has_model & ~enough,
        "source+comparable": has_source & enough,
        "comparable+model": enough & has_model,
        "model_heavy+comparable": has_comp & ~enough & has_model,
        "model_only": has_model,
        "comparable_only": has_comp,
        "source_only": has_source,
    }
    method = F.lit("none")
    price = F.lit(None).cast("double")
    for name, applies in reversed(rules.items()):
        ws, wc, wm = ENSEMBLE_WEIGHTS[name]
        terms = [value * weight for value, weight in ((source, ws), (comp, wc), (model, wm)) if weight]
        blend = terms[0] if len(terms) == 1 else sum(terms[1:], terms[0])
        method = F.when(applies, name).otherwise(method)
        price = F.when(applies, blend).otherwise(price)
    by_count = (
        F.when(n >= 10, 0.4).when(n >= 3, F.lit(0.2) + (n - 3) * 0.2 / 7).when(n >= 1, 0.1).otherwise(F.lit(0.0))
    )
    total = F.when(has_source, 0.4).otherwise(0.0) + F.when(has_model, 0.2).otherwise(0.0) + by_count
    return rows.withColumns(
        {
            "ensemble_price": F.floor(price).cast("int"),
            "ensemble_method": method,
            "ensemble_confidence": F.round(F.least(total, F.lit(1.0)), 2),
        }
    )


def stacked_p50(first: Column, second: Column, third: Column, weights=fixed.STACK_WEIGHTS) -> Column:
    """Weighted blend of three learners; a missing one is replaced by the first."""
    a, b, c = weights
    return first * a + F.coalesce(second, first) * b + F.coalesce(third, first) * c
