"""From listings to scored listings: dedup, training set, baseline price, discount, deal score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups, settle
from kerbside.functions.text import red_flag_hit
from kerbside.operators.clean import CleaningRules, clean_training_set
from kerbside.operators.dedup import cross_source_dedup
from kerbside.operators.encode import target_encoding
from kerbside.operators.features import training_bounds
from kerbside.operators.pricing import price_baseline, score_prices, with_sample_confidence
from kerbside.operators.scoring import attractiveness, price_ratio, score_deals


def with_analysis(rows: DataFrame, analysis: DataFrame) -> DataFrame:
    """Left join of what is known per listing, or per text: then ``analysis`` has no listing_id but the doc_id."""
    if "listing_id" in analysis.columns:
        return rows.join(analysis, "listing_id", "left")
    return attach_groups(rows, analysis, ["doc_id"])


def training_rows(marked: DataFrame, analysis: DataFrame, text_flags: DataFrame | None = None) -> DataFrame:
    """Unique listings with a price, without problem category; ``text_flags(doc_id, bars_training)`` bars texts."""
    key = "listing_id" if "listing_id" in analysis.columns else "doc_id"
    rows = with_analysis(marked.filter(~F.col("is_duplicate") & (F.col("price") > 0)), analysis.select(key, "category"))
    rows = rows.filter(~F.coalesce(F.col("category").isin(fixed.PROBLEM_CATEGORIES), F.lit(False)))
    if text_flags is not None:
        rows = attach_groups(rows, text_flags.select("doc_id", "bars_training"), ["doc_id"]).filter(
            ~F.coalesce("bars_training", F.lit(False))
        )
    return rows


def scored_listings(
    listings: DataFrame,
    analysis: DataFrame,
    as_of: Column,
    max_age_days: int = 60,
    text_flags: DataFrame | None = None,
    rules: CleaningRules = CleaningRules(),
    model=None,
) -> DataFrame:
    """The whole batch pipeline; prices come from a fitted ``model`` or else from the SQL-expressible baseline.

    ``text_flags`` (doc_id, red_flag, bars_training) holds what was read from the descriptions, each text once. ``analysis``
    has a listing_id or, where it is known per text, a doc_id.
    """
    marked = cross_source_dedup(listings)
    if text_flags is not None:
        text_flags = settle(text_flags)
    if model is None:
        # what cleaning and the encodings look at, computed once
        rows = settle(training_rows(marked, analysis, text_flags).select("listing_id", "brand", "model", "price", "mileage", "year", "city", "created_at"))
        train = training_bounds(clean_training_set(rows, as_of, replace(rules, max_age_days=max_age_days)))
        encodings = target_encoding(train)
        counts = encodings["brand_model"].select("brand", "model", F.col("n").alias("samples"))
        priced = with_sample_confidence(price_baseline(marked, encodings), counts)
        scored = score_prices(priced)
    else:
        scored = score_prices(marked, model)
    labelled = with_analysis(scored, analysis)
    flag = red_flag_hit(F.col("url"))
    if text_flags is not None:
        labelled = attach_groups(labelled, text_flags.select("doc_id", "red_flag"), ["doc_id"])
        flag = flag | F.coalesce("red_flag", F.lit(False))
    ratio = price_ratio(F.col("price"), F.col("market_price"))
    out = score_deals(labelled, as_of, flag).withColumn(
        "attractiveness",
        F.when(F.col("category").isNotNull(), attractiveness(F.col("category"), F.col("confidence"), ratio)),
    )
    return out.select(
        *marked.columns, "market_price", "price_diff_pct", "samples", "confidence_level", "outcome", "category",
        "confidence", "attractiveness", "deal_score",
    )
