"""Bands, labels and ages shown next to a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import lookup, seconds_between


def listing_age_label(created_at: Column, as_of: Column) -> Column:
    hours = seconds_between(as_of, created_at) / 3600
    return F.when(created_at.isNull(), "—").when(hours < 1, "< 1ч").when(hours < 24, "< 24ч").otherwise("> 24ч")


def age_minutes(created_at: Column, as_of: Column) -> Column:
    return F.round(seconds_between(as_of, created_at) / 60, 1)


def diff_band(diff_pct: Column) -> Column:
    """Five bands of the discount; NULL stays NULL."""
    return (
        F.when(diff_pct > 15, "hot")
        .when(diff_pct > 5, "good")
        .when(diff_pct > 0, "ok")
        .when(diff_pct > -10, "neutral")
        .when(diff_pct.isNotNull(), "bad")
    )


def diff_bar_width(diff_pct: Column) -> Column:
    """Discount clamped to ±30 on a 0-100 bar, truncated."""
    clamped = F.least(F.greatest(diff_pct, F.lit(-30.0)), F.lit(30.0))
    return F.when(diff_pct.isNotNull(), F.floor((clamped + 30) / 60 * 100).cast("int"))


def row_band(diff_pct: Column, category: Column) -> Column:
    return (
        F.when(diff_pct > 15, "hot")
        .when(diff_pct > 5, "good")
        .when(category.isin(fixed.PROBLEM_CATEGORIES), "bad")
        .when(category == "complex_but_profitable", "complex")
        .otherwise("")
    )


def score_band(score: Column, cuts: tuple[float, float, float]) -> Column:
    """hot / good / mid / low by three descending cuts: (7, 5, 3) attractiveness, (80, 60, 40) deal score."""
    hot, good, mid = cuts
    return F.when(score >= hot, "hot").when(score >= good, "good").when(score >= mid, "mid").when(
        score.isNotNull(), "low"
    )


def alert_score_band(score: Column) -> Column:
    return F.when(score >= 80, "star").when(score >= 60, "thumb").when(score.isNotNull(), "chart")


def category_label(category: Column, labels: dict[str, str] = fixed.CATEGORY_LABELS) -> Column:
    return F.coalesce(lookup(category, labels), category)


def price_steps(history: Column) -> Column:
    """Change between each history entry and the next, with its direction."""
    last = F.array_size(history) - 1
    return F.when(
        last >= 1,
        F.transform(
            F.sequence(F.lit(0), last - 1),
            lambda i: F.struct(
                F.get(history, i)["price"].alias("price"),
                (F.get(history, i)["price"] - F.get(history, i + 1)["price"]).alias("change"),
                F.when(F.get(history, i)["price"] < F.get(history, i + 1)["price"], "down")
                .when(F.get(history, i)["price"] > F.get(history, i + 1)["price"], "up")
                .otherwise("same")
                .alias("direction"),
            ),
        ),
    )
