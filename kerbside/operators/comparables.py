"""Nearest comparable listings per listing, and the price range they imply.

The distance depends only on a listing's profile (year, mileage, engine volume) inside its make and model, so the
work is done on distinct profiles, never on pairs of listings:

1. candidates collapse to profiles, each keeping its k cheapest members (a partial top-k before the shuffle);
2. target profiles meet the candidate *classes* (make, model, year within two, engine volume); inside a class the
   distance only grows with the mileage gap, so the k nearest profiles on either side contain the answer. A class is cut
   into mileage buckets as wide as the reach: a target finds all it needs in its own bucket and the two next to it, so
   candidates enter three buckets each. A window over one such bucket in mileage order gives each target its position, and an
   equi-join on (class, bucket, position) fetches just those neighbours: no cross join, no all-pairs, and no window beyond
   one bucket, however many listings a model has;
3. the nearest profiles are opened into their members until k are reached.

Mileage is an integer, so a bucket holds at most 90 000 profiles of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups, settle
from kerbside.operators.lifecycle import days_before

MODEL = ["b", "m"]
PROFILE = ["b", "m", "y", "km", "vol"]
YEAR_REACH = 2
MILEAGE_REACH = 30_000


def distance(y1: Column, km1: Column, v1: Column, y2: Column, km2: Column, v2: Column) -> Column:
    """Weighted squared distance: years in units of two, ln of mileage (floor 1), engine volume in half litres."""
    w = fixed.NEIGHBOUR_WEIGHTS
    years = F.abs(y1 - y2) / 2
    logs = F.abs(F.ln(F.greatest(km1, F.lit(1))) - F.ln(F.greatest(km2, F.lit(1))))
    litres = F.abs(v1 - v2) / 0.5
    return years * years * w["year"] + logs * logs * w["mileage"] + litres * litres * w["engine"]


def eligible(listings: DataFrame, as_of: Column, max_age_days: int = 60) -> DataFrame:
    """Listings that may serve as comparables."""
    return listings.filter(
        ~F.col("is_duplicate") & (F.col("created_at") >= days_before(as_of, max_age_days)) & (F.col("price") > 0)
    )


def _profile_columns() -> list[Column]:
    return [
        F.lower("brand").alias("b"),
        F.lower("model").alias("m"),
        F.col("year").alias("y"),
        F.col("mileage").alias("km"),
        F.coalesce("engine_volume", F.lit(0.0)).alias("vol"),
    ]


def bucket(mileage: Column) -> Column:
    """Mileage bucket, as wide as the reach."""
    return F.floor(mileage / MILEAGE_REACH).cast("int")


def bucketed(candidates: DataFrame, targets: DataFrame, mileage: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``bucket``: targets in their own, candidates in their own and the two next to it."""
    own = bucket(F.col(mileage))
    return candidates.withColumn("bucket", F.explode(F.array(own - 1, own, own + 1))), targets.withColumn("bucket", own)


def nearest_profiles(listings: DataFrame, candidates: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(target profile, rank, candidate profile, distance) rows covering the k nearest members, and the members."""
    cheapest = Window.partitionBy(*PROFILE).orderBy("price", "listing_id")
    members = settle(
        candidates.select(*_profile_columns(), "price", "listing_id", F.col("source").alias("src"))
        .withColumn("nth", F.row_number().over(cheapest))
        .filter(F.col("nth") <= k)
    )
    # km is NULL-able in a profile; a NULL candidate matches any target and counts as 0 km in the distance
    profiles = members.groupBy(*PROFILE).agg(F.count("*").alias("size"))
    targets = listings.select(*_profile_columns()).withColumn("km", F.coalesce("km", F.lit(0))).distinct()

    classes = profiles.select("b", "m", F.col("y").alias("cy"), "vol").distinct().withColumnRenamed("vol", "cvol")
    reach = F.sequence(F.col("y") - YEAR_REACH, F.col("y") + YEAR_REACH)
    probes = targets.withColumn("cy", F.explode(reach)).join(classes, ["b", "m", "cy"])

    of_class, in_class = ["b", "m", "cy", "cvol"], ["b", "m", "cy", "cvol", "bucket"]
    known = profiles.filter(F.col("km").isNotNull()).select(
        "b", "m", F.col("y").alias("cy"), F.col("vol").alias("cvol"), F.col("km").alias("ckm"), "size"
    )
    known, near = bucketed(known.withColumnRenamed("ckm", "km"), probes, "km")
    known = known.withColumnRenamed("km", "ckm")
    numbered = known.withColumn("pos", F.row_number().over(Window.partitionBy(*in_class).orderBy("ckm")))

    # one line per class and bucket: candidates and probes together, counted in mileage order
    line = known.select(*in_class, F.col("ckm").alias("at"), F.lit(1).alias("is_candidate")).unionByName(
        near.select(*in_class, F.col("km").alias("at"), "y", "vol", F.lit(0).alias("is_candidate")),
        allowMissingColumns=True,
    )
    # running counts only: frames that start at the bucket's first row are updated row by row, never recomputed
    by_km = Window.partitionBy(*in_class).orderBy("at")

    def counted_to(shift: int) -> Column:
        frame = by_km.rangeBetween(Window.unboundedPreceding, shift)
        return F.coalesce(F.sum("is_candidate").over(frame), F.lit(0))

    counted = (
        line.select(
            "*",
            counted_to(0).alias("upto"),
            counted_to(-MILEAGE_REACH - 1).alias("before"),
            counted_to(MILEAGE_REACH).alias("after"),
        )
        .filter(F.col("is_candidate") == 0)
        .withColumns({"below": F.col("upto") - F.col("before"), "above": F.col("after") - F.col("upto")})
    )
    first = F.col("upto") - F.least(F.col("below"), F.lit(k)) + 1
    last = F.col("upto") + F.least(F.col("above"), F.lit(k))
    wanted = counted.filter(first <= last).select(
        *in_class, "y", "vol", F.col("at").alias("km"), F.explode(F.sequence(first, last)).alias("pos")
    )
    by_mileage = wanted.join(numbered, [*in_class, "pos"]).select(
        *MODEL, "y", "km", "vol", "cy", "ckm", "cvol", "size"
    )
    unknown = profiles.filter(F.col("km").isNull()).select(
        "b", "m", F.col("y").alias("cy"), F.col("vol").alias("cvol"), F.col("km").alias("ckm"), "size"
    )
    without_mileage = probes.join(unknown, of_class).select(*MODEL, "y", "km", "vol", "cy", "ckm", "cvol", "size")
    pairs = by_mileage.unionByName(without_mileage).withColumns(
        {
            "distance": F.round(
                distance(
                    F.col("y"), F.col("km"), F.col("vol"), F.col("cy"), F.coalesce("ckm", F.lit(0)), F.col("cvol")
                ),
                6,
            ),
            "gap": F.coalesce(F.abs(F.col("km") - F.col("ckm")), F.lit(1_000_000)),
        }
    )
    # equal (distance, gap) profiles are opened together, so ties between them are settled by price below
    ranked = Window.partitionBy(*PROFILE).orderBy("distance", "gap")
    ahead = F.coalesce(F.sum("size").over(ranked.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    tied = F.sum("size").over(Window.partitionBy(*PROFILE, "distance", "gap"))
    return pairs.withColumn("ahead", ahead - tied).filter(F.col("ahead") < k).drop("ahead"), members


def nearest_members(listings: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest candidates of each target profile, ranked by (distance, mileage gap, price, id)."""
    pairs, members = nearest_profiles(listings, candidates, k)
    named = members.select(
        *MODEL,
        F.col("y").alias("cy"),
        F.col("vol").alias("cvol"),
        F.coalesce("km", F.lit(-1)).alias("member_km"),
        "price",
        F.col("listing_id").alias("comparable_id"),
        "src",
    )
    opened = pairs.withColumn("member_km", F.coalesce("ckm", F.lit(-1))).join(named, [*MODEL, "cy", "cvol", "member_km"])
    order = Window.partitionBy(*PROFILE).orderBy("distance", "gap", "price", "comparable_id")
    return (
        opened.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            *PROFILE,
            "rank",
            "comparable_id",
            "price",
            F.col("src").alias("source"),
            F.col("cy").alias("comparable_year"),
            F.coalesce("ckm", F.lit(0)).alias("comparable_mileage"),
            "distance",
        )
    )


def with_profile(listings: DataFrame) -> DataFrame:
    """The target side of the profile key; an unknown mileage counts as 0."""
    return listings.withColumns(
        {
            "b": F.lower("brand"),
            "m": F.lower("model"),
            "y": F.col("year"),
            "km": F.coalesce("mileage", F.lit(0)),
            "vol": F.coalesce("engine_volume", F.lit(0.0)),
        }
    )


def _attach_profiles(listings: DataFrame, values: DataFrame) -> DataFrame:
    rows = attach_groups(with_profile(listings), values, PROFILE, rows="rows", spread_by=F.col("listing_id"))
    return rows.drop(*PROFILE)


def _with_rows(values: DataFrame, listings: DataFrame) -> DataFrame:
    """Add how many listings share each profile, which is what tells a hot profile."""
    return values.join(with_profile(listings).groupBy(*PROFILE).agg(F.count("*").alias("rows")), PROFILE)


def knn_topk(
    listings: DataFrame,
    as_of: Column,
    k: int = 10,
    max_age_days: int = 60,
    include_self: bool = True,
    pool: DataFrame | None = None,
) -> DataFrame:
    """The k nearest comparables of every listing. ``pool`` is where they are sought (default: the same listings)."""
    candidates = eligible(listings if pool is None else pool, as_of, max_age_days)
    reach = k if include_self else k + 1
    nearest = nearest_members(listings, candidates, reach)
    entry = F.struct("rank", "comparable_id", "price", "source", "comparable_year", "comparable_mileage", "distance")
    # at most k (+1) entries per profile
    lists = nearest.groupBy(*PROFILE).agg(F.array_sort(F.collect_list(entry)).alias("near"))
    rows = _attach_profiles(listings.select("listing_id", "brand", "model", "year", "mileage", "engine_volume"),
                            _with_rows(lists, listings))
    near = F.col("near")
    if not include_self:
        others = F.filter(near, lambda e: e["comparable_id"] != F.col("listing_id"))
        near = F.transform(F.slice(others, 1, k), lambda e, i: e.withField("rank", (i + 1).cast("int")))
    return rows.select("listing_id", F.inline(near))


def _interpolated(prices: Column, p: float) -> Column:
    at = F.lit(p) * (F.array_size(prices) - 1)
    low, high = F.get(prices, F.floor(at).cast("int")), F.get(prices, F.ceil(at).cast("int"))
    return low + (at - F.floor(at)) * (high - low)


def comparable_price(
    listings: DataFrame, as_of: Column, k: int = 10, max_age_days: int = 60, pool: DataFrame | None = None
) -> DataFrame:
    """P25 / P50 / P75 of the comparables' prices (truncated), their count and a confidence from 0.2 to 1."""
    candidates = eligible(listings if pool is None else pool, as_of, max_age_days)
    nearest = nearest_members(listings, candidates, k)
    by_profile = nearest.groupBy(*PROFILE).agg(F.array_sort(F.collect_list("price")).alias("prices"))
    n = F.array_size("prices")
    values = by_profile.select(
        *PROFILE,
        F.floor(_interpolated(F.col("prices"), 0.25)).cast("int").alias("p25_price"),
        F.floor(_interpolated(F.col("prices"), 0.50)).cast("int").alias("median_price"),
        F.floor(_interpolated(F.col("prices"), 0.75)).cast("int").alias("p75_price"),
        n.alias("comparables"),
        F.when(n >= 10, F.lit(1.0)).otherwise(F.round(F.lit(0.2) + (n - 1) * 0.8 / 9, 2)).alias("comparable_confidence"),
    )
    rows = _attach_profiles(listings, _with_rows(values, listings))
    return rows.withColumns(
        {
            "comparables": F.coalesce("comparables", F.lit(0)),
            "comparable_confidence": F.coalesce("comparable_confidence", F.lit(0.0)),
        }
    )


def comparables_join(listings: DataFrame, as_of: Column, max_age_days: int = 60, pool: DataFrame | None = None) -> DataFrame:
    """How many listings qualify as comparables of each listing (before the top-k), counted on profiles.

    The range condition is answered by a windowed count in mileage order within a bucket, so no pair is ever formed.
    """
    candidates = eligible(listings if pool is None else pool, as_of, max_age_days)
    profiles = candidates.select(*_profile_columns()).groupBy("b", "m", F.col("y").alias("cy"), "km").agg(
        F.count("*").alias("size")
    )
    targets = listings.select(*_profile_columns()).select(*MODEL, "y", F.coalesce("km", F.lit(0)).alias("km")).distinct()
    probes = targets.withColumn("cy", F.explode(F.sequence(F.col("y") - YEAR_REACH, F.col("y") + YEAR_REACH)))
    known, near = bucketed(profiles.filter(F.col("km").isNotNull()), probes, "km")
    line = known.withColumnRenamed("km", "at").unionByName(
        near.withColumnRenamed("km", "at").withColumn("size", F.lit(0).cast("bigint")), allowMissingColumns=True
    )
    by_km = Window.partitionBy("b", "m", "cy", "bucket").orderBy("at")

    def sized_to(shift: int) -> Column:
        return F.coalesce(F.sum("size").over(by_km.rangeBetween(Window.unboundedPreceding, shift)), F.lit(0))

    near = line.withColumn("found", sized_to(MILEAGE_REACH) - sized_to(-MILEAGE_REACH - 1)).filter(F.col("y").isNotNull())
    near = near.select(*MODEL, "y", F.col("at").alias("km"), "found")
    unknown = (
        probes.join(profiles.filter(F.col("km").isNull()).drop("km"), ["b", "m", "cy"])
        .select(*MODEL, "y", "km", F.col("size").alias("found"))
    )
    totals = near.unionByName(unknown).groupBy(*MODEL, "y", "km").agg(F.sum("found").alias("candidates"))
    key = [*MODEL, "y", "km"]
    shared = with_profile(listings).groupBy(*key).agg(F.count("*").alias("rows"))
    rows = attach_groups(
        with_profile(listings), totals.join(shared, key), key, rows="rows", spread_by=F.col("listing_id")
    )
    return rows.drop(*PROFILE)
