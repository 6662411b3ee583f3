"""Merging incoming ads into the stored listings, with price history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.common import blank_to_null

KEYS = ["source", "external_id"]


def first_per_key(ads: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """First ad per key in the given order, as a map-side combined minimum rather than a window.

    Ties go to the smallest row; columns with maps, which have no order, come along without deciding anything.
    """
    values = [c for c in ads.columns if c not in keys]
    maps = [c for c, kind in ads.dtypes if c in values and "map<" in kind]
    ranked = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    first = F.struct(F.lit(0).alias("__any"), *ranked, *[F.col(c).alias(f"__t{i}") for i, c in enumerate(values) if c not in maps])
    # a row goes to its key once: what decides is what is kept, and only maps come beside it
    best = F.min_by(F.struct(first.alias("b"), *maps), first) if maps else F.min(F.struct(first.alias("b")))
    kept = {c: F.col(f"b.{c}" if c in maps else f"b.b.__t{i}").alias(c) for i, c in enumerate(values)}
    return ads.groupBy(*keys).agg(best.alias("b")).select(*[kept.get(c, F.col(c)) for c in ads.columns])


def upsert_classify(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Label each incoming ad ``new``, ``price_changed`` or ``unchanged``; carries the stored price.

    An ad is known when its key is stored, with a price or without; without one no change can be told.
    """
    known = stored.select(*KEYS, F.col("price").alias("old_price"), F.lit(True).alias("__known"))
    return (
        incoming.join(known, KEYS, "left")
        .withColumn(
            "change",
            F.when(F.col("__known").isNull(), "new")
            .when(F.col("old_price") != F.col("price"), "price_changed")
            .otherwise("unchanged"),
        )
        .drop("__known")
    )


def upsert_apply(incoming: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """New snapshot of the listings table: one full outer join on the key, no IN lists.

    Stored rows keep their columns; a re-seen ad gets ``updated_at = as_of``; a changed price pushes
    ``{old price, day}`` to the end of ``price_history``. New ads are inserted with both times set to ``as_of``.
    ``as_of`` may name a column of the incoming row as ``new.<column>``. Of incoming rows that repeat a key the smallest
    counts, so a key is never stored twice.
    """
    incoming = first_per_key(incoming, KEYS)
    old = stored.select(*KEYS, F.struct(*[c for c in stored.columns if c not in KEYS]).alias("old"))
    new = incoming.select(*KEYS, F.struct(*[c for c in incoming.columns if c not in KEYS]).alias("new"))
    joined = old.join(new, KEYS, "full")
    is_new, seen = F.col("old").isNull(), F.col("new").isNotNull()
    changed = ~is_new & seen & (F.col("old.price") != F.col("new.price"))
    out = []
    for field in stored.schema.fields:
        name = field.name
        if name in KEYS:
            out.append(F.col(name))
            continue
        from_new = F.col(f"new.{name}").cast(field.dataType) if name in incoming.columns else F.lit(None).cast(field.dataType)
        value = F.when(is_new, from_new).otherwise(F.col(f"old.{name}"))
        if name == "price":
            value = F.when(seen, F.col("new.price")).otherwise(F.col("old.price"))
        elif name == "updated_at":
            value = F.when(seen, as_of).otherwise(F.col("old.updated_at"))
        elif name == "created_at":
            value = F.coalesce(F.col("old.created_at"), as_of)
        elif name == "price_history":
            entry = F.array(F.struct(F.col("old.price").alias("price"), as_of.cast("date").alias("date")))
            before = F.coalesce(F.col("old.price_history"), F.array().cast(field.dataType))
            value = F.when(changed, F.concat(before, entry)).otherwise(F.col("old.price_history"))
        out.append(value.alias(name))
    return joined.select(*out)


TIMELINE = "array<struct<at:timestamp,price:int>>"


def price_steps(timeline: Column) -> Column:
    """(at, old_price, new_price) wherever the price differs from the sighting before."""
    rest = F.greatest(F.size(timeline) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(timeline, F.lit(1), rest), F.slice(timeline, F.lit(2), rest),
        lambda a, b: F.struct(b["at"].alias("at"), a["price"].alias("old_price"), b["price"].alias("new_price")),
    )
    return F.filter(pairs, lambda p: p["old_price"] != p["new_price"])


def with_timeline(stored: DataFrame) -> DataFrame:
    """Stored listings with the sightings known of each; a listing that has none yet starts from its present price."""
    first = F.when(F.col("price").isNotNull(), F.array(F.struct(F.col("updated_at").alias("at"), F.col("price").cast("int").alias("price"))))
    first = F.coalesce(first, F.array()).cast(TIMELINE)
    return stored.withColumn("timeline", F.coalesce("timeline", first) if "timeline" in stored.columns else first)


def merge_sightings(sightings: DataFrame, stored: DataFrame, time: str) -> DataFrame:
    """New snapshot from any number of sightings per ad: every price change is kept, in the order of time.

    The table remembers the distinct (time, price) sightings of each ad, so the result depends neither on how sightings
    are cut into batches nor on the order they arrive in, and merging a batch twice changes nothing. Price and
    ``updated_at`` are those of the latest sighting, ``created_at`` that of the earliest; ``price_history`` is what was
    stored before tracking began plus one ``{old price, day}`` for each change. Sightings at one time count in the order of
    their prices; a sighting without a price only moves the times. The other columns come from the ad's first snapshot.
    """
    old = with_timeline(stored)
    seen = F.when(F.col("price").isNotNull(), F.struct(F.col(time).cast("timestamp").alias("at"), F.col("price").cast("int").alias("price")))
    rest = [c for c in sightings.columns if c not in KEYS and c in stored.columns]
    newest = F.struct(F.lit(0).alias("__any"), *rest)
    batch = sightings.groupBy(*KEYS).agg(
        F.collect_set(seen).alias("fresh"), F.min(time).cast("timestamp").alias("from"), F.max(time).cast("timestamp").alias("to"),
        F.min_by(newest, F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("t"), F.col("price").alias("p"))).alias("new"),
    )
    joined = old.select(*KEYS, F.struct(*[c for c in old.columns if c not in KEYS]).alias("old")).join(batch, KEYS, "full")
    none = F.array().cast(TIMELINE)
    timeline = F.array_sort(F.array_union(F.coalesce("old.timeline", none), F.coalesce("fresh", none)))
    joined = joined.withColumn("line", timeline)
    last_price = F.try_element_at("line", F.lit(-1))["price"]
    own = {
        "price": F.coalesce(last_price, F.col("old.price")),
        "updated_at": F.greatest("old.updated_at", "to"),
        "created_at": F.least("old.created_at", "from"),
        "timeline": F.col("line"),
    }
    out = []
    for field in old.schema.fields:
        name = field.name
        if name in KEYS:
            value = F.col(name)
        elif name in own:
            value = own[name]
        elif name == "price_history":
            known = F.coalesce("old.price_history", F.array().cast(field.dataType))
            before = F.slice(known, F.lit(1), F.size(known) - F.size(price_steps(F.coalesce("old.timeline", none))))
            steps = F.transform(price_steps(F.col("line")), lambda s: F.struct(s["old_price"].alias("price"), s["at"].cast("date").alias("date")))
            value = F.concat(before, steps.cast(field.dataType))
            value = F.when(F.size(value) > 0, value).otherwise(F.col("old.price_history"))
        else:
            value = F.when(F.col("old").isNotNull(), F.col(f"old.{name}"))
            if name in rest:
                value = F.when(F.col("old").isNull(), F.col(f"new.{name}").cast(field.dataType)).otherwise(F.col(f"old.{name}"))
        out.append(value.cast(field.dataType).alias(name))
    return joined.select(*out)


def upsert_metrics(fetched: DataFrame, classified: DataFrame) -> DataFrame:
    """Per source: rows fetched, newly saved, unchanged (skipped) and re-priced."""
    counts = classified.groupBy("source").agg(
        F.count_if(F.col("change") == "new").alias("new_saved"),
        F.count_if(F.col("change") == "unchanged").alias("duplicates_skipped"),
        F.count_if(F.col("change") == "price_changed").alias("prices_updated"),
    )
    total = fetched.groupBy("source").agg(F.count("*").alias("total_fetched"))
    zero = F.lit(0).cast("bigint")
    return total.join(counts, "source", "left").select(
        "source",
        "total_fetched",
        *[F.coalesce(c, zero).alias(c) for c in ("new_saved", "duplicates_skipped", "prices_updated")],
    )


def fetch_efficiency(total_fetched: Column, captchas_hit: Column) -> Column:
    """Rows fetched per challenge met; NULL when there was none."""
    return F.try_divide(total_fetched, F.nullif(captchas_hit, F.lit(0)))


def unseen_ads(ads: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop ads already seen at the same price; a price change lets an ad through again."""
    return ads.join(seen.select("listing_id", "price"), ["listing_id", "price"], "left_anti")


def needs_detail(ads: DataFrame, stored: DataFrame) -> DataFrame:
    """Ads whose key is not stored with a body type yet."""
    done = stored.filter(F.col("body_type").isNotNull()).select(*KEYS)
    return ads.join(done, KEYS, "left_anti")


def fill_missing_fields(stored: DataFrame, enriched: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Take the enriched value only where the stored one is missing."""
    fresh = enriched.select(key, *[F.col(f).alias(f"__new_{f}") for f in fields])
    joined = stored.join(fresh, key, "left")
    filled = {}
    for f in fields:
        current = F.col(f)
        keep = blank_to_null(F.nullif(current, F.lit("unknown"))) if dict(stored.dtypes)[f] == "string" else current
        new = F.col(f"__new_{f}")
        filled[f] = F.coalesce(keep, new, current)
    return joined.withColumns(filled).select(*stored.columns)
