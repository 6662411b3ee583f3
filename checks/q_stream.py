"""Streaming jobs run to completion over the events table, checked against their batch meaning."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.q_alerts import ALERTS, filters, muted, users
from checks.registry import query
from kerbside.common import shared_folder
from kerbside.sources import driver_tables as D
from kerbside.sources.bucketed import BucketTable
from kerbside.streaming import jobs as J

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _event_files(spark, sf) -> str:
    """The events as several files in time order, as a stream of arriving files."""
    key = (spark.sparkContext.applicationId, sf, "event_files")
    if key not in D._written:
        path = f"{_folder(spark)}/events"
        D.table(spark, sf, "events").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
        D._written[key] = path
    return D._written[key]


def _ads(spark, sf, per_batch=1):
    """Events as ads: user = ad id, value = price."""
    events = J.read_ads_stream(spark, _event_files(spark, sf), EVENTS, per_batch)
    return events.select(
        F.lit("src_a").alias("source"), F.col("user_id").cast("string").alias("external_id"),
        F.col("user_id").alias("listing_id"), F.round(F.col("value") * 100).cast("int").alias("price"), F.col("ts").alias("seen_at"),
    )


@query("stream_new_listings", None, "SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def _(spark, sf):
    stream = J.read_ads_stream(spark, _event_files(spark, sf), EVENTS)
    fresh = J.stream_new_listings(stream, F.to_timestamp(F.lit("2024-01-20 00:00:00")), "ts")
    out = _folder(spark)
    J.to_files(fresh.select("event_id", "ts", "user_id"), f"{out}/data", f"{out}/ckpt").awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query("stream_seen_dedup", None, "SELECT DISTINCT user_id, value FROM events")
def _(spark, sf):
    out = _folder(spark)
    # a backlog: every file holds events of all times
    D.table(spark, sf, "events").repartition(4, "event_id").write.parquet(f"{out}/in")
    stream = J.read_ads_stream(spark, f"{out}/in", EVENTS, 1)
    J.stream_seen_dedup(stream, ["user_id", "value"], f"{out}/data", f"{out}/ckpt", "ts").awaitTermination()
    return J.read_batches(spark, f"{out}/data").select("user_id", "value")


def _stored(spark, sf):
    """What is known before the stream starts: the ads with an even id, at a price of 1."""
    users_seen = D.table(spark, sf, "events").filter(F.col("user_id") % 2 == 0).select("user_id").distinct()
    return users_seen.select(
        F.lit("src_a").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("user_id").alias("listing_id"),
        F.lit(1).alias("price"), D.as_of().alias("created_at"), D.as_of().alias("updated_at"),
        F.array().cast("array<struct<price:int,date:date>>").alias("price_history"),
    )


# all sightings of an ad in time order behind its stored price, and every step between two of them
STEPS = """
WITH seen AS (
  SELECT DISTINCT user_id, ts, CAST(round(value * 100) AS INTEGER) AS price FROM events WHERE value IS NOT NULL
  UNION SELECT DISTINCT user_id, {as_of}, 1 FROM events WHERE user_id % 2 = 0
), steps AS (
  SELECT user_id, ts, price, lag(price) OVER (PARTITION BY user_id ORDER BY ts, price) AS old_price,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, price DESC) AS back FROM seen
)
""".format(as_of=f"TIMESTAMP '{D.AS_OF}'")


@query(
    "stream_upsert",
    None,
    STEPS
    + """
SELECT CAST(user_id AS VARCHAR) AS external_id, max(price) FILTER (back = 1) AS price,
  coalesce(string_agg(CAST(old_price AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d'), ',' ORDER BY ts, price) FILTER (old_price <> price), '') AS history
FROM steps GROUP BY user_id
""",
)
def _(spark, sf):
    out = _folder(spark)
    table = BucketTable(spark, f"{out}/table")
    table.create(_stored(spark, sf), ["source", "external_id"])
    J.stream_upsert(_ads(spark, sf), table, f"{out}/ckpt", "seen_at").awaitTermination()
    entries = F.transform("price_history", lambda h: F.concat(h["price"].cast("string"), F.lit("@"), F.date_format(h["date"], "yyyy-MM-dd")))
    return table.read().select("external_id", "price", F.coalesce(F.array_join(entries, ","), F.lit("")).alias("history"))


@query(
    "stream_price_changes",
    None,
    STEPS
    + """
SELECT CAST(user_id AS VARCHAR) AS external_id, ts AS changed_at, old_price, price AS new_price FROM steps WHERE old_price <> price
""",
)
def _(spark, sf):
    out = _folder(spark)
    J.stream_price_changes(_ads(spark, sf), _stored(spark, sf), f"{out}/changes", f"{out}/ckpt", "seen_at").awaitTermination()
    changes = J.net_changes(J.read_batches(spark, f"{out}/changes"))
    return changes.select("external_id", F.col("at").alias("changed_at"), "old_price", "new_price")


# the stream starts with an empty sent log
STREAM_ALERTS = ALERTS[: ALERTS.index("AND NOT EXISTS (SELECT 1 FROM (SELECT c_custkey AS user_id, url")]


@query("stream_alerts", "scored", STREAM_ALERTS)
def _(spark, sf):
    out = _folder(spark)
    fresh = D.scored(spark, sf).filter(F.col("created_at") >= F.to_timestamp(F.lit("2001-07-01 00:00:00"))).select(
        "listing_id", "url", "brand", "model", "year", "price", "city", "price_diff_pct", "deal_score", "is_duplicate"
    )
    fresh.repartitionByRange(3, "listing_id").write.parquet(f"{out}/in")
    stream = J.read_ads_stream(spark, f"{out}/in", fresh.schema, 1)
    J.stream_alerts(
        stream, filters(spark, sf), muted(spark, sf), f"{out}/alerts", f"{out}/ckpt", users(spark, sf)
    ).awaitTermination()
    return J.read_batches(spark, f"{out}/alerts").select("user_id", "listing_id", "url", "price")


@query(
    "stream_stale",
    None,
    """
SELECT user_id AS listing_id, max(ts) < TIMESTAMP '2024-01-29 00:00:00' AND min(ts) < TIMESTAMP '2024-01-29 00:00:00' AS is_stale FROM events GROUP BY user_id
""",
)
def _(spark, sf):
    out = _folder(spark)
    # the scheduler's tick: a row without an ad, which moves the clock to the moment that is asked about
    as_of = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    events = D.table(spark, sf, "events").select(F.col("user_id").alias("listing_id"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/in")
    tick = spark.range(1).select(F.lit(None).cast("long").alias("listing_id"), (as_of + F.expr("INTERVAL '1' SECOND")).alias("ts"))
    tick.coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = J.read_ads_stream(spark, f"{out}/in", events.schema, 1)
    J.stream_stale(stream, "listing_id", "ts", 1, f"{out}/data", f"{out}/ckpt").awaitTermination()
    return J.presence(J.read_batches(spark, f"{out}/data"), "listing_id", as_of)
