"""Structured Streaming jobs. State lives in Spark's checkpoints and in a bucketed table; every sink is idempotent by
batch id, so a replayed micro-batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kerbside.operators import alerts as alert_ops
from kerbside.operators.upsert import KEYS, merge_sightings
from kerbside.sources.bucketed import BucketTable
from kerbside.streaming.stateful import first_ever, presence_changes, price_changes, rocksdb


def read_ads_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New ads as files arrive; offsets replace any "last check" cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_new_listings(ads: DataFrame, start: Column, time: str = "created_at") -> DataFrame:
    """Listings created after ``start`` (first run); later runs continue from the checkpoint."""
    return ads.filter(F.col(time) > start)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, processing what is there and stopping."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_seen_dedup(stream: DataFrame, keys: list[str], path: str, checkpoint: str, time: str) -> StreamingQuery:
    """Each (id, price) once for ever, in whatever order the ads arrive; of a batch's repeats the earliest. Nulls are equal.

    What has been seen is state per key in RocksDB: a batch looks up its own keys and reads nothing of earlier batches.
    """
    with rocksdb(stream.sparkSession):
        return to_files(first_ever(stream, keys, [time]), path, checkpoint)


def stream_upsert(stream: DataFrame, table: BucketTable, checkpoint: str, time: str) -> StreamingQuery:
    """Merge all sightings of each micro-batch into the table, the sighting time taking the place of "now".

    A batch reads and rewrites the buckets of its own ads. Batch n writes version n + 1, so a replay changes nothing. The
    table must exist, at version 0, before the first batch.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, lambda new, old: merge_sightings(new, old, time), batch_id + 1)

    return for_each_batch(stream, merge, checkpoint)


def stream_price_changes(
    stream: DataFrame, stored: DataFrame, path: str, checkpoint: str, time: str, late: str | None = None
) -> StreamingQuery:
    """(key, time, old price, new price, count) of every price change, as files; ``stored`` is what was known before.

    A batch gives the changes that its sightings bring to light with count 1 and, where a late sighting came in between,
    the change that no longer holds with count -1. ``net_changes`` adds them up: the same for any cut and any order.
    The timeline of each ad is state in RocksDB; ``late`` bounds how far back sightings may come and with it the state.
    """
    with rocksdb(stream.sparkSession):
        return to_files(price_changes(stream, stored, KEYS, time, late), path, checkpoint)


def net_changes(changes: DataFrame) -> DataFrame:
    """The price changes that hold after all batches of ``stream_price_changes``."""
    kept = changes.groupBy("source", "external_id", "at", "old_price", "new_price").agg(F.sum("count").alias("n"))
    return kept.filter("n > 0").drop("n")


def stream_stale(stream: DataFrame, key: str, time: str, stale_days: float, path: str, checkpoint: str, late: str = "0 seconds") -> StreamingQuery:
    """(key, at, is_stale) as files: a key goes stale once when ``stale_days`` pass without a sighting, by timers on event time."""
    with rocksdb(stream.sparkSession):
        return to_files(presence_changes(stream, key, time, stale_days, late), path, checkpoint)


def presence(changes: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """(key, is_stale): the last word on every key, without what went stale at ``as_of`` or later."""
    told = changes if as_of is None else changes.filter(~F.col("is_stale") | (F.col("at") < as_of))
    return told.groupBy(key).agg(F.max_by("is_stale", F.struct("at", "is_stale")).alias("is_stale"))


def stream_alerts(
    stream: DataFrame, filters: DataFrame, muted: DataFrame, path: str, checkpoint: str, users: DataFrame | None = None, sent: DataFrame | None = None
) -> StreamingQuery:
    """Alerts as files, one per (user, address) for ever; of a batch's the smallest listing. ``sent``: the log to start with.

    Listings meet filters and muted makes as static sides; what has been sent is state per (user, address) in RocksDB.
    """
    matched = alert_ops.unmuted_matches(stream, filters, muted, users)
    with rocksdb(stream.sparkSession):
        return to_files(first_ever(matched, ["user_id", "url"], alert_ops.ALERT[2:], sent), path, checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What the jobs above have written to files."""
    return spark.read.parquet(path)
