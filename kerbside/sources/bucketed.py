"""A keyed Parquet table in hash buckets: a merge reads and rewrites only the buckets that its keys fall into.

    path/data/bucket=17/slot=2/…    the rows of one bucket
    path/manifest/ring=1/…          one row: version, keys, schema and the slot of every bucket

A merge writes the touched buckets into their next slots, then one manifest file that names the new slots; the version with
the highest number in a complete manifest is current. Spark's committer renames that one file into place, so the swap is
one step: a crash before it leaves the old version, whose slots nobody has touched. A bucket has ``SLOTS`` slots that are
used in turn, and so are the manifests: what is overwritten is always the oldest, so old versions go by themselves and the
table takes at most ``SLOTS`` times its size. A frame that was read stays readable for ``SLOTS`` - 1 further merges.

There is one writer at a time. A merge may name its version (a stream names it by the batch); one that is already there is
left as it is, so a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbside.common import shuffles_dropped, write_table

#: Copies of a bucket: the current one, the one before, and the one that is being written.
SLOTS = 3
#: A bucket should hold some hundred megabytes; the number is fixed when the table is made.
BUCKETS = 64
#: Stored rows that a merge takes at a time: what it shuffles is a part of a large table.
ROUND_ROWS = 8_000_000
_MANIFEST = "version long, keys array<string>, schema string, slots array<int>"


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    schema: StructType
    #: slot of every bucket, -1 where it has no rows
    slots: list[int]


class BucketTable:
    """Rows with unique keys, kept by hash of the keys. The columns ``bucket`` and ``slot`` are the table's own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> Version | None:
        """The newest complete version; None before the first write."""
        known = self._manifests()
        return known[max(known)] if known else None

    def _manifests(self) -> dict[int, Version]:
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.version: Version(r.version, list(r["keys"]), StructType.fromJson(json.loads(r.schema)), list(r.slots)) for r in rows}

    def version(self) -> int:
        """Number of the current version, -1 before the first write."""
        now = self.current()
        return -1 if now is None else now.number

    def read(self, version: int | None = None) -> DataFrame:
        """The whole table, as of the current version or of one of the ``SLOTS`` - 1 newest."""
        known = self._manifests()
        return self._rows(known[max(known) if version is None else version])

    def folders(self, at: Version, buckets: Iterable[int] | None = None) -> list[str]:
        """Folders that hold the rows of some buckets, by default of all."""
        wanted = range(len(at.slots)) if buckets is None else buckets
        return [f"{self.path}/data/bucket={b}/slot={at.slots[b]}" for b in wanted if at.slots[b] >= 0]

    def _rows(self, at: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = self.folders(at, buckets)
        if not folders:
            return self.spark.createDataFrame([], at.schema)
        return self.spark.read.schema(at.schema).parquet(*folders)

    def _located(self, rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def _write(self, rows: DataFrame, keys: list[str], slots: list[int], mode: str) -> None:
        placed = self._located(rows, keys, len(slots)).withColumn("slot", F.get(F.lit(slots), F.col("bucket")))
        writer = placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
        with shuffles_dropped(self.spark):
            writer.option("compression", "zstd").partitionBy("bucket", "slot").parquet(f"{self.path}/data")

    def _swap(self, at: Version) -> int:
        row = [(at.number, at.keys, at.schema.json(), at.slots)]
        manifest = self.spark.createDataFrame(row, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/ring={at.number % SLOTS}")
        return at.number

    def create(self, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> int:
        """Version 0. What a failed attempt left behind is replaced; a table that exists is not."""
        if self.current() is not None:
            raise ValueError(f"{self.path} is a table already")
        with self._at_hand(rows) as kept:
            self._write(kept, keys, [0] * buckets, "static")
        slots = [-1] * buckets
        for b in self._buckets(self.spark.read.schema("bucket int, slot int").parquet(f"{self.path}/data")):
            slots[b] = 0
        return self._swap(Version(0, list(keys), rows.schema, slots))

    @contextmanager
    def _at_hand(self, rows: DataFrame) -> Iterator[DataFrame]:
        """Rows that are worked out once, and what that has shuffled removed; their copy goes when they are done with."""
        path = f"{self.path}/incoming"
        yield write_table(rows, path, "overwrite")
        write_table(rows.limit(0), path, "overwrite")

    @staticmethod
    def _buckets(rows: DataFrame) -> list[int]:
        """The distinct buckets of some rows: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in rows.select("bucket").distinct().collect())

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
        """Next version: ``combine(incoming, stored)`` takes the place of the rows in the buckets of ``incoming``.

        ``stored`` holds the rows of those buckets only. ``combine`` gives rows of the same buckets back, every stored key
        among them; it may add columns, which are NULL in buckets that no merge has touched since. ``incoming`` is read
        twice. Without rows in it, the version moves on and no data does. Where more than ``ROUND_ROWS`` rows are stored in those
        buckets, ``combine`` is called for some buckets after the others.
        """
        now = self.current()
        if now is None:
            raise ValueError(f"{self.path} is no table yet")
        if version is not None and version <= now.number:
            return now.number
        number = now.number + 1
        if version is not None and version != number:
            raise ValueError(f"version {version} cannot follow version {now.number}")
        touched = self._buckets(self._located(incoming, now.keys, len(now.slots)))
        slots, schema = list(now.slots), now.schema
        if touched:
            for b in touched:
                slots[b] = (slots[b] + 1) % SLOTS
            rounds = min(len(touched), math.ceil(self._rows(now, touched).count() / ROUND_ROWS))
            if rounds > 1:
                with self._at_hand(self._located(incoming, now.keys, len(slots))) as kept:
                    for own in (touched[i::rounds] for i in range(rounds)):
                        merged = combine(kept.filter(F.col("bucket").isin(own)).drop("bucket"), self._rows(now, own))
                        self._write(merged, now.keys, slots, "dynamic")
            else:
                merged = combine(incoming, self._rows(now, touched))
                self._write(merged, now.keys, slots, "dynamic")
            schema = merged.schema
        return self._swap(Version(number, now.keys, schema, slots))
