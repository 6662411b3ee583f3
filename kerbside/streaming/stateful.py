"""Operators with state per key, kept by Spark in RocksDB: a batch reads and writes the state of its own keys only.

Each job sets the state store before it starts; Spark saves the setting with the checkpoint. The state is dealt over
``spark.sql.shuffle.partitions`` tasks by key, snapshots and change logs of it lie in the checkpoint folder.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DAY = 86_400_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """State of queries started inside goes to RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Timeline(StatefulProcessor):
    """Price changes of one ad. The sightings lie in one list per day and an index of days, so that a hot ad's state is no
    single value and a sighting touches its own day and at most the two next to it.

    A new sighting between two others takes back the change between them, if there was one, and adds those it makes. Once the
    watermark has passed, no sighting can come in before it: of what is older only the last day that has sightings stays.
    """

    def __init__(self, keys: list[str]):
        self.change = Row(*keys, "micros", "old_price", "new_price", "count")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day long", "at array<long>, price array<int>")
        self.index = handle.getValueState("index", "days array<long>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if initialState.at is not None and initialState.price is not None:
            day = initialState.at // DAY
            self.days.updateValue((day,), ([initialState.at], [initialState.price]))
            self.index.update(([day],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = list(self.index.get()[0]) if self.index.exists() else []
        before, chunks, dirty, found = list(known), {}, set(), Counter()

        def chunk(day):
            if day not in chunks:
                value = self.days.getValue((day,)) if day in known_set else None
                chunks[day] = list(zip(value[0], value[1], strict=True)) if value else []
            return chunks[day]

        known_set = set(known)
        for at, price in sorted({(r.at, r.price) for r in rows if r.at is not None and r.price is not None}):
            day = at // DAY
            line = chunk(day)
            place = bisect_left(line, (at, price))
            if place < len(line) and line[place] == (at, price):
                continue
            here = bisect_left(known, day)
            behind = here + (here < len(known) and known[here] == day)
            last = line[place - 1] if place else (chunk(known[here - 1])[-1] if here else None)
            following = line[place] if place < len(line) else (chunk(known[behind])[0] if behind < len(known) else None)
            if last and following and last[1] != following[1]:
                found[following[0], last[1], following[1]] -= 1
            if last and last[1] != price:
                found[at, last[1], price] += 1
            if following and following[1] != price:
                found[following[0], price, following[1]] += 1
            line.insert(place, (at, price))
            dirty.add(day)
            if day not in known_set:
                known.insert(here, day)
                known_set.add(day)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if watermark > 0:
            # days wholly before the watermark, but for the last of them
            for day in known[: max(0, bisect_left(known, watermark // DAY) - 1)]:
                if day in before:
                    self.days.removeKey((day,))
                dirty.discard(day)
                known.remove(day)
        for day in dirty:
            self.days.updateValue((day,), ([x[0] for x in chunks[day]], [x[1] for x in chunks[day]]))
        if known != before:
            self.index.update((known,))
        for (at, old, new), n in sorted(found.items()):
            if n:
                yield self.change(*key, at, old, new, n)

    def close(self) -> None:
        pass


def price_changes(sightings: DataFrame, stored: DataFrame | None, keys: list[str], time: str, late: str | None = None) -> DataFrame:
    """(keys, at, old_price, new_price, count) of every price change that a stream of sightings brings to light.

    ``stored`` gives a first sighting per key (``updated_at``, ``price``). Where a late sighting comes in between two others,
    the change that no longer holds has count -1. With ``late``, sightings further behind the newest are dropped and older
    state goes; without, all sightings of an ad are kept and any order of arrival gives the same sums. A sighting without
    time or price changes nothing.
    """
    rows = sightings.withWatermark(time, late) if late else sightings
    rows = rows.select(*keys, *([time] if late else []), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col("price").cast("int").alias("price"))
    first = None
    if stored is not None:
        first = stored.select(*keys, F.unix_micros("updated_at").alias("at"), F.col("price").cast("int").alias("price")).groupBy(*keys)
    schema = StructType([sightings.schema[k] for k in keys])
    for name, kind in (("micros", "long"), ("old_price", "integer"), ("new_price", "integer"), ("count", "integer")):
        schema = schema.add(name, kind)
    out = rows.groupBy(*keys).transformWithState(Timeline(keys), schema, "append", "eventTime" if late else "none", first)
    return out.select(*keys, F.timestamp_micros("micros").alias("at"), "old_price", "new_price", "count")


class Presence(StatefulProcessor):
    """When a key goes stale and when it is seen again.

    State: the stretches in which no gap between sightings exceeds ``span``, those that are not over yet. What the watermark
    has passed is final: a stretch whose beginning it has passed is told once, one whose end lies ``span`` behind it is
    told as stale and leaves the state. One timer per key waits for the next of these points.
    """

    def __init__(self, key: str, span: int):
        self.span, self.change = span, Row(key, "micros", "is_stale")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stretches", "begins array<long>, ends array<long>, told boolean")

    def _load(self):
        if not self.state.exists():
            return [], False
        begins, ends, told = self.state.get()
        return [list(x) for x in zip(begins, ends, strict=True)], told

    def _settled(self, key, stretches, told, watermark) -> Iterator[Row]:
        while stretches:
            begin, end = stretches[0]
            if not told and begin < watermark:
                told = True
                yield self.change(*key, begin, False)
            if not told or end + self.span >= watermark:
                break
            yield self.change(*key, end + self.span, True)
            stretches.pop(0)
            told = False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if stretches:
            self.state.update(([s[0] for s in stretches], [s[1] for s in stretches], told))
            # timers count milliseconds; the next one lies behind the point it waits for
            self.handle.registerTimer((stretches[0][1] + self.span if told else stretches[0][0]) // 1000 + 1)
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = sorted({r.at for r in rows if r.at is not None})
        if not times or any(k is None for k in key):
            return
        stretches, told = self._load()
        first = stretches[0][0] if stretches else None
        merged: list[list[int]] = []
        for begin, end in sorted([*stretches, *([t, t] for t in times)]):
            if merged and begin - merged[-1][1] <= self.span:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([begin, end])
        # a stretch that was told and now begins earlier has been told at its old beginning
        told = told and merged[0][0] <= first <= merged[0][1]
        yield from self._settled(key, merged, told, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stretches, told = self._load()
        yield from self._settled(key, stretches, told, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def presence_changes(sightings: DataFrame, key: str, time: str, stale_days: float, late: str = "0 seconds") -> DataFrame:
    """(key, at, is_stale): when a key is first seen, goes ``stale_days`` unseen, and is seen again; each once.

    A key is stale from its last sighting plus ``stale_days`` on, and is told so when the watermark (the newest sighting less
    ``late``) has passed that point. Rows without a key only move the watermark: a feed without sightings needs such ticks.
    """
    rows = sightings.withWatermark(time, late).select(key, time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    schema = StructType([sightings.schema[key]]).add("micros", "long").add("is_stale", "boolean")
    out = rows.groupBy(key).transformWithState(Presence(key, int(stale_days * DAY)), schema, "append", "eventTime")
    return out.select(key, F.timestamp_micros("micros").alias("at"), "is_stale")


class Once(StatefulProcessor):
    """The first row of every key, ever; of the rows that come together the smallest in ``order``, None last."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.seen.exists():
            return
        rank = lambda r: tuple(x for c in self.order for x in (r[c] is None, 0 if r[c] is None else r[c]))
        best = min(rows, key=rank, default=None)
        if best is not None:
            self.seen.update((True,))
            yield best

    def close(self) -> None:
        pass


def first_ever(stream: DataFrame, keys: list[str], order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Each key once for ever, in whatever order rows arrive. Nulls in keys are equal. ``seen``: keys to start with."""
    return stream.groupBy(*keys).transformWithState(
        Once(order), stream.schema, "append", "none", seen.select(*keys).distinct().groupBy(*keys) if seen is not None else None
    )
