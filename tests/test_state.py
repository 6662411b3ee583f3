"""Bucketed tables and streams with state: what a batch touches, replays, crashes, any cut and any order."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import upsert
from kerbside.sources.bucketed import SLOTS, BucketTable
from kerbside.streaming import jobs
from tests.test_sightings import TABLE, frame, plain, sightings

KEYED = "k string, n int, v string"


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def replace(new, old):
    return old.join(new, "k", "left_anti").unionByName(new)


@pytest.fixture()
def table(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t")
    assert table.version() == -1
    table.create(spark.createDataFrame([(f"k{i}", i, "old") for i in range(400)], KEYED), ["k"], buckets=16)
    return table


def test_merge_touches_only_its_buckets(spark, table):
    before = files(table.path)
    assert len(before) == 16 and len(rows_of(table)) == 400
    assert table.merge(spark.createDataFrame([("k7", 7, "new"), ("fresh", 1, "new")], KEYED), replace) == 1
    after = files(table.path)
    assert all(after[f] == before[f] for f in before)
    written = {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}
    assert 1 <= len(written) <= 2
    assert len(rows_of(table)) == 401 and ("k7", 7, "new") in rows_of(table) and ("fresh", 1, "new") in rows_of(table)
    # what a merge is given of the table lies in those buckets too
    seen = []
    table.merge(spark.createDataFrame([("k7", 8, "x")], KEYED), lambda new, old: seen.append(old.inputFiles()) or replace(new, old))
    assert {f.split("bucket=")[1].split("/")[0] for f in seen[0]} <= written and len(seen[0]) == 1


def test_old_versions_go_and_recent_ones_stay_readable(spark, table):
    for i in range(1, 9):
        before = table.read()
        table.merge(spark.createDataFrame([("k7", 1000 + i, "x")], KEYED), replace)
        assert before.filter("k = 'k7'").first().n == (1000 + i - 1 if i > 1 else 7)
        assert table.read(i - 1).filter("k = 'k7'").first().n == before.filter("k = 'k7'").first().n
    slots = glob.glob(f"{table.path}/data/bucket=*/slot=*")
    assert len(slots) == 16 + SLOTS - 1 and len(glob.glob(f"{table.path}/manifest/ring=*")) == SLOTS
    assert table.version() == 8 and len(rows_of(table)) == 400


def test_crash_between_write_and_swap(spark, table, monkeypatch):
    def crash(*_):
        raise RuntimeError("lost")

    old = rows_of(table)
    with monkeypatch.context() as patch:
        patch.setattr(table, "_swap", crash)
        for _ in range(3):
            with pytest.raises(RuntimeError):
                table.merge(spark.createDataFrame([("k7", -1, "half")], KEYED), replace, version=1)
    assert table.version() == 0 and rows_of(table) == old
    assert table.merge(spark.createDataFrame([("k7", 1, "whole")], KEYED), replace, version=1) == 1
    # a replay changes nothing, a gap is an error, and no rows still move the version on
    assert table.merge(spark.createDataFrame([("k7", 2, "again")], KEYED), replace, version=1) == 1
    assert ("k7", 1, "whole") in rows_of(table)
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("k7", 2, "gap")], KEYED), replace, version=5)
    count = len(files(table.path))
    assert table.merge(spark.createDataFrame([], KEYED), replace) == 2 and len(files(table.path)) == count


def test_empty_table_null_keys_and_new_columns(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/e")
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([("a", 1, "x")], KEYED), replace)
    table.create(spark.createDataFrame([], KEYED), ["k"], buckets=4)
    assert rows_of(table) == []
    table.merge(spark.createDataFrame([("a", 1, "x"), (None, 2, "null key")], KEYED), replace)
    table.merge(spark.createDataFrame([("b", 1, "y")], KEYED), lambda new, old: replace(new, old).withColumn("w", F.lit(9)))
    assert {(r.k, r.w) for r in table.read().collect()} >= {("b", 9)} and table.read().count() == 3
    with pytest.raises(ValueError):
        table.create(spark.createDataFrame([], KEYED), ["k"])


def arrivals(spark, path, rows, parts):
    for i, part in enumerate(parts):
        frame(spark, [rows[j] for j in part]).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_upsert_of_any_batch_size(spark, tmp_path, shuffled):
    rows = sightings()
    rows = random.Random(1).sample(rows, len(rows)) if shuffled else rows
    frame(spark, rows).repartition(4).write.parquet(f"{tmp_path}/in")
    for per_batch in (1, 3):
        table = BucketTable(spark, f"{tmp_path}/t{per_batch}")
        table.create(spark.createDataFrame([], TABLE), upsert.KEYS, buckets=4)
        stream = jobs.read_ads_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, per_batch)
        jobs.stream_upsert(stream, table, f"{tmp_path}/k{per_batch}", "seen_at").awaitTermination()
        got = {r.external_id: (r.price, [h.price for h in r.price_history or []]) for r in table.read().collect()}
        assert got == plain(sightings())


def test_untouched_listing_keeps_its_price_as_first_sighting(spark, tmp_path):
    """A table made before timelines: each listing starts from its stored price when its bucket is first merged."""
    stored = spark.createDataFrame([("s", str(i), 50, "c", None, None, None) for i in range(20)], TABLE).withColumn("updated_at", F.to_timestamp(F.lit("2023-01-01")))
    table = BucketTable(spark, f"{tmp_path}/t")
    table.create(stored, upsert.KEYS, buckets=8)
    for ad in ("1", "2", "3"):
        batch = frame(spark, [("s", ad, 60, "c", "2024-01-01 00:00:00")])
        table.merge(batch, lambda new, old: upsert.merge_sightings(new, old, "seen_at"))
    got = {r.external_id: [h.price for h in r.price_history or []] for r in table.read().collect()}
    assert got == {str(i): [50] if str(i) in ("1", "2", "3") else [] for i in range(20)}


def price_stream(spark, path, out, per_batch, stored=None, late=None):
    stream = jobs.read_ads_stream(spark, path, frame(spark, []).schema, per_batch)
    return jobs.stream_price_changes(stream, stored, f"{out}/data", f"{out}/ckpt", "seen_at", late)


def steps(rows):
    """{(ad, time, old price, new price)} of all sightings in order of time."""
    out = set()
    for ad in {r[1] for r in rows}:
        line = sorted({(r[4], r[2]) for r in rows if r[1] == ad and r[2] is not None})
        out |= {(ad, b[0], a[1], b[1]) for a, b in zip(line, line[1:]) if a[1] != b[1]}
    return out


def net(spark, out):
    rows = jobs.net_changes(jobs.read_batches(spark, f"{out}/data")).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).collect()
    return {(r.external_id, r["at"], r.old_price, r.new_price) for r in rows}


@pytest.mark.parametrize("shuffled", [False, True])
def test_price_changes_of_any_cut_and_order(spark, tmp_path, shuffled):
    rows = sightings() + [("s", "hot", 100 + i % 3, "c", f"2024-02-01 {i // 60:02d}:{i % 60:02d}:00") for i in range(120)]
    rows = random.Random(2).sample(rows, len(rows)) if shuffled else sorted(rows, key=lambda r: r[4])
    size = -(-len(rows) // 4)
    arrivals(spark, f"{tmp_path}/in", rows, [range(i, min(i + size, len(rows))) for i in range(0, len(rows), size)])
    for per_batch in (1, 100):
        price_stream(spark, f"{tmp_path}/in", f"{tmp_path}/o{per_batch}", per_batch).awaitTermination()
        assert net(spark, f"{tmp_path}/o{per_batch}") == steps(rows)


def test_price_changes_after_restart_with_stored_prices_and_lateness(spark, tmp_path):
    stored = spark.createDataFrame([("s", "1", 999, "c", None, None, None), ("s", "x", None, "c", None, None, None)], TABLE)
    stored = stored.withColumn("updated_at", F.to_timestamp(F.lit("2023-12-01 00:00:00")))
    rows = sorted(sightings(), key=lambda r: r[4])
    half = len(rows) // 2
    expected = steps([*rows, ("s", "1", 999, "c", "2023-12-01 00:00:00")])
    for late in (None, "3 days"):
        path, out = f"{tmp_path}/in{late}", f"{tmp_path}/out{late}"
        arrivals(spark, path, rows, [range(half)])
        price_stream(spark, path, out, 1, stored, late).awaitTermination()
        arrivals(spark, path, rows, [range(half, len(rows))])
        price_stream(spark, path, out, 1, stored, late).awaitTermination()
        assert net(spark, out) == expected


def test_state_behind_the_watermark_goes(spark):
    """With a bound on lateness a timeline holds the days since then and one day before, however long it runs."""
    from kerbside.streaming.stateful import DAY, Timeline

    class Map(dict):
        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Clock:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    job, clock = Timeline(["source", "external_id"]), Clock()
    job.days, job.index = Map(), Value()
    row = type("R", (), {})
    told = []
    for day in range(1, 200):
        r = row()
        r.at, r.price = day * DAY, day % 5
        clock.now = max(0, (day - 4) * DAY // 1000)
        told += job.handleInputRows(("s", "1"), iter([r]), clock)
    assert len(told) == 198 and len(job.days) <= 6 and [k[0] for k in job.days] == list(job.index.get()[0])


def stale_stream(spark, rows, tmp_path, cuts, days, late="0 seconds"):
    path = f"{tmp_path}/in{cuts}"
    size = max(1, -(-len(rows) // cuts))
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], "id long, at string").select("id", F.to_timestamp("at").alias("seen_at"))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_ads_stream(spark, path, spark.read.parquet(path).schema, 1)
    jobs.stream_stale(stream, "id", "seen_at", days, f"{path}/../o{cuts}", f"{path}/../c{cuts}", late).awaitTermination()
    rows = jobs.read_batches(spark, f"{path}/../o{cuts}").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).collect()
    return sorted((r.id, r["at"], r.is_stale) for r in rows)


def test_stale_once_by_timers(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 12:00:00"), (1, "2024-01-02 10:00:00"), (3, "2024-01-03 00:00:00"), (2, "2024-01-06 00:00:00"), (3, "2024-01-06 00:00:00"), (None, "2024-01-08 00:00:01")]
    expected = [
        (1, "2024-01-01 00:00:00", False), (1, "2024-01-04 10:00:00", True),
        (2, "2024-01-01 12:00:00", False), (2, "2024-01-03 12:00:00", True), (2, "2024-01-06 00:00:00", False), (2, "2024-01-08 00:00:00", True),
        (3, "2024-01-03 00:00:00", False), (3, "2024-01-05 00:00:00", True), (3, "2024-01-06 00:00:00", False), (3, "2024-01-08 00:00:00", True),
    ]
    for cuts in (1, 3, 7):
        assert stale_stream(spark, rows, tmp_path, cuts, 2) == expected


def test_late_sighting_keeps_a_key_fresh(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (9, "2024-01-04 00:00:00"), (1, "2024-01-02 12:00:00"), (None, "2024-01-09 00:00:00")]
    assert [r for r in stale_stream(spark, rows, tmp_path, 4, 2, "2 days") if r[0] == 1] == [(1, "2024-01-01 00:00:00", False), (1, "2024-01-04 12:00:00", True)]


def test_seen_batches_read_nothing_of_earlier_ones(spark, tmp_path):
    """Each batch reads its own file: the files of earlier batches are not opened again, and no folder lists them."""
    schema = "listing_id long, price int, seen_at timestamp"
    expected, reads = set(), []
    for b in range(6):
        rows = [(i % 40, b % 3, "2024-01-01") for i in range(b * 10, b * 10 + 30)]
        expected |= {(r[0], r[1]) for r in rows}
        batch = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at"))
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_ads_stream(spark, f"{tmp_path}/in", batch.schema, 1)
        query = jobs.stream_seen_dedup(stream, ["listing_id", "price"], f"{tmp_path}/out", f"{tmp_path}/ckpt", "seen_at")
        query.awaitTermination()
        reads.append(sum(p["numInputRows"] for p in query.recentProgress))
    found = [(r.listing_id, r.price) for r in jobs.read_batches(spark, f"{tmp_path}/out").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert reads == [30] * 6


def test_alert_stream_starts_from_a_sent_log(spark, tmp_path):
    ads = "listing_id long, url string, brand string, model string, year int, price int, city string, price_diff_pct double, deal_score int, is_duplicate boolean"
    first = [(1, "u1", "Audi", "a4", 2015, 100, "Old Town", 5.0, 50, False), (2, "u2", "Audi", "a4", 2015, 100, None, 5.0, 50, False), (3, "u2", "Audi", "a4", 2015, 90, "x", 5.0, 50, False)]
    again = [(4, "u1", "Audi", "a4", 2015, 90, "Old Town", 5.0, 50, False), (5, "u5", "Skoda", "x", 2015, 90, "town", None, None, False), (6, "u6", "Audi", "a4", 2015, 90, "town", 1.0, 1, True)]
    filters = spark.createDataFrame(
        [(1, "audi", "", None, None, None, None, None), (2, None, None, 95.0, None, "Town", 2010, None), (3, None, None, None, None, None, None, None)],
        "user_id long, brand string, model string, max_price double, min_discount double, city string, min_year int, min_deal_score double",
    )
    muted = spark.createDataFrame([(3, "audi")], "user_id long, brand string")
    sent = spark.createDataFrame([(1, "u2")], "user_id long, url string")
    for rows in (first, again):
        spark.createDataFrame(rows, ads).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_ads_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], ads).schema, 1)
        jobs.stream_alerts(stream, filters, muted, f"{tmp_path}/out", f"{tmp_path}/ckpt", None, sent).awaitTermination()
    got = sorted((r.user_id, r.url, r.listing_id) for r in jobs.read_batches(spark, f"{tmp_path}/out").collect())
    assert got == [(1, "u1", 1), (2, "u1", 4), (2, "u5", 5), (3, "u5", 5)]


def test_merge_in_rounds(spark, tmp_path, monkeypatch):
    """A large merge takes some buckets after the others, with the same rows; nothing stays beside the table."""
    from kerbside.sources import bucketed

    old = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    new = spark.range(400, 700).select(F.col("id").cast("string").alias("k"), F.lit(2).alias("v"))
    calls = []

    def combine(incoming, stored):
        calls.append(1)
        both = stored.withColumnRenamed("v", "was").join(incoming, "k", "full")
        return both.select("k", F.coalesce("v", "was").alias("v"))

    monkeypatch.setattr(bucketed, "ROUND_ROWS", 60)
    table = bucketed.BucketTable(spark, str(tmp_path / "t"))
    table.create(old, ["k"], 16)
    assert table.merge(new, combine) == 1 and len(calls) == 9
    assert sorted((int(r.k), r.v) for r in table.read().collect()) == [(i, 1 if i < 400 else 2) for i in range(700)]
    assert spark.read.schema(new.schema).parquet(f"{table.path}/incoming").count() == 0
    empty = bucketed.BucketTable(spark, str(tmp_path / "e"))
    empty.create(old.limit(0), ["k"], 4)
    assert empty.read().count() == 0


def test_first_of_a_key_goes_there_once(spark):
    """The row that is chosen is not carried a second time beside what it is chosen by; maps come along."""
    from kerbside.operators import upsert

    rows = spark.createDataFrame([(1, 5, "b" * 40, {"x": 1}), (1, 4, None, {"x": 2}), (1, 4, "a" * 40, {"x": 3}), (2, None, "c" * 40, None)], "k int, t int, s string, m map<string,int>")
    got = sorted((r.k, r.t, r.s, r.m) for r in upsert.first_per_key(rows, ["k"], [F.col("t")]).collect())
    assert got == [(1, 4, None, {"x": 2}), (2, None, "c" * 40, None)]
    plain = upsert.first_per_key(rows.drop("m"), ["k"], [F.col("t")])
    assert sorted(tuple(r) for r in plain.collect()) == [(1, 4, None), (2, None, "c" * 40)] and plain.columns == ["k", "t", "s"]
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan


def test_settled_tables_and_their_shuffles(spark):
    """What is settled is a table, compressed, and its shuffle files do not wait for the driver's garbage collection."""
    from kerbside import common

    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key, "false")
    rows = spark.range(2_000).groupBy((F.col("id") % 7).alias("k")).count()
    settled = common.settle(rows)
    assert settled.inputFiles() and all("settled" in f and f.endswith(".zstd.parquet") for f in settled.inputFiles())
    assert settled.dtypes == rows.dtypes and sorted(settled.collect()) == sorted(rows.collect())
    with common.shuffles_dropped(spark), common.shuffles_dropped(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key, "false") == before
