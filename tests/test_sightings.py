"""Merging sightings: the same result for any cut into batches, any order of arrival and replayed batches."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import upsert
from kerbside.operators.responses import first_object
from kerbside.streaming import jobs

SIGHTING = "source string, external_id string, price int, city string, seen_at timestamp"
TABLE = "source string, external_id string, price int, city string, created_at timestamp, updated_at timestamp, price_history array<struct<price:int,date:date>>"


def sightings():
    rng = random.Random(4)
    rows = [("s", str(i % 7), rng.choice([100, 200, None, 300]), f"c{i % 7}", f"2024-01-{1 + d:02d} 0{rng.randint(0, 9)}:00:00") for d in range(20) for i in range(9)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SIGHTING.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at"))


def plain(rows):
    """{ad: (price, [old prices in order])}."""
    out = {}
    for ad in {r[1] for r in rows}:
        line = sorted({(r[4], r[2]) for r in rows if r[1] == ad and r[2] is not None})
        out[ad] = (line[-1][1], [a[1] for a, b in zip(line, line[1:]) if a[1] != b[1]])
    return out


@pytest.mark.parametrize("cuts,shuffled", [(1, False), (3, False), (9, True)])
def test_any_cut_and_order(spark, cuts, shuffled):
    rows = sightings()
    arrived = random.Random(cuts).sample(rows, len(rows)) if shuffled else rows
    table = spark.createDataFrame([], TABLE)
    size = -(-len(rows) // cuts)
    for i in range(0, len(rows), size):
        batch = frame(spark, arrived[i : i + size])
        table = upsert.merge_sightings(batch, table, "seen_at")
        table = spark.createDataFrame(table.collect(), table.schema)
        again = upsert.merge_sightings(batch, table, "seen_at")
        assert sorted(again.collect(), key=str) == sorted(table.collect(), key=str)
    got = {r.external_id: (r.price, [h.price for h in r.price_history or []]) for r in table.collect()}
    assert got == plain(rows)


def test_repeated_keys_and_maps(spark):
    stored = spark.createDataFrame([("s", "1", None, "x", None, None, None)], TABLE)
    twice = spark.createDataFrame([("s", "1", 5, "b"), ("s", "1", 4, "a"), ("s", "2", 7, "c"), ("s", "2", 7, "c")], "source string, external_id string, price int, city string")
    got = upsert.upsert_apply(twice, stored, F.current_timestamp()).select("external_id", "price").collect()
    assert sorted(map(tuple, got)) == [("1", 4), ("2", 7)]
    assert {r.external_id: r.change for r in upsert.upsert_classify(twice, stored).collect()} == {"1": "unchanged", "2": "new"}
    with_map = twice.withColumn("attrs", F.create_map(F.lit("k"), F.col("city")))
    assert {r.external_id: r.attrs["k"] for r in upsert.first_per_key(with_map, upsert.KEYS, [F.col("price")]).collect()} == {"1": "a", "2": "c"}


def test_first_object_of_any_depth(spark):
    deep = '{"category": {"a": {"b": {"c": {"d": 1}}}}}'
    texts = [f"say {deep} and {{x}}", deep[:-1], "no braces", None, "{}", "} {a} {b}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", first_object(F.col("t")).alias("o")).collect()
    assert [r.o for r in sorted(rows)] == [deep, deep[:-1], None, None, "{}", "{a}"]


def test_seen_once_in_any_order_of_arrival(spark, tmp_path):
    """Late first sightings come through, repeats do not, however far apart in time; nulls are equal."""
    schema = "listing_id long, price int, seen_at timestamp"
    arrivals = [
        [(1, 100, "2024-06-01"), (1, 100, "2024-05-30"), (2, None, "2024-06-01")],
        [(1, 100, "2024-12-01"), (2, None, "2024-12-02"), (3, 300, "2024-12-01")],
        [(4, 400, "2023-01-01"), (1, 200, "2023-01-01"), (1, 100, "2023-01-01"), (5, 500, None)],
    ]
    for rows in arrivals:
        batch = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("seen_at", F.to_timestamp("seen_at"))
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.read_ads_stream(spark, f"{tmp_path}/in", batch.schema, 1)
        jobs.stream_seen_dedup(stream, ["listing_id", "price"], f"{tmp_path}/out", f"{tmp_path}/ckpt", "seen_at").awaitTermination()
    found = sorted((r.listing_id, r.price or 0, str(r.seen_at)[:10]) for r in jobs.read_batches(spark, f"{tmp_path}/out").collect())
    assert found == [(1, 100, "2024-05-30"), (1, 200, "2023-01-01"), (2, 0, "2024-06-01"), (3, 300, "2024-12-01"), (4, 400, "2023-01-01"), (5, 500, "None")]
