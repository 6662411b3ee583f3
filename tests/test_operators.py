"""Rules, skew paths and properties of the operators on small frames, against plain Python."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside import common
from kerbside.operators import alerts, clean, comparables, dedup, encode, pricing, scoring, upsert

NOW = dt.datetime(2026, 1, 31)


def as_of():
    return F.lit(NOW)


def test_attach_groups_same_result_on_both_paths(spark):
    # key 0 holds two thirds of the rows
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 100).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    small = common.attach_groups(rows, groups, ["k"], rows="n", spread_by=F.col("id"))
    large = common.attach_groups(rows, groups, ["k"], rows="n", spread_by=F.col("id"), max_broadcast_bytes=0)
    assert sorted(map(tuple, small.select("id", "k", "m").collect())) == sorted(map(tuple, large.select("id", "k", "m").collect()))
    assert large.count() == 3000


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20])
def test_group_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.randint(0, 5 * n)) for k in range(3) for _ in range(n)]
    got = common.group_quantiles(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9})
    for r in got.collect():
        values = [v for k, v in rows if k == r.k]
        assert r.n == n
        assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))


LISTING = "listing_id long, source string, brand string, model string, year int, city string, price int, mileage int, created_at timestamp"


def _match(rows):
    """Plain rule: oldest of a group of equals is canonical, rows of other sources are its duplicates."""
    out = {}
    keyed = sorted(rows, key=lambda r: (r[8], r[0]))
    for r in keyed:
        if not r[5]:
            continue
        key = (r[2].lower(), r[3].lower(), r[4], r[5].lower(), r[6], r[7] or 0)
        first = out.setdefault(key, r)
        if first[1] != r[1]:
            yield r[0], first[0]


def test_dedup_rules_and_idempotence(spark):
    def row(i, source, city="Omsk", price=100, mileage=5, day=1, brand="Kia"):
        return (i, source, brand, "Rio", 2020, city, price, mileage, dt.datetime(2026, 1, day))

    rows = [
        row(1, "a"), row(2, "a", day=2), row(3, "b", day=3, brand="KIA"), row(4, "b", price=101), row(5, "c", city="Tula"),
        row(6, "b", city=None), row(7, "a", city=""), row(8, "b", city=""), row(9, "a", price=7, mileage=None), row(10, "c", price=7, mileage=0, day=2),
    ]
    frame = spark.createDataFrame(rows, LISTING)
    once = dedup.cross_source_dedup(frame)
    marked = {(r.listing_id, r.canonical_id) for r in once.filter("is_duplicate").collect()}
    assert marked == {(3, 1), (10, 9)} == set(_match(rows))
    twice = dedup.cross_source_dedup(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(*once.columns).collect()))
    assert once.count() == len(rows)


def test_upsert(spark):
    schema = "source string, external_id string, price int, brand string, created_at timestamp, updated_at timestamp, price_history array<struct<price:int,date:date>>"
    old = dt.datetime(2026, 1, 1)
    stored = spark.createDataFrame([("a", "1", 100, "Kia", old, old, None), ("a", "2", 200, "BMW", old, old, None), ("a", "3", 300, "VW", old, old, None)], schema)
    incoming = spark.createDataFrame([("a", "1", 90, "X"), ("a", "2", 200, "Y"), ("b", "1", 50, "New")], "source string, external_id string, price int, brand string")
    classes = {(r.source, r.external_id): r.change for r in upsert.upsert_classify(incoming, stored).collect()}
    assert classes == {("a", "1"): "price_changed", ("a", "2"): "unchanged", ("b", "1"): "new"}
    once = common.settle(upsert.upsert_apply(incoming, stored, as_of()))
    rows = {(r.source, r.external_id): r for r in once.collect()}
    assert rows["a", "1"].price == 90 and rows["a", "1"].brand == "Kia"
    assert [(h.price, h.date) for h in rows["a", "1"].price_history] == [(100, dt.date(2026, 1, 31))]
    assert rows["a", "2"].updated_at == NOW and rows["a", "3"].updated_at == old
    assert rows["b", "1"].created_at == NOW
    again = upsert.upsert_apply(incoming, once, as_of())
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    changed_back = upsert.upsert_apply(incoming.withColumn("price", F.col("price") + 1), once, as_of())
    assert [h.price for h in changed_back.filter("source = 'a' and external_id = '1'").first().price_history] == [100, 90]


DEAL = dict(price_diff_pct=0.0, year=2020, category=None, mileage=60_000, photo_count=0, body_type="sedan", created_at=NOW - dt.timedelta(hours=48), owners_count=2, price=500_000, description="", url="")


@pytest.mark.parametrize(
    "changes,score",
    [
        ({}, 50), ({"price_diff_pct": 30.0}, 95), ({"price_diff_pct": 50.0}, 95), ({"price_diff_pct": -30.0}, 5),
        ({"price_diff_pct": 30.0, "year": 2015}, 88), ({"price_diff_pct": 30.0, "year": 2010}, 77),
        ({"category": "clean"}, 60), ({"category": "complex_but_profitable"}, 55), ({"category": "damaged_body"}, 15), ({"category": "debtor"}, 10),
        ({"mileage": 59_999}, 55), ({"mileage": 180_001}, 45), ({"mileage": None}, 47), ({"mileage": None, "body_type": "unknown"}, 42),
        ({"photo_count": 6}, 53), ({"photo_count": 11}, 55), ({"owners_count": 1}, 55), ({"owners_count": 4}, 45),
        ({"price": 199_999}, 45), ({"price": 99_999}, 20), ({"mileage": 300_000}, 30), ({"mileage": 300_001}, 30),
        ({"created_at": NOW - dt.timedelta(hours=5)}, 58), ({"created_at": NOW - dt.timedelta(hours=23)}, 54), ({"created_at": NOW - dt.timedelta(hours=73)}, 47),
        ({"description": "после ДТП"}, 15), ({"description": "не битый"}, 50), ({"url": "https://x/bityy"}, 15), ({"price_diff_pct": 12.3}, 68),
    ],
)
def test_deal_score(spark, changes, score):
    schema = "price_diff_pct double, year int, category string, mileage int, photo_count int, body_type string, created_at timestamp, owners_count int, price int, description string, url string"
    row = tuple((DEAL | changes).values())
    assert scoring.deal_score(spark.createDataFrame([row], schema), as_of()).first().deal_score == score


def _rule(s, c, n, m):
    """Ensemble decision spelled out."""
    enough, some = c is not None and n >= 3, c is not None and n >= 1
    if s is not None and enough and m is not None:
        return "source+comparable+model", s * 0.5 + c * 0.3 + m * 0.2
    if s is not None and m is not None:
        return "source+model", s * 0.5 + m * 0.5
    if s is not None and enough:
        return "source+comparable", s * 0.5 + c * 0.5
    if enough and m is not None:
        return "comparable+model", c * 0.5 + m * 0.5
    if some and m is not None:
        return "model_heavy+comparable", m * 0.7 + c * 0.3
    if m is not None:
        return "model_only", m
    if some:
        return "comparable_only", c
    return ("source_only", s) if s is not None else ("none", None)


def test_ensemble(spark):
    cases = [(s, c if n else None, n, m) for s, c, n, m in itertools.product([None, 1000], [2000], [0, 1, 2, 3, 9, 10], [None, 3000])]
    frame = spark.createDataFrame(cases, "source_estimate int, median_price int, comparables int, p50 int")
    for r in pricing.ensemble_price(frame).collect():
        method, price = _rule(r.source_estimate, r.median_price, r.comparables, r.p50)
        assert r.ensemble_method == method
        assert r.ensemble_price == (None if price is None else int(price + 1e-9))
    full = pricing.ensemble_price(frame).filter("source_estimate is not null and p50 is not null and comparables = 10").first()
    assert full.ensemble_confidence == 1.0


def test_score_outcome(spark):
    frame = spark.createDataFrame(
        [(100, 39, "high"), (100, 40, "high"), (100, 250, "high"), (100, 251, "high"), (100, 54, "low"), (100, 55, "low"), (100, 180, "low"), (100, 181, "low"), (100, 0, "high")],
        "price int, p50 int, c string",
    )
    got = [r[0] for r in frame.select(pricing.score_outcome(F.col("price"), F.col("p50"), F.col("c"))).collect()]
    low, sane, ok = "skipped_low_confidence", "skipped_sanity", "scored"
    assert got == [sane, ok, ok, sane, low, ok, ok, low, "no_prediction"]


def test_cleaning_group_sizes(spark):
    def rows(brand, prices):
        return [(brand, "m", p) for p in prices]

    data = rows("four", [100, 100, 100, 9000]) + rows("five", [100, 100, 100, 100, 9000]) + rows("same", [500] * 12)
    data += rows("mad", [100, 101, 102, 103, 104, 105, 106, 107, 108, 125])
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "listing_id long, brand string, model string, price int")
    flagged = clean.with_iqr_flag(frame).filter("iqr_outlier").select("brand", "price").collect()
    assert {tuple(r) for r in flagged} == {("five", 9000), ("mad", 125)}
    mad = clean.with_mad_flag(frame).filter("mad_outlier").select("brand", "price").collect()
    assert {tuple(r) for r in mad} == {("mad", 125)}


def test_oof_encoding(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("abc"), rng.randint(1000, 9000), i % 3) for i in range(60)] + [(60, "z", 5000, 0)]
    frame = spark.createDataFrame(data, "listing_id long, k string, price int, fold int")
    mean = float(np.mean([math.log(r[2]) for r in data]))
    for r in encode.target_encoding_oof(frame, ["k"], "fold", 5).collect():
        other = [math.log(d[2]) for d in data if d[1] == r.k and d[3] != r.fold]
        assert r.te_oof == pytest.approx((sum(other) + 5 * mean) / (len(other) + 5) if other else mean)


def _distance(a, b):
    logs = abs(math.log(max(a[4] or 0, 1)) - math.log(max(b[4] or 0, 1)))
    return round(0.35 * (abs(a[3] - b[3]) / 2) ** 2 + 0.45 * logs**2 + 0.20 * (abs((a[5] or 0) - (b[5] or 0)) / 0.5) ** 2, 6)


@pytest.mark.parametrize("include_self", [True, False])
def test_knn_against_brute_force(spark, include_self):
    """A hot model with free mileages, so that neighbours on both sides and ties matter."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        model = "hot" if i % 3 else f"m{i % 4}"
        km = rng.choice([None, 0, rng.randint(0, 90_000), rng.randint(0, 900) * 100, 50_000])
        rows.append((i, "A", model, rng.randint(2000, 2008), km, rng.choice([None, 1.5, 2.0]), rng.randint(1, 40) * 10_000, "s", False, dt.datetime(2026, 1, 20)))
    schema = "listing_id long, brand string, model string, year int, mileage int, engine_volume double, price int, source string, is_duplicate boolean, created_at timestamp"
    frame = spark.createDataFrame(rows, schema)
    got = {}
    for r in comparables.knn_topk(frame, as_of(), k=4, include_self=include_self).collect():
        got.setdefault(r.listing_id, []).append((r.rank, r.comparable_id))
    for t in rows:
        near = [
            (_distance(t, c), abs((t[4] or 0) - c[4]) if c[4] is not None else 1_000_000, c[6], c[0])
            for c in rows
            if c[2] == t[2] and abs(c[3] - t[3]) <= 2 and (c[4] is None or abs(c[4] - (t[4] or 0)) <= 30_000)
            and (include_self or c[0] != t[0])
        ]
        want = [c[3] for c in sorted(near)[:4]]
        assert [c for _, c in sorted(got.get(t[0], []))] == want


def test_alert_rules(spark):
    listings = spark.createDataFrame(
        [(1, "u1", "Kia", "Rio", 2020, 100, "Omsk", 20.0, 80, False), (2, "u2", "BMW", "X5", 2015, 900, None, None, None, False)],
        "listing_id long, url string, brand string, model string, year int, price int, city string, price_diff_pct double, deal_score int, is_duplicate boolean",
    )
    schema = "user_id long, brand string, model string, max_price double, min_discount double, city string, min_year int, min_deal_score double"
    none = (None,) * 7
    filters = [
        (1, *none), (2, "KIA", None, 100.0, None, None, None, None), (3, None, None, 99.0, None, None, None, None),
        (4, None, None, None, None, "oms", None, None), (5, None, None, None, None, None, None, 50.0), (6, None, "x5", None, 1.0, None, None, None),
        (1, "bmw", None, None, None, None, None, None), (7, None, None, None, None, None, 2016, None),
    ]
    muted = spark.createDataFrame([(1, "bmw")], "user_id long, brand string")
    sent = spark.createDataFrame([(2, "u1")], "user_id long, url string")
    frame = spark.createDataFrame(filters, schema)
    matched = {(r.user_id, r.listing_id) for r in alerts.filter_match_join(listings, frame).collect()}
    assert matched == {(1, 1), (1, 2), (2, 1), (4, 1), (4, 2), (5, 1), (7, 1)}
    got = [(r.user_id, r.listing_id) for r in alerts.alerts(listings, frame, muted, sent).collect()]
    assert sorted(got) == [(1, 1), (4, 1), (4, 2), (5, 1), (7, 1)]


def test_scores_stay_in_bounds(spark, sf):
    from checks.q_pricing import train  # noqa: F401
    from kerbside.sources import driver_tables as D

    row = D.scored(spark, sf).agg(F.min("deal_score"), F.max("deal_score"), F.min("attractiveness"), F.max("attractiveness")).first()
    assert 0 <= row[0] and row[1] <= 100 and 0 <= row[2] and row[3] <= 10


def test_price_model_quality(spark, sf):
    from checks.q_model import model
    from checks.q_pricing import train
    from kerbside.operators import evaluate
    from kerbside.plans import price_model as M

    fitted = model(spark, sf)
    out = common.settle(fitted.predict(train(spark, sf)))
    assert out.filter("p10 > p50 or p50 > p90").count() == 0
    unseen = M.make_baseline(fitted.out_of_fold)
    assert unseen.count() == out.count() and unseen.select("listing_id").distinct().count() == out.count()
    errors = unseen.groupBy("fold").agg(evaluate.mape(F.col("price"), F.col("p50")).alias("model"), evaluate.mape(F.col("price"), F.col("baseline")).alias("plain"))
    rows = errors.collect()
    assert len(rows) == 5 and all(r.model < r.plain for r in rows)
    # bounds from unseen rows are wider than the fit's own residuals would give
    inside = out.agg(F.avg(F.col("price").between(F.col("p10"), F.col("p90")).cast("int"))).first()[0]
    assert inside >= 0.75
    trees = {r.learner: r.trees for r in fitted.fit_report(spark).collect()}
    assert set(trees) == {"boosted", "forest", "boosted_plain"} and trees["boosted"] <= M.TrainingOptions().trees


def test_answers_of_the_ad_filters_are_shuffled_not_texts(spark):
    from kerbside.operators import ad_filters

    ads = spark.createDataFrame(
        [(1, 100, "a bad car", "x"), (2, 100, None, "x"), (2, 100, "fine", None), (None, 100, "fine", "x")], "listing_id long, price int, description string, address string"
    ).withColumns({"title": F.lit("t"), "seller_id": F.lit("s"), "published": F.to_timestamp(F.lit("2024-01-01")), "is_reserved": F.lit(None).cast("boolean"), "is_promoted": F.lit(False)})
    settings = ad_filters.AdFilter(black_words=["bad"], geo="x")
    seen = spark.createDataFrame([(2, 100), (2, 100), (3, 100)], "listing_id long, price int")
    found = ad_filters.ads_filter_counts(ads, settings, F.current_timestamp(), seen)
    row = found.first()
    assert (row.fetched, row.after_viewed, row.after_black_words, row.after_address) == (4, 2, 1, 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "description" not in plan[: plan.index("Join LeftOuter")]
    join = plan[plan.index("Join LeftOuter") :].splitlines()[1]
    assert "Project" in join and "description" in join and " AS __black_words" in join


def test_analysis_per_text_gives_what_analysis_per_listing_gives(spark):
    from kerbside.plans import pipeline

    rows = [(i, f"s{i % 2}", "b", f"m{i % 3}", 2015, 60_000 + 10_000 * (i % 9), 1000, "x", i % 5 if i % 7 else None) for i in range(200)]
    listings = spark.createDataFrame(rows, "listing_id long, source string, brand string, model string, year int, price int, mileage int, city string, doc_id long").withColumns(
        {"created_at": F.to_timestamp(F.lit("2024-01-01")), "url": F.lit("u"), "photo_count": F.lit(1), "body_type": F.lit("suv"), "owners_count": F.lit(1)}
    )
    known = spark.createDataFrame([(0, "clean", 0.5), (1, "debtor", 0.5), (1, "clean", 1.0), (9, "clean", 0.1), (None, "clean", 0.2)], "doc_id long, category string, confidence double")
    flags = spark.createDataFrame([(0, True, False), (2, False, True), (None, True, True)], "doc_id long, red_flag boolean, bars_training boolean")
    by_listing = listings.join(known, "doc_id").select("listing_id", "category", "confidence")
    now = F.to_timestamp(F.lit("2024-01-02"))
    one = pipeline.scored_listings(listings, known, now, 60, flags)
    two = pipeline.scored_listings(listings, by_listing, now, 60, flags)
    assert one.columns == two.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
    assert one.count() == 200 + sum(r[-1] == 1 for r in rows)


@pytest.mark.parametrize("line,part", [(1, 1), (1, 2), (11, 1)])
def test_listings_from_keyed_tables_equal_those_from_any(spark, tmp_path, line, part):
    """Also where a part is there twice, and where order and line number do not tell an ad."""
    from kerbside.sources import driver_tables as D

    tables = {
        "nation": ([(0, "n0"), (1, "n1")], "n_nationkey int, n_name string"),
        "customer": ([(1, 0, "MACHINERY"), (2, 1, None), (3, 9, "x")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "orders": ([(i, i % 4, f"2000-01-{i + 1:02d}") for i in range(9)] + [(None, 1, None)], "o_orderkey long, o_custkey long, o_orderdate string"),
        "part": ([(1, "b1", "t1", 7), (2, "b2", None, None)] + [(1, "b0", "t3", 20)] * (part - 1), "p_partkey long, p_brand string, p_type string, p_size int"),
        "documents": ([(i,) for i in range(3)], "doc_id long"),
        "lineitem": (
            [(i % 10, line if i % 3 else 1, 1 + i % 3, i % 4 or None, float(i % 5) if i % 6 else None, 10_000.0 * i if i % 7 else None, f"2001-01-{1 + i % 4:02d}") for i in range(60)],
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string",
        ),
    }
    for name, (rows, schema) in tables.items():
        frame = spark.createDataFrame(rows, schema)
        for c in ("o_orderdate", "l_shipdate"):
            frame = frame.withColumn(c, F.to_timestamp(c)) if c in frame.columns else frame
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert D._ads_have_keys(spark, str(tmp_path)) == (line < 10 and part == 1)
    new, old = D._build_listings(spark, str(tmp_path)), D._build_listings_of_any_keys(spark, str(tmp_path))
    assert new.dtypes == old.dtypes and new.count() >= 4
    assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
