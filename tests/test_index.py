"""Indexes that narrow work down: stems of patterns, cells of alert filters, laid-out pages, cut value ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside import common
from kerbside import fixed_values as fixed
from kerbside.functions import text as T
from kerbside.operators import alerts as A
from kerbside.operators import comparables
from kerbside.plans import search as S

# stems


def test_stems_by_hand():
    assert T.stems(r"a(?:bc|de)?f") == [] and T.stems(r"x*(?:yy|zz)w") == ["yy", "zz"]
    assert T.stems(r"ab{2}c|dd") == [] and T.stems(r"(?<!no)go|(?:(?:aa|bb)c|dd)") == ["aa", "bb", "dd", "go"]
    assert T.stems(r"a\|b|cc") == [] and T.stems(r"[ab|c]de+f") == ["de"]
    assert all(T.stems(p) for p in (fixed.KEYWORD_PATTERNS | fixed.CONDITION_FLAGS).values())


def test_hits_with_stems_are_the_hits_of_the_patterns(spark):
    rng = random.Random(8)
    words = sorted({w for p in (fixed.KEYWORD_PATTERNS | fixed.CONDITION_FLAGS).values() for w in T.stems(p)})
    words += ["не", "птс", "владелец", "в", "1", "12", "7", "масла", "состоянии", "пробег", "in", "to", "то", "бит,", "!"]
    texts = [None, "", "  "] + [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(1500)]
    texts += [t.upper() for t in texts[3:200]] + [t.title() for t in texts[200:300]]
    texts += ["xİy", "ſtop", "trade-ın", "TRADE–İN", "K12", "straße", "ΣΑΣ"]
    patterns = fixed.KEYWORD_PATTERNS | fixed.CONDITION_FLAGS | {"dot": "xiy", "long_s": "stop", "kelvin": "k12", "sharp": "strasse|straße", "sigma": "σας"}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    names = list(patterns)
    hits = T.pattern_hits(F.col("t"), patterns)
    plain = {n: F.regexp_like(F.coalesce("t", F.lit("")), F.lit(f"(?iuU){p}")) for n, p in patterns.items()}
    out = frame.select("i", F.struct(*[hits[n].alias(n) for n in names]).alias("a"), F.struct(*[plain[n].alias(n) for n in names]).alias("b"))
    assert [r.i for r in out.filter("a <> b").collect()] == []
    assert out.filter(" or ".join(f"b.`{n}`" for n in names)).count() > 800


# alerts

LISTING = "listing_id long, url string, brand string, model string, year int, price int, city string, price_diff_pct double, deal_score int"
FILTER = "user_id long, brand string, model string, max_price double, min_discount double, city string, min_year int, min_deal_score double"


def matches(listing, f):
    _, _, brand, model, year, price, city, diff, score = listing
    _, f_brand, f_model, max_price, discount, f_city, min_year, min_score = f
    low = lambda x: None if x is None else x.lower()
    return (
        (not f_brand or low(brand) == f_brand.lower())
        and (not f_model or low(model) == f_model.lower())
        and (max_price is None or (price is not None and price <= max_price))
        and (discount is None or (diff or 0.0) >= discount)
        and (not f_city or not city or f_city.lower() in city.lower())
        and (min_year is None or (year is not None and year >= min_year))
        and (min_score is None or (score is not None and score >= min_score))
    )


def market(seed, listings=600, filters=150):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    cities = ["Old Town", "town", "Нижний Новгород", "", None, "X", "a*b", "!"]
    rows = [
        (i, f"u{i}", pick("Audi", "audi", "Kia", "*", None), pick("A4", "rio", "", None), pick(1999, 2010, 2015, 2020, None), pick(0, 1, 2**31 - 1, None, rng.randint(1, 10**6)),
         rng.choice(cities), pick(None, 0.0, rng.uniform(-30, 30)), pick(None, rng.randint(0, 100)))
        for i in range(listings)
    ]
    asked = [
        (i % 90, pick(None, "", "AUDI", "kia", "*"), pick(None, "", "a4"), pick(None, rng.uniform(0, 10**6), 0.0, -5.0), pick(None, 0.0, 12.5, -100.0),
         pick(None, "", "town", "TOWN", "новгород", "*", "!", "zz"), pick(None, 2010, 2050, 1900), pick(None, 50.0, 101.0))
        for i in range(filters)
    ]
    return rows, asked


@pytest.mark.parametrize("with_profile", [True, False])
def test_filter_match_join_equals_brute_force(spark, with_profile):
    rows, asked = market(3)
    listings, filters = spark.createDataFrame(rows, LISTING), spark.createDataFrame(asked, FILTER)
    profile = None if with_profile else listings.limit(3)
    got = sorted(map(tuple, A.filter_match_join(listings, filters, profile).select("user_id", "listing_id").collect()))
    assert got == sorted({(f[0], r[0]) for r in rows for f in asked if matches(r, f)})
    none = spark.createDataFrame([], FILTER)
    assert A.filter_match_join(listings, none).count() == 0 and A.filter_match_join(listings.limit(0), filters).count() == 0


def test_pairs_meet_once_and_candidates_stay_close_to_matches(spark):
    """Half of the listings are one model, prices lie close together, and filters ask for the rare end of one bound."""
    rng = random.Random(4)
    rows = [
        (i, f"u{i}", "Audi" if i % 2 else f"m{i % 50}", "a4", 1990 + int(rng.triangular(0, 35, 34)), int(rng.lognormvariate(13, 0.3)), rng.choice(["Old Town", "North", "South"]), rng.gauss(0, 8), rng.randint(0, 100))
        for i in range(4000)
    ]
    asked = []
    for u in range(120):
        bound = u % 4
        asked.append((u, "audi" if u % 3 else None, None, 300_000.0 if bound == 0 else None, 14.0 if bound == 1 else None, "town" if u % 2 else None, 2023 if bound == 2 else None, 95.0 if bound == 3 else None))
    pairs = A.candidate_pairs(spark.createDataFrame(rows, LISTING), spark.createDataFrame(asked, FILTER))
    counted = pairs.groupBy("user_id", "listing_id").agg(F.count("*").alias("n"))
    candidates, most = counted.agg(F.sum("n"), F.max("n")).first()
    found = sum(matches(r, f) for r in rows for f in asked)
    assert most == 1 and found <= candidates <= 1.5 * found
    assert candidates < 0.05 * len(rows) * len(asked)


# pages


@pytest.mark.parametrize("sort_by,descending", [("price_diff_pct", True), ("category", False), ("deal_score", True)])
def test_laid_out_pages_equal_offset(spark, tmp_path, sort_by, descending):
    rng = random.Random(5)
    rows = [
        (i, "b", "m", 2000, 100, 90, rng.choice([None, rng.randint(0, 9) * 1.0]), rng.choice(["x", "y", None]), 0.5, rng.choice([None, 7]), "2024-01-01", i % 10 == 0)
        for i in rng.sample(range(1000), 403)
    ]
    schema = "listing_id long, brand string, model string, year int, price int, market_price int, price_diff_pct double, category string, confidence double, deal_score int, created_at string, is_duplicate boolean"
    listings = spark.createDataFrame(rows, schema).repartition(5)
    pages = S.lay_out_pages(listings, str(tmp_path), sort_by, descending, rows_per_range=40)
    assert len(pages.counts) > 5 and sum(pages.counts) == sum(not r[-1] for r in rows)
    last = -(-sum(pages.counts) // 25)
    before, walked = None, []
    for page in (1, 2, last // 2, last, last + 1):
        want = list(map(tuple, S.browse_listings(listings, sort_by, descending, page).collect()))
        got = pages.page(spark, page)
        assert list(map(tuple, got.collect())) == want
        # a page reads the ranges that hold it, at most one more than it spans
        assert len(got.inputFiles()) <= 25 // min(c for c in pages.counts if c) + 2
    while True:
        if before is None:
            step = S.browse_listings(listings, sort_by, descending).collect()
        else:
            step = S.page_after(listings, before[sort_by], before.listing_id, sort_by, descending).collect()
        if not step:
            break
        walked, before = walked + [r.listing_id for r in step], step[-1]
    assert walked == [r.listing_id for p in range(1, last + 1) for r in pages.page(spark, p).collect()]


def test_pages_of_nothing(spark, sf, tmp_path):
    from kerbside.sources import driver_tables as D

    pages = S.lay_out_pages(D.scored(spark, sf), str(tmp_path), brand="no such make")
    assert pages.page(spark, 1).collect() == [] and pages.counts == []


# quantiles


@pytest.mark.parametrize("ranges", [2, 128])
def test_split_quantiles(spark, ranges):
    rng = random.Random(6)
    rows = [(k, rng.choice([rng.gauss(0, 1), 0.25])) for k in range(3) for _ in range(3 ** (k + 2))] + [(0, None), (7, None), (8, 1.5)]
    frame = spark.createDataFrame(rows, "k int, v double").repartition(4)
    cuts = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}
    got = {r.k: r for r in common.split_quantiles(frame, ["k"], "v", cuts, ranges=ranges).collect()}
    assert set(got) == {0, 1, 2, 8}
    for k, r in got.items():
        values = [v for q, v in rows if q == k and v is not None]
        assert r.n == len(values) and [r.a, r.b, r.c, r.d] == pytest.approx(list(np.quantile(values, list(cuts.values()))))
    whole = common.split_quantiles(frame, [], "v", cuts, ranges=ranges).collect()
    values = [v for _, v in rows if v is not None]
    assert len(whole) == 1 and [whole[0][n] for n in cuts] == pytest.approx(list(np.quantile(values, list(cuts.values()))))
    assert common.split_quantiles(frame.limit(0), [], "v", cuts).collect() == []
    assert common.group_quantiles(frame, [], "v", {"c": 0.5}).first().c == pytest.approx(np.quantile(values, 0.5))


def test_no_window_orders_a_whole_column(spark):
    plan = common.split_quantiles(spark.range(1000).select(F.col("id").cast("double").alias("v")), [], "v", {"c": 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    sorted_values = [line for line in text.splitlines() if "Sort [" in line and "__v" in line]
    assert sorted_values and all("__r" in line for line in sorted_values)


# comparables


def test_hot_model_is_cut_into_buckets(spark):
    rows = [("b", "m", 2020, km) for km in range(0, 400_000, 50)]
    frame = spark.createDataFrame(rows, "b string, m string, y int, km int")
    candidates, targets = comparables.bucketed(frame, frame, "km")
    held = [r["count"] for r in candidates.groupBy("bucket").count().collect()]
    assert max(held) <= 3 * comparables.MILEAGE_REACH // 50 and candidates.count() == 3 * len(rows) and targets.count() == len(rows)
    reach = targets.alias("t").join(candidates.alias("c"), "bucket").filter(F.abs(F.col("t.km") - F.col("c.km")) <= comparables.MILEAGE_REACH)
    span = 2 * comparables.MILEAGE_REACH // 50 + 1
    assert reach.filter("t.km between 100000 and 101000").count() == 21 * span


def test_broadcast_is_decided_by_bytes(spark):
    wide = common.settle(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.struct("id", F.lit("yy").alias("t"))).alias("a")))
    assert 100_000 < common.table_bytes(wide) < 130_000
    assert common.table_bytes(wide.select("id")) < 4_000


def exchanged_pairs(frame):
    """Columns of the exchanges above the join of listings and filters."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Join")].count("Exchange")


def test_pairs_of_users_with_few_filters_are_not_shuffled(spark):
    rows, asked = market(5)
    listings, filters = spark.createDataFrame(rows, LISTING), spark.createDataFrame(asked, FILTER)
    muted = spark.createDataFrame([(1, "audi")], "user_id long, brand string")
    sent = spark.createDataFrame([(2, "u1"), (2, "u2"), (None, "u3"), (3, None)], "user_id long, url string")
    assert exchanged_pairs(A.filter_match_join(listings, filters)) == 0
    assert exchanged_pairs(A.alerts(listings, filters, muted, sent)) == 0


@pytest.mark.parametrize("few,told", [(8, 1000), (1, 1)])
def test_repeated_listings_addresses_and_filters_match_once(spark, monkeypatch, few, told):
    """Users with many filters, addresses sent to many, listings twice and two listings at one address."""
    monkeypatch.setattr(A, "FEW_FILTERS", few)
    monkeypatch.setattr(A, "FEW_TOLD", told)
    rows, asked = market(6, 200, 120)
    rows = [(*r[:1], f"u{r[0] // 2}" if r[0] < 40 else None if r[0] < 44 else r[1], *r[2:]) for r in rows]
    asked += asked[:20]
    listings, filters = spark.createDataFrame(rows + rows[10:50], LISTING), spark.createDataFrame(asked, FILTER)
    log = [(u, f"u{i}") for i in range(0, 200, 3) for u in range(i % 4)] + [(None, "u50"), (5, None)]
    sent = spark.createDataFrame(log, "user_id long, url string")
    muted = spark.createDataFrame([(u, "audi") for u in range(0, 90, 2)], "user_id long, brand string")
    found = {(f[0], r) for r in rows for f in asked if matches(r, f)}
    assert sorted(map(tuple, A.filter_match_join(listings, filters).select("user_id", "listing_id").collect())) == sorted((u, r[0]) for u, r in found)
    unsent = {(u, r) for u, r in found if (u, r[1]) not in set(log) or r[1] is None}
    assert sorted(map(tuple, A.unsent_matches(listings, filters, sent).select("user_id", "listing_id").collect())) == sorted((u, r[0]) for u, r in unsent)
    first = {}
    for u, r in unsent:
        if u % 2 or (r[2] or "").lower() != "audi":
            first[u, r[1]] = min(first.get((u, r[1]), r[0]), r[0])
    got = {(r.user_id, r.url): r.listing_id for r in A.alerts(listings, filters, muted, sent).collect()}
    assert got == first
