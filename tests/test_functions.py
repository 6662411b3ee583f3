"""Boundary values of the scalar functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from kerbside.functions import labels as L
from kerbside.functions import normalise as N
from kerbside.functions import text as T
from kerbside.operators import extract as X
from kerbside.operators import responses as R


def values(spark, texts, column, kind="string"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_titles(spark):
    titles = ["Toyota Camry 2.5 AT, 2019, 45 000 km", "LADA (ВАЗ) Granta 1.6 MT, 2020", "BMW", "Kia Rio X-Line"]
    assert values(spark, titles, T.title_brand) == ["Toyota", "LADA (ВАЗ)", "BMW", "Kia"]
    assert values(spark, titles, T.title_model) == ["Camry", "Granta", "", "Rio X-Line"]
    assert values(spark, titles, T.title_year) == [2019, 2020, 0, 0]
    assert values(spark, titles, T.title_engine_volume) == [2.5, 1.6, None, None]
    assert values(spark, titles, T.title_transmission) == ["АКПП", "МКПП", None, None]
    assert values(spark, ["200 000 км", "15 000 км", "200000км", "x"], T.title_mileage) == [200000, 15000, 200000, None]


def test_engine(spark):
    rows = values(spark, ["2.0 л / 150 л.с. / Бензин", "1.8 / Гибрид", "дизель", ""], T.parse_engine)
    assert [tuple(r) for r in rows] == [(2.0, 150, "Бензин"), (1.8, None, "Гибрид"), (None, None, "дизель"), (None, None, None)]
    rows = values(spark, ["бензин, 2.0 л", "2,5 л, 150 л.с., дизель"], T.parse_engine_list)
    assert [tuple(r) for r in rows] == [(2.0, None, "бензин"), (2.5, 150, "дизель")]


def test_numbers_and_words(spark):
    assert values(spark, ["45 000 км", "1", "нет", None], T.digits) == [45000, 1, None, None]
    assert values(spark, ["Да", " Не растаможен ", "?", None], T.yes_no) == [True, False, None, None]
    assert values(spark, ["+7 (900) 1", "call", "", None], T.clean_phone) == ["79001", "call", "", None]
    assert values(spark, ["Авто, супер!!  ОК", None], T.clean_text) == ["авто супер ок", ""]
    assert values(spark, ["a b", None], T.nbsp_normalise) == ["a b", ""]
    assert values(spark, [2500, 100, 101, None], lambda c: T.displacement_litres(c), "int") == [2.5, 100.0, 0.1, None]
    assert values(spark, ["#040001", "FAFBFB", "zz"], T.color_from_hex) == ["black", "white", "zz"]


def test_masking(spark):
    raw = [
        "http://user:pw@host.example:8080 ok",
        "tg_token = \"abc\" tg_chat_id = [1, 2]",
        "proxy_change_url='https://x.example/change?k=1'",
        "proxy_change_url='nothing'",
        "Password: 'p' API-KEY=\"k\"",
    ]
    masked = values(spark, raw, T.mask_secrets)
    assert masked[0].endswith("user:***@host.example:8080 ok") and "pw" not in masked[0]
    assert masked[1] == 'tg_token = "***" tg_chat_id = ***'
    assert masked[2] == "proxy_change_url='https://x.example/***'"
    assert masked[3] == "proxy_change_url='***'"
    assert masked[4] == "Password: '***' API-KEY=\"***\""


def test_red_flags(spark):
    texts = ["Машина битая", "не битый", "не-битый кузов", "После ДТП", "x bityy y", "ок", None, "битый, но не битый", "не битый, битый"]
    assert values(spark, texts, T.red_flag_hit) == [True, False, False, True, True, False, False, True, False]


def test_keywords(spark):
    flags = T.keyword_flags(F.col("x"))
    frame = spark.createDataFrame([("Не битая, один хозяин. СРОЧНО",), ("Битый, торг!",), (None,)], "x string")
    rows = frame.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert (rows[0]["kw_not_damaged"], rows[0]["kw_one_owner"], rows[0]["kw_urgent"], rows[0]["kw_damaged"]) == (1, 1, 1, 0)
    assert (rows[1]["kw_damaged"], rows[1]["kw_urgent"]) == (1, 1)
    assert sum(rows[2].asDict().values()) == 0
    assert len(flags) == 23
    assert values(spark, ["Это хорошая машина 2020 на ходу"], T.tokens) == [["хорошая", "2020", "ходу"]]


def test_brands_and_categoricals(spark):
    assert values(spark, ["Lada (ВАЗ)", "бмв", "FAW", "", " Toyota (JP) "], N.canonical_brand) == [
        "LADA", "BMW", "FAW", None, "Toyota (JP)",
    ]
    gear = lambda c: N.canonical(c, N.fixed.TRANSMISSION)
    assert values(spark, [" АКПП ", "MT", "tiptronic ", "", None], gear) == ["АКПП", "МКПП", "tiptronic", None, None]


def test_validation(spark):
    rows = [
        (1, 9_999, 5, 2000), (2, 10_000, -1, 1969), (3, 50_000_000, 0, 1970), (4, 50_000_001, 0, 2000),
        (5, 20_000, 999_999, 2027), (6, 20_000, 1_000_000, 2028), (7, None, 1, 2000),
    ]
    ads = spark.createDataFrame(rows, "id int, price int, mileage int, year int")
    kept = {r.id: (r.mileage, r.year) for r in N.validate_ads(ads).collect()}
    assert kept == {2: (None, 0), 3: (0, 1970), 5: (999_999, 2027), 6: (None, 0)}
    assert {r.id for r in N.rejected_ads(ads).collect()} == {1, 4, 7}


@pytest.mark.parametrize(
    "raw,expected",
    [("clean", "clean"), ("Bad Docs", "bad_docs"), ("bad-docs", "bad_docs"), ("junk", "damaged_body"), ("total_junk", "damaged_body"),
     ("owner", "debtor"), ("zzz", "clean")],
)
def test_category(spark, raw, expected):
    assert values(spark, [raw], R.resolve_category) == [expected]


def test_model_answers(spark):
    raws = [
        '{"category":"debtor","confidence":0.9,"flags":["a"],"reasoning":"r"}',
        'x ```json\n{"category":"junk"}\n``` y',
        "```\n{\"category\":\"clean\",\"confidence\":1}\n```",
        'Sure: {"category":"bad_docs","flags":["x"]} bye',
        '{"category":"debtor","confidence":0.8,"reasoning":"cut of',
        "nothing",
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = R.parse_model_response(frame).orderBy("i").collect()
    assert [r.category for r in rows] == ["debtor", "damaged_body", "clean", "bad_docs", "clean", "clean"]
    assert [r.confidence for r in rows] == [0.9, 0.5, 1.0, 0.5, 0.3, 0.3]
    repaired = R.parse_model_response(frame, repair=True).orderBy("i").collect()
    assert (repaired[4].category, repaired[4].reasoning, repaired[5].reasoning) == ("debtor", "cut of", "parse error")
    texts = ['think {"category": {"a": {"b": 1}}} tail', '{"category": "x', "none"]
    assert values(spark, texts, R.first_object) == ['{"category": {"a": {"b": 1}}}', '{"category": "x', None]


def test_page_functions(spark):
    table = "<table><tr><td>A</td><td>1</td></tr><tr><td>A</td><td>2</td></tr><tr><td>B</td><td>&amp;3</td></tr><tr><td>x</td></tr></table>"
    small = "<table><tr><td>Z</td><td>1</td></tr></table>"
    assert values(spark, [table + small], X.spec_table) == [{"A": "2", "B": "&3"}]
    long_text = "line one of many \\n" * 5000
    page = '{"description":"short"} {"description":"' + long_text + '"}'
    assert values(spark, [page], X.extract_description)[0].count("\n") == 5000
    dates = ['{"publishedAt":"2024-04-06T10:00:00Z"}', '{"sortTimeStamp":1712345678000}', '{"time":1000000000}', "{}"]
    assert values(spark, dates, X.extract_listing_date) == ["2024-04-06T10:00:00Z", "2024-04-05T19:34:38+00:00", None, None]
    assert values(spark, ["1712345678000", "2024-04-06T01", "x"], X.offer_date) == ["2024-04-05", "2024-04-06", None]
    prices = ['{"marketPrice":{"value":5000},"priceEstimate":900000}', '{"marketValue":60000000}']
    assert values(spark, prices, X.extract_price_estimate) == [900000, None]
    urls = ["https://auto.cars.example/spb/a/b/1.html", "https://kazan.cars.example/x", "https://auto.cars.example/", "https://omsk2.cars.example/"]
    assert values(spark, urls, lambda c: T.city_from_url(c, "cars.example")) == ["Санкт-Петербург", "Казань", None, "Omsk2"]


def test_bands(spark):
    assert values(spark, [16.0, 15.0, 5.0, 0.0, -10.0, None], L.diff_band, "double") == ["hot", "good", "ok", "neutral", "bad", None]
    assert values(spark, [-40.0, 0.0, 30.0], L.diff_bar_width, "double") == [0, 50, 100]
