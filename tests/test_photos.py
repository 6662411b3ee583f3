"""Photo addresses: what is searched, and the same addresses as a search of the whole page."""

import random

from pyspark.sql import functions as F

from kerbside.common import let
from kerbside.operators import extract as X


def test_only_pieces_with_addresses_are_searched(spark, monkeypatch):
    monkeypatch.setattr(X, "_extract_photos", lambda page: F.array(page))
    page = r'head{\"a\":1},{"x":"no address"},{\"640x480\":\"https://a.example/1\"},{"tail":2}'
    whole = r'head{\"a\":1},{"640x480":"https://a.example/{1"}'
    rows = spark.createDataFrame([(1, page), (2, whole), (3, None)], "i int, html string")
    found = {r.i: r.p for r in rows.select("i", X.extract_photos(F.col("html")).alias("p")).collect()}
    assert found == {1: ['head{"640x480":"https://a.example/1"},'], 2: [whole.replace('\\"', '"')], 3: [None]}


def test_same_as_whole_page(spark):
    rng = random.Random(11)
    parts = [
        "{", "}", '"', '\\"', "\\\\", "\\", "1280x960", '"1280x960":"https://a/b"', '"1280x960":"https://a/{b"', '"origImage" : "http://q/1"',
        '"https://00.img.x/image/1/z"', '"https://00.img.x/image/1/', '{"640x480":"http://k/9"}', ":", "x", "http://", "\n", ",", '"image1280x960":"https://icon/1"',
    ]
    pages = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(5000)] + [(-1, None), (-2, "")]
    rows = spark.createDataFrame(pages, "i long, html string")
    whole, cut = let(X.unescape(F.col("html")), X._extract_photos), X.extract_photos(F.col("html"))
    out = rows.select(whole.alias("whole"), cut.alias("cut")).collect()
    assert sum(bool(r.whole) for r in out) > 1000
    assert all(r.whole == r.cut for r in out)


def test_an_offers_photo_is_parsed_once(spark):
    import json

    from kerbside.operators import extract as X

    def offer(*photos):
        vehicle = {"mark_info": {"name": "B"}, "model_info": {"name": "m"}}
        return json.dumps({"id": "1", "price_info": {"RUR": 5}, "photos": list(photos), "vehicle_info": vehicle})

    sized = {"sizes": {"320x240": "s", "456x342": "m"}}
    given = [offer(sized, "plain", {"sizes": {"456x342": "", "320x240": "t"}}, {"sizes": {"9x9": "no"}}, {"x": 1}, "sixth"), offer(), offer({"sizes": {"1200x900": "l", "456x342": "m"}})]
    out = X.flatten_offer_json(spark.createDataFrame([(g,) for g in given], "offer string"))
    assert sorted(r["photos"] for r in out.select("photos").collect()) == [[], ["l"], ["m", "plain", "t"]]
    plan = out.select("photos")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(sizes") == 1
