"""Scoring, classifiers, language, decontamination: brute force where there is one, held-out accuracy, edge cases."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from kerbside.llm import decontaminate, language_id, lm_scoring, quality_rules, toxicity
from tests.llm import brute

EDGES = [(None, "words without an id"), (900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, "word " * 300_000), (900_005, "!!! 123 ???"), (900_006, "same"), (900_006, "same")]


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def with_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(d, t, None) for d, t in EDGES], "doc_id long, text string, lang string")
    # columns with names that the operators use themselves
    return docs.union(more).selectExpr("*", "1 AS y", "'a' AS block", "2 AS score", "3 AS words", "4 AS chars", "5 AS plain", "6 AS held_out", "7 AS margin", "8 AS leaks")


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1.0, abs(b))


def test_lm_scores(spark, sf, documents):
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in entry.queries()["op3_lm_scoring"](spark, sf).collect()}
    want = brute.lm_scores(documents)
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:4] == w[:4] and close(got[d][4], w[4]) and close(got[d][5], w[5])


def test_lm_edges(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LANE", 3)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["a", "B", "c", "dd", "e,"], k=rng.randint(0, 30)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, " \x0b "), (903, "unknown words only"), (904, "a b " * 200_000), rows[3]]
    docs = spark.createDataFrame([(d, t, 1, True) for d, t in rows], "doc_id long, text string, block int, held_out boolean")
    out = lm_scoring.score(docs).collect()
    want = brute.lm_scores(dict(rows).items())
    assert len(out) == len(want)
    for r in out:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and close(r.base_score, w[4]) and close(r.score, w[5])
    assert lm_scoring.score(docs.filter("false")).count() == 0


def test_model_sums_to_one(spark):
    """After any history the probabilities of all known tokens and of one unknown token add up to 1."""
    rows = [(i, t) for i, t in enumerate(["a b", "b a a", "a", "c b a", "b b"] * 6)]
    kinds = ["a", "b", "c", "zzz"]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i in range(1000, 3000) if brute.rest(i, 10) == 0]
    asked = [("", []), ("a", ["a"]), ("b a", ["b", "a"])]
    texts = [" ".join([*h, k]) for _, h in asked for k in kinds] + [" ".join(h) for _, h in asked]
    docs = train.union(spark.createDataFrame(list(zip(held, texts)), "doc_id long, text string"))
    scores = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    by_text = {t: scores[d] for d, t in zip(held, texts)}
    plain = brute.lm_scores([*rows, *zip(held, texts)])
    assert all(close(scores[d], plain[d][5]) for d in held[: len(texts)])
    assert by_text["b a a"] > by_text["b a zzz"]


def test_quality(spark, sf, with_edges):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.classify(with_edges, labels).collect()
    assert len(out) == with_edges.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    known = {r.doc_id: r.quality for r in labels.collect()}
    held = [(known[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert {c for c, _ in quality_rules.classify(with_edges, labels.filter("false")).select("score", "predicted").distinct().collect()} == {0.5}
    assert quality_rules.classify(with_edges.filter("false"), labels).count() == 0
    left = quality_rules.kept(with_edges, labels)
    assert left.columns == with_edges.columns and left.count() == sum(r.predicted for r in out)


def test_rules_compile_to_what_the_trees_say(spark):
    rng = random.Random(5)
    rows = [(float(a > 0.6 and b < 0.5), a, b) for a, b in ((rng.random(), rng.random()) for _ in range(600))]
    model = quality_rules.fit(spark.createDataFrame(rows, "y double, a double, b double"), ["a", "b"])
    assert model.rules
    got = spark.createDataFrame(rows, "y double, a double, b double").select("y", model.score(["a", "b"]).alias("s")).collect()
    assert sum((r.s > 0.5) == bool(r.y) for r in got) >= 0.95 * len(got)
    text = "Tree 0\n  If (feature 1 <= 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.0\n   Else (feature 0 > 2.0)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0"
    assert {r.terms for r in quality_rules.tree_rules(text)} == {((1, False, 0.5),), ((0, False, 2.0), (1, False, 0.5)), ((0, True, 2.0), (1, False, 0.5)), ((1, True, 0.5),)}


def test_toxicity(spark, sf, with_edges):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = toxicity.classify(docs, labels).collect()
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(known[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    out = toxicity.classify(with_edges, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(out) == with_edges.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = toxicity.classify(with_edges, labels.filter("false")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]
    assert toxicity.classify(with_edges.filter("false"), labels).count() == 0


def test_toxic_features():
    import numpy as np
    import pyarrow as pa

    from kerbside.llm import arrays as A

    lexicon = {}
    for terms, _ in toxicity.terms_of(*A.text_bytes(pa.array(["stupid"]))):
        lexicon = {int(t): 3.0 for t in terms.view(np.int64)}
    measure = toxicity.features(lexicon)
    found = measure(*A.text_bytes(pa.array(["you are STUPID!", "st0pid s7up1d", "stupidity", "a clean text", "", None])))
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert found[0, at["plain"]] == 1 and found[0, at["near_second"]] == 1 and found[0, at["exclamations"]] > 0
    assert found[1, at["hidden"]] == 1 and found[1, at["obfuscated"]] > 0  # st0pid reads stopid, s7up1d reads stupid
    assert found[2, at["plain"]] == 1 and (found[3, : at["capitals"]] == 0).all() and (found[4:] == 0).all()


def test_languages(spark, sf, with_edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = language_id.identify(docs).collect()
    held = [(known[r.doc_id], r.lang) for r in out if r.held_out]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)
    out = language_id.identify(with_edges).collect()
    assert len(out) == with_edges.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang for r in out if r.doc_id in (900_001, 900_002, 900_003, 900_005)} == {"und"}
    assert {r.lang for r in language_id.identify(with_edges.withColumn("lang", with_edges["lang"].substr(9, 1)).filter("false")).collect()} == set()
    nothing = with_edges.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang for r in language_id.identify(nothing).collect()} == {"und"}


def test_leaks(spark, sf, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = {}
    for r in entry.queries()["op5_decontaminate"](spark, sf).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {}
    for d, t in documents:
        inside = {i for i, x in items if x in (t or "")}
        if inside:
            want[d] = inside
    assert sum(len(v & got.get(d, set())) for d, v in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert len(set(got) - set(want)) <= 0.02 * len(documents)


def test_leak_edges(spark, with_edges):
    rng = random.Random(3)
    words = ["".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice("aeiou") + str_ for str_ in "abcdefghijklmnopqrst" for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 60))) + ". " + " ".join(rng.choices(words, k=6)) + ".") for i in range(30)]
    long_item = (30, " ".join(rng.choices(words, k=300)))
    fill = lambda n: " ".join(rng.choices(words, k=n))

    def paraphrased(text):
        return " ".join(w if rng.random() > 0.15 else rng.choice(words) for w in text.split())

    rows = [(100 + i, f"{fill(70)} {t} {fill(50)}") for i, t in items] + [(200 + i, f"{fill(40)} {paraphrased(t).upper()} {fill(40)}") for i, t in items[:10]]
    rows += [(300 + i, fill(150)) for i in range(60)] + [(400, fill(20_000) + " " + items[0][1]), (401, long_item[1]), (402, None), (403, ""), (404, items[3][1]), (404, items[3][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, long_item, (31, None), (None, "a b c"), (32, ""), (33, "..."), items[2]]], "item_id long, text string, block string")
    out = decontaminate.marked(docs, bench).collect()
    assert len(out) == len(rows)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, set()).update(x.item_id for x in r.leaks)
    planted = [(100 + i, i) for i in range(30)] + [(200 + i, i) for i in range(10)] + [(400, 0), (401, 30), (404, 3)]
    assert sum(i in found[d] for d, i in planted) >= 0.9 * len(planted)
    assert not any(found[300 + i] for i in range(60)) and not found[402] and not found[403]
    assert not any(r.leaks for r in decontaminate.marked(docs, bench.filter("false")).collect())
    assert decontaminate.marked(docs.filter("false"), bench).count() == 0


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | (1 << i)
        assert decontaminate.common_subsequence(masks, len(a), b) == best[-1][-1]


def test_latent_space_is_the_dominant_one(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    dense = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 40)) + 0.01 * rng.standard_normal((60, 40))
    rows = spark.createDataFrame([(list(range(40)), [float(x) for x in r]) for r in dense], "columns array<int>, values array<double>").repartition(4)
    space = decontaminate.latent_space(rows, 40, 4)
    assert np.allclose(space.T @ space, np.eye(4), atol=1e-8)
    exact = np.linalg.svd(dense)[2][:4]
    assert np.allclose(np.abs(np.linalg.svd(exact @ space)[1]), 1, atol=1e-6)


def test_leaks_of_common_words(spark):
    """Copies of an item, and near copies around it, make its words common; they are still found."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    item = " ".join(word() for _ in range(20)) + "."
    rows = [(i, item) for i in range(60)] + [(100 + i, f"{word()} {word()} {item} {word()}") for i in range(30)]
    rows += [(200 + i, " ".join(word() for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.marked(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found if [x.item_id for x in r.leaks] == [1]} == {i for i, _ in rows if i < 200}
    # a copy counts once
    frequencies, texts = decontaminate.document_frequencies(docs, "text")
    assert texts == 131 and frequencies.max() < 60


@pytest.mark.parametrize("around", [0, 40, 20_000])
def test_leaks_among_rare_words(around):
    """How rare the words around an item are does not matter, also where the item has been edited."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]
    item = words(13)
    (passage,) = decontaminate.passages_of([(1, " ".join(item))])
    columns = decontaminate.np.unique(decontaminate.column_of(passage.words))
    weight = decontaminate.np.full(decontaminate.DIMENSIONS, 12.0)
    weight[columns] = 3.0
    search = decontaminate.Search([passage], weight, columns, decontaminate.np.eye(len(columns)))
    edited = [*item[:6], *words(1), *item[7:]]
    for inner, share in ((item, 1), (edited, 12 / 13)):
        data = decontaminate.np.frombuffer(" ".join([*words(around), *inner, *words(around)]).encode(), "uint8")
        found = search.leaks(decontaminate.hashed_words(data, decontaminate.np.array([0, len(data)]))[0])
        assert [(x["item_id"], x["common"]) for x in found] == [(1, share)]


def test_every_language_is_learned(spark):
    """More languages than one group of dictionaries holds, each with words of its own."""
    rows = []
    for n in range(203):
        rng = random.Random(n)
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        rows += [(n * 4 + i, " ".join(rng.choices(words, k=60)), f"l{n:03d}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.held_out, r.lang) for r in language_id.identify(docs).collect()}
    trained = {lang for d, _, lang in rows if not got[d][0]}
    assert len(trained) > 200 and all(got[d][1] == lang for d, _, lang in rows if lang in trained)
