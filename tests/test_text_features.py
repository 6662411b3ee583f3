"""The decomposition of the TF-IDF matrix against NumPy."""

import random

import numpy as np
from pyspark.sql import functions as F

from kerbside.operators import text_features as TF


def test_svd_equals_numpy(spark):
    rng = random.Random(3)
    words = ["red", "blue", "green", "door", "wheel", "engine", "seat", "roof"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12)))) for i in range(120)] + [(500, "zzz"), (501, None)]
    table = spark.createDataFrame(rows, "doc_id long, description string").repartition(3)
    fitted = TF.fit_description_features(table, "description", components=4, min_df=2)
    out = {r.doc_id: np.array(r.svd) for r in fitted.transform(table, "description", "doc_id").collect()}
    vectors = fitted.model.transform(table.withColumn("words", TF.tokens(F.col("description")))).select("doc_id", "tfidf").collect()
    matrix = np.array([r.tfidf.toArray() for r in vectors])
    exact = np.linalg.svd(matrix)
    assert np.allclose(fitted.singular_values, exact[1][:4], rtol=1e-6)
    assert np.allclose(fitted.components.T @ fitted.components, np.eye(4), atol=1e-8)
    projected = np.array([out[r.doc_id] for r in vectors])
    assert np.allclose(projected, matrix @ fitted.components, atol=1e-9)
    lost = np.linalg.norm(matrix - projected @ fitted.components.T) ** 2
    assert np.isclose(lost, (exact[1][4:] ** 2).sum(), rtol=1e-6)
    assert not out[500].any() and not out[501].any()


def test_passes_over_the_rows_are_few(spark, monkeypatch):
    """A pass multiplies a block of columns, and the decomposition of 400 terms needs a handful of passes."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"term{w}" for w in rng.zipf(1.3, 30) if w < 300)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, description string").repartition(3)
    passes, product = [], TF.gram_product
    monkeypatch.setattr(TF, "gram_product", lambda *a: passes.append(1) or product(*a))
    fitted = TF.fit_description_features(table, "description", components=20, min_df=2)
    vectors = fitted.model.transform(table.withColumn("words", TF.tokens(F.col("description")))).select("tfidf").collect()
    exact = np.linalg.svd(np.array([r.tfidf.toArray() for r in vectors]))[1]
    assert len(fitted.model.stages[2].vocabulary) > TF.BLOCK
    assert np.allclose(fitted.singular_values, exact[:20], rtol=1e-9)
    assert 1 < len(passes) <= 20


def test_keys_that_repeat_or_are_missing(spark):
    """Rows of one key are counted together, rows without a key have no terms; other keys are as on their own."""
    texts = ["red green door", "red wheel engine", "green wheel door seat", "door engine red", "seat roof green"] * 4
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, description string")
    fitted = TF.fit_description_features(table, "description", components=3, min_df=2)
    odd = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3])], "doc_id long, description string")
    joined = spark.createDataFrame([(2, texts[2]), (9, texts[3])], "doc_id long, description string")
    found = fitted.transform(odd, "description", "doc_id").collect()
    alone = {r.doc_id: r.svd for r in fitted.transform(joined, "description", "doc_id").collect()}
    assert len({tuple(r.svd) for r in found if r.doc_id == 1}) == 1
    assert [(any(r.svd), r.has_terms) for r in found if r.doc_id is None] == [(False, False)]
    assert all(np.allclose(r.svd, alone[2], atol=1e-12) and r.has_terms for r in found if r.doc_id == 2)
