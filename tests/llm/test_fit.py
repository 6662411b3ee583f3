"""The fit of the decontamination takes part of every text."""

import numpy as np

from kerbside.llm import arrays as A
from kerbside.llm import decontaminate as D


def test_every_text_is_in_the_fit(spark):
    words = [f"{a}{b}{c}" for a in "bcdfghklmnpr" for b in "aeiouy" for c in ("st", "nd", "rk", *"bcdfghjklmnpqrstvwxz")]
    docs = spark.createDataFrame([(w,) for w in words], "text string").repartition(3)
    hashes = [D.hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in words]
    columns = A.distinct(D.column_of(np.concatenate(hashes)))
    assert len(columns) > 1_500
    rows = D.folded(docs, columns, np.ones(D.DIMENSIONS)).collect()
    assert {i for r in rows for i in r["columns"]} == set(range(len(columns)))
    assert len(rows) <= D.FIT_ROWS
    assert all(abs(np.linalg.norm(r["values"]) - D.CORPUS_WEIGHT) < 1e-6 for r in rows)


def test_rows_of_the_fit_keep_the_products(spark):
    """The rows' products are those of the passages: here of one text in many tasks, and the same in every run."""
    text = " ".join(["red", "green", "green", "blue"] * 40)
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    words, _ = D.hashed_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    columns = A.distinct(D.column_of(words))
    for _ in range(2):
        for row in D.folded(docs, columns, np.ones(D.DIMENSIONS)).collect():
            assert sorted(np.round(np.abs(row["values"]) / D.CORPUS_WEIGHT * 6**0.5, 5)) == [1, 1, 2]


def test_the_space_is_that_of_all_passages(spark, monkeypatch):
    """Far more passages than folded rows: the space holds as much of their products as the best one of its size."""
    rng = np.random.default_rng(12)
    words = [f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "klmnprst" for d in "xy"]
    topics, often = [rng.dirichlet(np.full(len(words), 0.03)) for _ in range(60)], 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, 12, p=topics[rng.choice(60, p=often / often.sum())])) for _ in range(3_000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    hashes = {w: D.hashed_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in words}
    items = [D.Item(i, np.array([hashes[w] for w in words[50 * i : 50 * i + 50]]), np.empty(0, np.uint64)) for i in range(8)]
    columns = A.distinct(D.column_of(np.array(list(hashes.values()))))
    weight = np.full(D.DIMENSIONS, 2.0)

    def row(some: list[str]) -> np.ndarray:
        out = np.bincount(np.searchsorted(columns, D.column_of(np.array([hashes[w] for w in some]))), minlength=len(columns)).astype(float)
        return out / np.linalg.norm(out)

    corpus, own = np.stack([row(t.split()) for t in texts]), np.stack([row(words[50 * i : 50 * i + 50]) for i in range(8)])
    both = own.T @ own + D.FIT_ROWS * D.CORPUS_WEIGHT**2 / len(corpus) * corpus.T @ corpus
    spaces, fit = [], D.latent_space
    monkeypatch.setattr(D, "COMPONENTS", 40)
    monkeypatch.setattr(D, "latent_space", lambda *given: spaces.append(fit(*given)) or spaces[-1])
    D.fitted_search(items, weight, docs)
    best = np.sort(np.linalg.eigvalsh(both))[-40:].sum()
    assert np.trace(spaces[-1].T @ both @ spaces[-1]) > 0.985 * best
