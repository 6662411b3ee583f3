"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text (shares of kinds of characters, lengths and repetition of words, lines) feed small trees; every
path from a root to a node is a conjunctive rule. A logistic regression with an L1 penalty keeps few of these rules, and the
rules that stay are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm.labelled import FIT_ROWS, byte_counts, fit_sample, per_text
from kerbside.llm.lm_scoring import held_out
from kerbside.llm.storage import stage

TREES, DEPTH, PENALTY, SEED = 24, 3, 0.001, 7

STATISTICS = [
    "chars", "words", "word_length", "capitals", "digits", "marks", "symbols", "bars", "exclamations", "breaks", "commas", "stops",
    "distinct_words", "repeated_next", "top_word", "distinct_pairs", "other_bytes",
]


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(".,;:!?\"'()-"), _class("#%&$*@^~=+<>{}[]\\/_`"), _class("|"), _class("!"),
    _class("\n"), _class(","), _class("."), _class(" \t\n\v\f\r"), (np.arange(256) >= 128).astype(float),
], axis=1)


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The STATISTICS of each text; shares of an empty text are 0."""
    classes = byte_counts(data, starts) @ _CLASSES
    size = np.diff(starts)
    h, first = A.words(data, starts)
    out = np.zeros((len(size), len(STATISTICS)))
    for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)):
        n = int(y - x)
        if not size[i]:
            continue
        capitals, digits, marks, symbols, bars, exclamations, breaks, commas, stops, spaces, other = classes[i]
        own = h[x:y]
        kinds, counts = np.unique(own, return_counts=True)
        pairs = len(np.unique(A.grams(own, 2))) if n > 1 else 0
        letters, m = size[i], max(n, 1)
        out[i] = (
            letters, n, (letters - spaces) / m, capitals / letters, digits / letters, marks / m, symbols / m, bars / m, exclamations / m,
            breaks / m, commas / m, stops / m, len(kinds) / m, float((own[1:] == own[:-1]).sum()) / m, (counts.max() if n else 0) / m,
            pairs / max(n - 1, 1), other / letters,
        )
    return out


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, names: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(names[i]) > t if above else F.col(names[i]) <= t for i, above, t in self.terms])


@dataclass(frozen=True)
class Model:
    """Rules with their weights; ``score`` is the column expression they compile to."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, names: list[str]) -> Column:
        weights = [F.when(rule.column(names), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, weights, F.lit(self.intercept))))


_STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)")


def tree_rules(description: str) -> list[Rule]:
    """Paths of all trees in Spark's description of an ensemble."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in description.splitlines():
        step = _STEP.match(line)
        if not step:
            if "Tree" in line:
                path = []
            continue
        indent = len(step[1])
        path = [p for p in path if p[0] < indent] + [(indent, (int(step[2]), step[3] == ">", float(step[4])))]
        # several bounds on one side of one statistic are one
        tight: dict[tuple[int, bool], float] = {}
        for _, (i, above, t) in path:
            tight[i, above] = max(t, tight.get((i, above), t)) if above else min(t, tight.get((i, above), t))
        found[Rule(tuple(sorted((i, above, t) for (i, above), t in tight.items())))] = None
    return list(found)


def fit(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    """Rules and weights from rows with the statistics ``names`` and a label ``y``. Without both labels: their share."""
    positive, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1))).first()
    if positive in (0.0, float(total)):
        share = min(max(positive / total if total else 0.5, 0.01), 0.99)
        return Model(float(np.log(share / (1 - share))), ())
    rows = rows.coalesce(2)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "y", *names)
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED, minInstancesPerNode=10, subsamplingRate=0.7).fit(data)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        share = min(max(positive / total, 0.01), 0.99)
        return Model(float(np.log(share / (1 - share))), ())
    held = [F.when(r.column(names), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(rules)]
    binary = stage(data.select("y", *held), "rules")
    binary = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(binary).select("features", "y").coalesce(2)
    lasso = LogisticRegression(labelCol="y", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(binary)
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0.0))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Model of at most ``fit_rows`` labelled documents that are not held out (crc32 of the id by 5 is not 0)."""
    sample = fit_sample(labels, label, fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    return fit(stage(per_text(rows, "text", STATISTICS, statistics, ["y"]), "quality-fit"), STATISTICS)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.3, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``score`` is the probability of label 1.

    Null and empty texts have statistics of 0 and a score like any other; a row without an id is scored and not held out;
    repeated rows are each scored; other columns are ignored. Without both labels in the sample every score is the share of
    label 1 (0.5 without labels), within 0.01 and 0.99.
    """
    model = fit_on(docs, labels, id_col, text_col, label, fit_rows)
    found = per_text(docs.withColumnRenamed(id_col, "doc_id"), text_col, STATISTICS, statistics, ["doc_id"])
    score = found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.score(STATISTICS).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    prefix = "__quality_"
    model = fit_on(docs, labels, id_col, text_col)
    names = [prefix + s for s in STATISTICS]
    found = per_text(docs, text_col, names, statistics, docs.columns)
    return found.filter(model.score(names) >= threshold).select(*docs.columns)
