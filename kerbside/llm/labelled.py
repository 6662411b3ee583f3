"""Bounded samples of labelled documents, and per-text statistics for classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm.lm_scoring import held_out

#: Most labelled rows that a classifier is fitted on; the rows with the smallest hashes of their ids are taken.
FIT_ROWS = 20_000


def fit_sample(labels: DataFrame, label: str, rows: int = FIT_ROWS, id_col: str = "doc_id", mod: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, y): at most ``rows`` labelled ids that are not held out. A repeated id has its largest label."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("doc_id"), mod, remainder))
    return known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def per_text(docs: DataFrame, text_col: str, names: list[str], measure: Callable, keep: list[str], most: int = 1 << 20) -> DataFrame:
    """Columns ``keep`` and one double per name: ``measure(data, starts)`` of portions of whole texts gives one row per text."""

    def run(batches):
        for batch in batches:
            data, starts = A.text_bytes(batch.column(0))
            found = [measure(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in A.portions(starts, most)]
            values = np.concatenate([*found, np.empty((0, len(names)))]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(np.ascontiguousarray(c)) for c in values.T]], names=[*keep, *names])

    rows = docs.select(F.col(text_col).cast("string").alias("__text"), *keep)
    schema = rows.drop("__text").schema
    for name in names:
        schema = schema.add(name, "double")
    return rows.mapInArrow(run, schema)


def byte_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each byte occurs in each text."""
    return np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(starts[:-1], starts[1:], strict=True)]) if len(starts) > 1 else np.zeros((0, 256))
