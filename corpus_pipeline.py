"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Between the stages the documents are written as Parquet to the cluster's shared folder and read again.
Columns besides doc_id, text, lang, source and n_chars pass through the first two stages and the fourth; the third
keeps the five. Rows without a doc_id leave at the second stage; rows that repeat an id become one at the third.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import decontaminate, jaccard_join, mixing, quality_rules, suffix_dedup
from kerbside.llm.storage import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality_rules.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    classes = jaccard_join.linked_classes(docs)
    return docs.join(classes.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def whole_characters(kept: str, edges: str) -> Column:
    """Kept bytes as a string, without the bytes of characters that a removed run cuts through; runs were at ``edges``."""
    ends = F.concat(edges, F.array(F.octet_length(kept).cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), edges)
    # a character for every byte, so that patterns can tell the bytes of a character's inside from those that begin one
    pieces = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(F.col(kept), (a + 1).cast("int"), (b - a).cast("int")), "ISO-8859-1"))
    inside, unfinished = "^[\\x80-\\xBF]+", "(?:[\\xC2-\\xDF]|[\\xE0-\\xEF][\\x80-\\xBF]?|[\\xF0-\\xF4][\\x80-\\xBF]{0,2})\\z"
    pieces = F.transform(pieces, lambda p: F.regexp_replace(F.regexp_replace(p, inside, ""), unfinished, ""))
    return F.encode(F.array_join(pieces, ""), "ISO-8859-1").cast("string")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a character that was cut through goes."""
    out = suffix_dedup.without_repeats(docs, carry=["lang", "source"])
    out = out.withColumn("text", F.when(F.size("spans") > 0, whole_characters("kept", "edges")).otherwise(F.col("kept").cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    marked = decontaminate.marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter(F.size("leaks") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for every time a document is taken, with its output shard and place."""
    return mixing.mixed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
]

#: The fitted stages cannot be said in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
