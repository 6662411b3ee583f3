"""Queries that score texts."""

from pyspark.sql import functions as F

from kerbside.llm import decontaminate, language_id, lm_scoring, quality_rules, toxicity
from kerbside.llm.q_dedup import documents
from kerbside.llm.registry import query


@query("op3_lm_scoring")
def _(spark, sf):
    return lm_scoring.score(documents(spark, sf))


@query("op6_quality_rules")
def _(spark, sf):
    return quality_rules.classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op8_language_id")
def _(spark, sf):
    return language_id.identify(documents(spark, sf)).select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", "rejected")


@query("op10_toxicity")
def _(spark, sf):
    return toxicity.classify(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op5_decontaminate")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = decontaminate.marked(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select("doc_id", F.inline("leaks")).dropDuplicates(["doc_id", "item_id"])
