"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.storage import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so long
    chains shrink quickly. Labels are written to the shared folder between the rounds.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        best = near.union(labels).groupBy("node").agg(F.min("component").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("further"))
        # what a label is itself labelled with, one step on
        new = best.join(jump, "best", "left").select("node", F.least("best", F.coalesce("further", "best")).alias("component"))
        new = stage(new, "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
