"""Parsed detail pages do not pass through the driver."""

import __spark_entry__ as entry


def test_detail_pages_are_not_broadcast(spark, sf):
    plan = entry.queries()["enrich_from_detail"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan
