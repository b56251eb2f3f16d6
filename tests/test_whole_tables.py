"""Queries that read their tables whole."""

from ledgerloom import queries as q


def test_walk_reads_all_customers(spark, sf):
    plan = q.queries()["graph_walk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" in plan and "<= 20" not in plan
