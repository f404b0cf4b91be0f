"""Plan properties the design relies on (checked on the executed plans at sf0.001)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tablewright import session

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "scan_filter_project")
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_occurrence_search_has_no_shuffle(spark):
    plan = _plan(spark, "find_occurrences")
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_latest_row_aggregates_map_side(spark):
    assert "partial_max" in _plan(spark, "latest_row_row_number")


def test_share_of_total_has_no_cartesian_product(spark):
    plan = _plan(spark, "share_of_total")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ordered_label_list_takes_bounded_partitions(spark, monkeypatch):
    """The number of partitions follows the rows, so a task's sorts and joins do not grow with the input."""
    query = E.queries()["ordered_label_list"]
    want = sorted(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(session, "PART_ROWS", 50, raising=False)
    got = query(spark, SF)
    assert sorted(map(tuple, got.collect())) == want
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < len(want) // 10
