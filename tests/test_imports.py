"""Imports: joins with results."""

import re

import __spark_entry__


def test_results_are_not_broadcast(spark):
    """Results made from a small file may be many: they are joined where they are dealt to, never sent to every task."""
    df = __spark_entry__.queries()["detected_boxes"](spark, "/root/testdata/sf0.001")
    joins = re.findall(r"(\w+Join) .*LeftOuter", df._jdf.queryExecution().executedPlan().toString())
    assert joins == ["SortMergeJoin"]
