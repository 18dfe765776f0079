"""Card pages: what a plan does for each page, and how pages are dealt to tasks."""

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def plan_of(spark, df):
    """The optimized plan with all its expressions."""
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("name", ["card_pages_en", "card_pages_en_nested", "card_pages_hk", "card_pages_jp", "card_pages_hk_nested", "card_pages_jp_nested"])
def test_a_page_is_worked_through_once(spark, name):
    """Its tags are numbered once, not again in the filter for pages with a name, and pages in one file are dealt to all
    cores."""
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert plan_of(spark, df).count("(?is)<!--.*?-->|<(script|style)") == 1
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
