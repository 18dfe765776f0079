"""Deep pages against slices of the sorted rows."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators.paging import PageIndex


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).alias("v"))
    order = [F.desc_nulls_last("v"), F.col("id")]
    path = str(tmp_path_factory.mktemp("pages") / "p")
    return PageIndex.build(rows, order, path, 90), [tuple(r) for r in rows.orderBy(*order).collect()], path


def test_every_page(index, spark):
    index, want, path = index
    assert index.total == 1000 and len(index._known["counts"]) == 12
    for skip, take in [(0, 50), (85, 10), (0, 0), (90, 400), (951, 49), (990, 50), (1000, 5), (5000, 5), (-3, 5), (300, 1)]:
        assert [tuple(r) for r in index.rows(skip, take).collect()] == want[max(0, skip) : max(0, skip) + take]
    assert [tuple(r) for r in index.page(10, 500).collect()] == want[10:110]
    assert [tuple(r) for r in index.last_page(30).collect()] == want[990:]
    assert PageIndex(spark, path).total == 1000


def test_a_page_reads_where_it_lies(index):
    index, _, _ = index
    deep = index.rows(940, 20)
    assert len(deep.inputFiles()) <= 2
    shown = plan(deep)
    assert "TakeOrderedAndProject" not in shown and "PushedFilters: [" in shown and "_place" in shown


def test_envelopes(index):
    index, _, _ = index
    assert index.envelope(500, 500) == {"total": 1000, "skip": 500, "take": 500, "has_more": False}
    assert index.envelope(499, 500)["has_more"] and index.pages(24) == 42


def test_empty(spark, tmp_path):
    index = PageIndex.build(spark.range(0), [F.col("id")], str(tmp_path / "e"))
    assert index.total == 0 and index.page(0).count() == 0 and index.last_page().count() == 0 and index.pages() == 0
    assert not index.envelope()["has_more"]
