"""Queries for deep pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import search
from marlstone.operators.paging import PageIndex
from marlstone.plans.catalog import _t, query
from marlstone.sources import files

_ORDER = "l_extendedprice desc nulls last, l_orderkey, l_linenumber"
_N = "(select count(*) from lineitem)"


def _index(spark, sf_dir) -> PageIndex:
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return PageIndex.build(items, [F.desc_nulls_last("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], files.scratch(spark, "pages"), 20000)


@query(f"""
with r as (select l_orderkey, l_linenumber, l_extendedprice, l_shipdate, row_number() over (order by {_ORDER}) - 1 as place from lineitem)
select place // 50 as page, l_orderkey, l_linenumber, l_extendedprice, l_shipdate from r where place // 50 in (0, {_N} // 100, ({_N} - 1) // 50)
""")
def deep_pages(spark, sf_dir):
    """The first, a middle and the last page of all line items by price: each reads the ranges that it lies in."""
    index = _index(spark, sf_dir)
    middle, last = index.total // 100, (index.total - 1) // 50
    pages = {n: index.page(50 * n) for n in (0, middle, last)}
    out = [rows.withColumn("page", F.lit(n).cast("long")) for n, rows in pages.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""
select skip, take, total, skip + take < total as has_more, cast(ceil(total / 24.0) as bigint) as pages from (select {_N} as total), (select unnest([0, 900, {_N} - 50, {_N} - 49]) as skip), (select unnest([50, 500]) as take)
""")
def deep_envelopes(spark, sf_dir):
    """What is said with pages: whether there are more rows, by the number that was asked for."""
    index = _index(spark, sf_dir)
    rows = [index.envelope(skip, take) | {"pages": index.pages(24)} for skip in (0, 900, index.total - 50, index.total - 49) for take in (50, 500)]
    return spark.createDataFrame(rows, "skip long, take int, total long, has_more boolean, pages long")


@query("select count(*) as total, 20 as skip, 500 as take, count(*) > 520 as has_more from orders where o_orderpriority = '1-URGENT'")
def envelope_as_asked(spark, sf_dir):
    """More rows than asked for are said to be there or not, whatever the cap on a page."""
    return search.envelope(_t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), 20, 500, capped=False)
