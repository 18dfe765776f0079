"""Joins between records against plain versions."""

from pyspark.sql import functions as F

from marlstone.operators import relations
from marlstone.plans import catalog


def test_containing(spark):
    """Needles within longer words, of one or two words, of signs only, and of one character."""
    texts = {1: "Smart of warfare, no?", 2: "the art  of war", 3: "An art of war -- 漢字かな", 4: "", 5: None, 6: "naïve\n\U0001f600 café!", 7: "part of wares"}
    needles = ["art of war", "rt of WA", "art", "of war", "f w", "字か", "--", " ", "é", "\U0001f600", "a", "ar", "e, n", ", no?", "missing", "of", "", None]
    t = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "item_id long, needle string")
    got = relations.containing(t, "doc_id", "text", n, "item_id", "needle").collect()
    want = {(i, d) for i, x in enumerate(needles) if x for d, y in texts.items() if y and x.lower() in y.lower()}
    assert {(r.item_id, r.doc_id) for r in got} == want
    assert len(got) == len(want)


def test_member_edges_names_in_common(spark):
    """Customers are found by a name that others share as well as by their own."""
    folder = "/root/testdata/sf0.01"
    orders = [(r.o_orderkey, r.o_custkey) for r in spark.read.parquet(f"{folder}/orders.parquet").collect()]
    customers = {r.c_custkey for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    sharing = {}
    for c in customers:
        sharing.setdefault(c % 500, []).append(c)
    want = {(o, x) for o, c in orders for m in (c, c + 1, c % 7) for x in [m] * (m in customers) + sharing.get(m, []) if x != o}
    got = [tuple(r) for r in catalog.member_edges(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cells_make_every_pair_once(spark):
    """A key that most rows have is dealt to many cells of a few rows; the pairs are those of the plain join."""
    left = spark.createDataFrame([(0 if i % 5 else i, i) for i in range(300)] + [(None, -1)], "k long, a long")
    right = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(200)] + [(None, -1)], "k long, b long")
    x, y, on = relations.in_cells(left, right, "k", "a", "b", most=16)
    sizes = x.join(y, on).groupBy(on).agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).collect()
    assert max(r.a for r in sizes) < 48 and max(r.b for r in sizes) < 48 and len(sizes) > 100
    got = [(r.a, r.b) for r in x.join(y, on).select("a", "b").collect()]
    want = [(r.a, r.b) for r in left.join(right, "k").select("a", "b").collect()]
    assert sorted(got) == sorted(want)


def test_member_edges_are_not_shuffled(spark):
    """Pairs with several members in common come once without being compared: what makes them is not grouped by them."""
    rows = [(1, [1, 2, 3]), (1, [3, 4, None]), (2, []), (3, None), (4, [4, 2]), (None, [1])]
    named = [(7, 1), (7, 2), (7, 2), (8, 4), (1, 3), (9, None), (None, 1), (4, 4), (8, 3)]
    df = spark.createDataFrame(rows, "k long, m array<long>")
    names = spark.createDataFrame(named, "o long, n long")
    out = relations.member_edges(df, "k", F.col("m"), names, "n", "o")
    want = {(k, o) for k, ms in rows for o, n in named if k is not None and o is not None and n is not None and n in (ms or []) and k != o}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join Inner")[0]
