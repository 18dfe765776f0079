"""Samples by hash, lists of what is missing."""

from pyspark.sql import functions as F

from marlstone.operators import records, summaries


def test_sampled(spark):
    """The rows of the smallest hashes, whatever their order, and others for another seed."""
    rows = spark.range(500).withColumn("v", F.col("id") * 2)
    took = lambda df, n, seed: sorted(r.id for r in records.sampled(df, n, "id", seed).collect())
    want = [r.id for r in rows.select("id", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h").limit(40).collect()]
    assert took(rows, 40, 7) == sorted(want) == took(rows.repartition(5).orderBy(F.desc("id")), 40, 7)
    assert took(rows, 40, 8) != sorted(want) and set(took(rows, 20, 7)) < set(want)
    assert len(took(rows, 1000, 7)) == 500 and took(rows, 0, 7) == []
    # Each row is about as likely as any other.
    counts = [0] * 5
    for seed in range(40):
        for i in took(rows, 50, seed):
            counts[i // 100] += 1
    assert sum(counts) == 2000 and min(counts) > 330 and max(counts) < 470


def test_missing_lists(spark):
    left = spark.createDataFrame([(i, "a" if i < 50 else "b") for i in range(60)] + [(99, None), (98, "c")], "k long, g string")
    right = spark.createDataFrame([(i,) for i in range(0, 60, 7)] + [(98,), (98,)], "k long")
    got = {r.g: (r.n, r.n_missing, r.missing) for r in summaries.missing_lists(left, right, "k", "g", 3).where("g is not null").collect()}
    assert got == {"a": (50, 42, [1, 2, 3]), "b": (10, 9, [50, 51, 52]), "c": (1, 0, [])}


def test_timing_of_successes(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 5.0, True), ("a", 100.0, False), ("b", 9.0, False)], "g string, v double, ok boolean")
    got = {r.g: (r.n_rows, r.success_pct, r.n, r.mean, r.most) for r in summaries.timing_of_successes(rows, ["g"], "v", F.col("ok")).collect()}
    assert got == {"a": (3, 66.666667, 2, 3.0, 5.0), "b": (1, 0.0, 0, None, None)}
