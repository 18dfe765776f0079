"""Aggregates: counts with defaults and remainders, timing and accuracy measures, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, key: Column, name: str = "key", default: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(key, F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def top_with_rest(counts: DataFrame, n: int, key: str = "key", rest: str = "remaining") -> DataFrame:
    """The n largest counts (ties by key) and the sum of all others in one row, if there are any."""
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(n)
    others = counts.join(F.broadcast(top.select(key)), key, "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return top.select(key, "n").unionByName(others.select(F.lit(rest).alias(key), "n"))


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Row count, and for each flag its count and percentage (0 without rows)."""
    out = [F.count("*").alias("n")]
    for name, flag in flags.items():
        out += [F.count_if(flag).alias(f"n_{name}"), F.round(F.coalesce(100.0 * F.try_divide(F.count_if(flag), F.count("*")), F.lit(0.0)), 6).alias(f"pct_{name}")]
    return df.groupBy(*by).agg(*out)


def rank_value(values: Column, n: Column, share: float = 0.95, least: int = 20) -> Column:
    """The value at place floor(n * share) in order, or the largest of fewer than ``least`` values."""
    ordered = F.array_sort(values)
    return F.when(n >= least, F.element_at(ordered, (F.floor(n * share) + 1).cast("int"))).otherwise(F.array_max(values))


def running(rows: DataFrame, by: list[str], order: list[str], n: str, upto: str) -> DataFrame:
    """Rows with the sum of ``n`` from the first row of their group up to them, in ``order``.

    Rows are dealt by ranges of (group, order), added up within each range, and shifted by what the ranges before hold of
    their group, of which there is one number for each range and group: no task holds a group.
    """
    key = F.struct(*by, *order)
    # Kept, as ranges that were drawn anew for either use might differ.
    dealt = rows.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()).persist()
    own = Window.partitionBy("_part", *by).orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("_part", *by).agg(F.sum(n).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    same = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["_part", *by]])
    out = dealt.withColumn("_own", F.sum(n).over(own)).alias("d").join(before.alias("b"), same)
    return out.select(*[f"d.{c}" for c in rows.columns], (F.col("_own") + F.col("_before")).alias(upto))


def timing(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, both standard deviations, min, max, median and the 95th place of a measure.

    Places are exact without gathering a group: values are counted first, and running counts find them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("std_pop"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std_sample"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    placed = running(counted, by, [value], "_n", "_upto").join(F.broadcast(stats.select(*by, F.col("n").alias("_all"))), by)  # a row for each group
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col(value)))
    target = F.when(F.col("_all") >= 20, F.floor(F.col("_all") * 0.95) + 1).otherwise(F.col("_all"))
    middle = (at(F.floor((F.col("_all") + 1) / 2)) + at(F.ceil((F.col("_all") + 1) / 2))) / 2
    return stats.join(placed.groupBy(*by).agg(F.round(middle, 6).alias("median"), at(target).alias("p95")), by, "left")


def field_accuracy(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """field, n, n_equal, pct of pairs of (predicted, true); pairs with a missing side don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), a.cast("string").alias("a"), b.cast("string").alias("b")) for k, (a, b) in fields.items()]))
    rows = df.select(pairs.alias("p")).select("p.*").where("a is not null and b is not null")
    return rates(rows, ["field"], {"equal": F.col("a") == F.col("b")})


def compared(df: DataFrame, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Four-way tally for each field of (first, second, truth): both, only_first, only_second, neither."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), (a.eqNullSafe(t)).alias("x"), (b.eqNullSafe(t)).alias("y")) for k, (a, b, t) in fields.items()])).alias("p")).select("p.*")
    verdict = F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), "only_first").when(F.col("y"), "only_second").otherwise("neither")
    return rows.groupBy("field", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def coverage(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """For each group of ``left``: rows, rows with a partner, rows without, and the percentage covered."""
    joined = left.join(right.select(F.col(key), F.lit(True).alias("_has")).distinct(), key, "left")
    return rates(joined, [by], {"covered": F.col("_has").isNotNull()}).withColumn("n_missing", F.col("n") - F.col("n_covered"))


def missing_lists(left: DataFrame, right: DataFrame, key: str, by: str, most: int = 20) -> DataFrame:
    """For each group of ``left``: rows, rows without a partner in ``right``, and the first ``most`` of their keys. Keys are
    cut to so many before they are listed, so a list has a bounded size."""
    gone = left.join(right.select(key).distinct(), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(by).orderBy(key))
    listed = gone.withColumn("_n", first).where(F.col("_n") <= most).groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("missing"))
    counts = left.groupBy(by).agg(F.count("*").alias("n")).join(gone.groupBy(by).agg(F.count("*").alias("n_missing")), by, "left")
    return counts.join(listed, by, "left").select(by, "n", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("missing", F.array().cast(f"array<{left.schema[key].dataType.simpleString()}>")).alias("missing"))


def timing_of_successes(df: DataFrame, by: list[str], value: str, success: Column) -> DataFrame:
    """Timing of the rows that succeeded, for every group, with the number of its rows and the share that did; a group without
    a success has no times."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.round(100.0 * F.count_if(success) / F.count("*"), 6).alias("success_pct"))
    good = timing(df.where(success), by, value)
    return counts.join(good, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def leaderboard(df: DataFrame, by: str, success: Column, seconds: Column) -> DataFrame:
    """Success percentage, mean of positive times to one decimal (half to even), and rank by (rate, time)."""
    table = df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.bround(100.0 * F.count_if(success) / F.count("*"), 1).alias("success_pct"),
        F.bround(F.avg(F.when(seconds > 0, seconds)), 1).alias("mean_seconds"),
    )
    # One row for each contestant.
    return table.withColumn("place", F.rank().over(Window.orderBy(F.desc("success_pct"), F.asc_nulls_last("mean_seconds"))))


def imbalance(counts: DataFrame) -> DataFrame:
    """Whether the largest count exceeds the smallest by more than a fifth of it."""
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("unbalanced", F.col("most") - F.col("least") > 0.2 * F.col("least"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that come several times, and how many rows are too many."""
    return df.groupBy(key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")
