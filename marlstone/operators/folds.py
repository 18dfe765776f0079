"""Ordered folds that a running sum cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clamped(df: DataFrame, key: str, order: list[str], delta: str, start: int, floor: int = 0) -> DataFrame:
    """key, n, level: the sum of the deltas in order, held at ``floor`` whenever it would fall below.

    The level after all steps is the larger of start + total and, over every step, floor + what comes after it, so a
    running sum and a maximum give it: no ordered list is gathered for a key.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(key, delta, F.sum(delta).over(upto).alias("_upto"))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(delta).alias("_total"), F.min("_upto").alias("_low"))
    level = F.greatest(F.lit(start) + F.col("_total"), F.lit(floor) + F.col("_total") - F.col("_low"))
    return out.select(key, "n", level.alias("level"))
