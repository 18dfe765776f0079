"""Record sets: deduplication, sampling, splitting, upserts, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.summaries import running


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_place_last_value(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key with the values of its last row at the place of its first."""
    value = F.max_by(F.struct(*[c for c in df.columns if c not in (key, seq)]), seq)
    return df.groupBy(key).agg(F.min(seq).alias(seq), value.alias("_v")).select(key, seq, "_v.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """Full outer merge: a column takes the new value ('new'), the new one unless null ('fill_new', the default), or the
    old one unless null ('keep'). ``new`` must have one row per key."""
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    there = F.lit(True)
    rows = a.withColumn("_old", there).alias("a").join(b.withColumn("_new", there).alias("b"), on, "full_outer")
    out = [F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys]
    for c in (c for c in old.columns if c not in keys):
        how = (policy or {}).get(c, "fill_new")
        if how == "new":
            out.append(F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.coalesce(*([f"b.{c}", f"a.{c}"] if how == "fill_new" else [f"a.{c}", f"b.{c}"])).alias(c))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return rows.select(*out, outcome.alias("outcome"))


def classified(column: Column, rules: list[tuple[list[str], str]], default: Column) -> Column:
    """The label of the first rule of which some pattern is contained."""
    out = None
    for words, label in rules:
        test = reduce(lambda x, y: x | y, [F.contains(column, F.lit(w)) for w in words])
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def quarantined(df: DataFrame, problems: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of their problems)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in problems.items()]))
    marked = df.withColumn("problems", found)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def stratified_split(df: DataFrame, strata: list[str], order: list[Column], shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """``split``: the first floor(n * 0.8) rows of each stratum train, the next floor(n * 0.1) validate, the rest test.

    Rows of an unknown stratum (null) are left out. Ranks come from running counts over ranges of rows, so no task sorts a
    stratum.
    """
    names = [f"_o{i}" for i in range(len(order))]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in strata])
    rows = df.where(known).withColumns(dict(zip(names, order, strict=True))).withColumn("_one", F.lit(1))
    counts = df.where(known).groupBy(*strata).agg(F.count("*").alias("_size"))  # a row for each stratum
    ranked = running(rows, strata, names, "_one", "_rank").join(F.broadcast(counts), strata)
    train, validation = (F.floor(F.col("_size") * s) for s in shares)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def stratified_quota(df: DataFrame, strata: str, level: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """At most a quota of rows of each level in each stratum, ranked within partitions before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(strata, level).orderBy(*order))
    limit = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(level)]
    most = max(quotas.values(), default=0)
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).where(F.col("_rank") <= F.coalesce(limit, F.lit(0))).drop("_rank")


def sampled(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
