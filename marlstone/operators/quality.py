"""Quality of predictions: accuracy with the right denominators, error tallies, timing, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.summaries import rates

#: Advice by thresholds: measure, the least values of better grades, and the grades from worst to best.
SUCCESS_STEPS, TIME_STEPS = (80.0, 90.0), (800.0, 1000.0)


def _share(hits: Column, n: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(hits, n), F.lit(0.0)), 6)


def parsed(column: Column) -> Column:
    """Parsed JSON objects; null for other texts and for empty objects."""
    v = F.try_parse_json(column)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")) & (F.regexp_replace(column, r"\s", "") != "{}"), v)


def field_of(json: Column, field: str) -> Column:
    """The field as text: a text is itself, others their JSON; null for null."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant")
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def exact_match(predicted: Column, truth: Column, fields: list[str]) -> Column:
    """Every field that both sides have is equal; so nothing in common is a match."""
    pairs = [field_of(predicted, f) == field_of(truth, f) for f in fields]
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(True)) for p in pairs])


def _judged(rows: DataFrame, predicted: str, truth: str, fields: list[str]) -> DataFrame:
    p, t = F.col(predicted), F.col(truth)
    return rows.where(parsed(t).isNotNull()).withColumn("_read", parsed(p).isNotNull()).withColumn("_exact", F.col("_read") & exact_match(p, t, fields))


def exact_accuracy(rows: DataFrame, predicted: str, truth: str, fields: list[str]) -> DataFrame:
    """One row: of the rows with a readable truth those that match; unreadable predictions count as misses."""
    return _judged(rows, predicted, truth, fields).agg(F.count("*").alias("n"), F.count_if("_exact").alias("n_exact")).withColumn("accuracy", _share(F.col("n_exact"), F.col("n")))


def language_accuracy(rows: DataFrame, predicted: str, truth: str, fields: list[str], language: str) -> DataFrame:
    """By language, of the rows with a readable truth and prediction."""
    own = _judged(rows, predicted, truth, fields).where("_read")
    return own.groupBy(F.coalesce(language, F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"), F.count_if("_exact").alias("n_exact")).withColumn("accuracy", _share(F.col("n_exact"), F.col("n")))


def fields_accuracy(rows: DataFrame, predicted: str, truth: str, fields: list[str]) -> DataFrame:
    """By field, of the rows where both sides can be read and have it; a field nobody has counts 0 of 0."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (field_of(F.col(predicted), f) == field_of(F.col(truth), f)).alias("ok")) for f in fields]))
    found = _judged(rows, predicted, truth, fields).where("_read").select(pairs.alias("x")).select("x.*")
    return found.groupBy("field").agg(F.count("ok").alias("n"), F.count_if("ok").alias("n_equal")).withColumn("accuracy", _share(F.col("n_equal"), F.col("n")))


def success_rates(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: shares, in per cent of all rows, of readable predictions and of rows where both sides can be read."""
    p, t = parsed(F.col(predicted)).isNotNull(), parsed(F.col(truth)).isNotNull()
    return rates(rows, [], {"predicted": p, "both": p & t})


def errors(rows: DataFrame, predicted: str, success: Column, fields: list[str]) -> DataFrame:
    """kind, n: rows without success, and of the others those that don't name a field; every kind has a row."""
    ok = F.coalesce(success, F.lit(False))
    lacks = [F.count_if(ok & ~F.contains(F.coalesce(predicted, F.lit("")), F.lit(f'"{f}"'))) for f in fields]
    counts = rows.agg(F.count_if(~ok).alias("json_parse_error"), *[c.alias(f"missing_{f}") for c, f in zip(lacks, fields, strict=True)])
    return counts.unpivot([], counts.columns, "kind", "n")


def by_class(rows: DataFrame, name: str, correct: Column, seconds: Column) -> DataFrame:
    """n, n_correct and mean time of each class."""
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.round(F.avg(seconds), 6).alias("mean_seconds"))


def advice(summary: DataFrame) -> DataFrame:
    """Grades of a summary row (success_pct, mean_ms, name_pct, hp_pct, attacks_pct): what to do by measure."""
    low, high = SUCCESS_STEPS
    fast, slow = TIME_STEPS
    success = F.when(F.col("success_pct") < low, "more samples").when(F.col("success_pct") < high, "more rounds").otherwise("ready")
    time = F.when(F.col("mean_ms") > slow, "smaller batches").when(F.col("mean_ms") > fast, "cheaper images").otherwise("fast")
    check = lambda c, least, what: F.when(F.coalesce(F.col(c), F.lit(0.0)) < least, what)
    return summary.select(success.alias("success"), time.alias("time"), F.array_compact(F.array(check("name_pct", 90, "names"), check("hp_pct", 90, "hp"), check("attacks_pct", 80, "attacks"))).alias("weak"))


def two_stages(rows: DataFrame, image: str, read: Column) -> DataFrame:
    """One row over detections: images, images with several cards, cards, and cards that were read."""
    per = rows.groupBy(image).agg(F.count("*").alias("n"), F.count_if(F.coalesce(read, F.lit(False))).alias("n_read"))
    return per.agg(F.count("*").alias("n_images"), F.count_if(F.col("n") > 1).alias("n_multi"), F.sum("n").alias("n_cards"), F.sum("n_read").alias("n_read"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """section, item, value of small aggregates in one table: each part has an item column and a number."""
    rows = [df.select(F.lit(name).alias("section"), F.col(df.columns[0]).cast("string").alias("item"), F.col(df.columns[1]).cast("double").alias("value")) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def hit_rate(rows: DataFrame, hit: Column) -> DataFrame:
    """n, hits, misses and the share of hits in per cent, 0 of nothing."""
    return rows.agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), F.count_if(~hit).alias("n_miss")).withColumn("pct_hit", F.round(F.coalesce(100.0 * F.try_divide(F.col("n_hit"), F.col("n")), F.lit(0.0)), 6))


def id_range(rows: DataFrame, column: str, most: int = 10) -> DataFrame:
    """One row: least and largest numeric id of a text column, and the first and last ``most`` of them; others are left out."""
    ids = rows.select(F.regexp_replace(column, r"\D", "").try_cast("long").alias("id")).where("id is not null").distinct()
    first, last = ids.orderBy("id").limit(most), ids.orderBy(F.desc("id")).limit(most)
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list("id")).alias(name))  # noqa: E731 - of at most ``most`` ids
    return ids.agg(F.min("id").alias("least"), F.max("id").alias("most")).crossJoin(listed(first, "first")).crossJoin(listed(last, "last"))  # one row each
