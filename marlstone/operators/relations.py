"""Joins between records: dimensions, variants, nearest matches, member edges, text containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_dimensions(facts: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of (dimension, fact key, dimension key), one after the other; Spark broadcasts those that are small."""
    for dimension, left, right in dimensions:
        facts = facts.join(dimension, F.col(left) == F.col(right), "left")
    return facts


def newest_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; ranked within partitions before rows are shuffled."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def variants(df: DataFrame, group: str, key: str, order: list[Column], n: int = 10) -> DataFrame:
    """For each row the first n others of its group: (key, other).

    Of a group only the first n + 1 rows can be anyone's, so they alone are joined, not the group with itself.
    """
    firsts = newest_per_key(df.select(group, key, *[c.alias(f"_o{i}") for i, c in enumerate(order)]), group, [F.col(f"_o{i}") for i in range(len(order))], n + 1)
    pairs = df.select(group, key).join(firsts.withColumnRenamed(key, "other"), group).where(F.col(key) != F.col("other"))
    return newest_per_key(pairs, key, [F.col(f"_o{i}") for i in range(len(order))], n).select(key, "other")


def nearest(left: DataFrame, right: DataFrame, group: str, a: str, b: str, key: str, tie: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` in its group with the nearest value (columns a and b), smaller tie first.

    Both sides go into one ordered list per group, sorted once, and look to the nearest right value below and above: no
    pair is formed.
    """
    up = Window.partitionBy(group).orderBy("_v", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(group).orderBy("_v", "_side", "_tie").rowsBetween(0, Window.unboundedFollowing)
    # Of equal values the smallest tie must win in either direction, so right rows are cut to one for each value.
    firsts = right.groupBy(group, F.col(b).alias("_v")).agg(F.min(tie).alias("_tie"))
    rows = left.select(group, F.col(a).alias("_v"), F.col(key).alias("_key"), F.lit(None).cast(firsts.schema["_tie"].dataType).alias("_tie"), F.lit(1).alias("_side"))
    both = rows.unionByName(firsts.select(group, "_v", F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"), "_tie", F.lit(0).alias("_side")))
    here = F.when(F.col("_side") == 0, F.struct("_v", "_tie"))
    seen = both.withColumn("_below", F.last(here, ignorenulls=True).over(up)).withColumn("_above", F.first(here, ignorenulls=True).over(down)).where("_side = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._v") - F.col("_v")).alias("distance"), F.col(f"{c}._tie").alias("tie")))
    best = F.array_min(F.array_compact(F.array(far("_below"), far("_above"))))
    return seen.select(group, F.col("_key").alias(key), F.col("_v").alias(a), best["tie"].alias("nearest"), best["distance"].alias("distance"))


#: Rows of one key that meet in a task.
CELL = 8192


def in_cells(left: DataFrame, right: DataFrame, key: str, own: str, other: str, most: int = CELL) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``key``, and the columns to join them on, so that all pairs of a common key are made by many
    tasks: the rows of a key are dealt to parts of about ``most`` by a hash of ``own`` (``other``), and each part of one side
    goes to a cell with each of the other. Keys with fewer rows have one cell."""
    parts = lambda df, out: df.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    # One row for each ``most`` rows at most, so they go to every task.
    large = F.broadcast(parts(left, "_lefts").join(parts(right, "_rights"), key).where("_lefts > 1 or _rights > 1"))

    def dealt(df: DataFrame, by: str, mine: str, theirs: str, cell: str, copy: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        met = df.join(large, key, "left").withColumn(cell, F.pmod(F.xxhash64(by), n(mine)).cast("int"))
        return met.withColumn(copy, F.explode(F.sequence(F.lit(0), n(theirs) - 1))).drop("_lefts", "_rights")

    return dealt(left, own, "_lefts", "_rights", "_l", "_r"), dealt(right, other, "_rights", "_lefts", "_r", "_l"), [key, "_l", "_r"]


def pairs(left: DataFrame, right: DataFrame, key: str, own: str, other: str, where: Column, most: int = CELL) -> DataFrame:
    """(own, other) of rows of two tables with a common ``key`` for which ``where`` holds, which reads their other columns;
    none with itself. Made in cells, in which rows of ``right`` that are alike but for ``other`` stand as one list, so that
    ``where`` is asked once for all of them."""
    mine, theirs, on = in_cells(left, right, key, own, other, most)
    alike = [c for c in right.columns if c not in (key, other)]
    lists = theirs.groupBy(*on, *alike).agg(F.collect_list(other).alias("_others"))  # as many as a part has rows at most
    met = mine.join(lists.hint("merge"), on).where(where)
    return met.select(own, F.explode("_others").alias(other)).where(F.col(own) != F.col(other))


def member_edges(df: DataFrame, key: str, members: Column, names: DataFrame, name: str, other: str) -> DataFrame:
    """(key, other) where a member of a row's list is the name of another row; each pair once, without itself.

    A pair is made at the smallest member that is a name of the other one, so pairs are never compared with each other nor
    shuffled: each entry of a list carries the smaller ones.
    """

    def entries(rows: DataFrame, by: str, out: str, before: str) -> DataFrame:
        lists = rows.where(F.col(by).isNotNull() & F.col("_member").isNotNull()).groupBy(by).agg(F.array_sort(F.collect_set("_member")).alias("_all"))
        placed = lists.select(F.col(by).alias(out), "_all", F.posexplode("_all").alias("_at", "_member"))
        return placed.select(out, "_member", F.slice("_all", F.lit(1), F.col("_at")).alias(before))

    edges = entries(df.select(F.col(key), F.explode(members).alias("_member")), key, "_key", "_before")
    named = entries(names.select(F.col(other).alias("_o"), F.col(name).alias("_member")), "_o", "other", "_names")
    first = (F.size("_before") == 0) | (F.size("_names") == 0) | ~F.arrays_overlap("_before", "_names")
    return pairs(edges, named, "_member", "_key", "other", first).select(F.col("_key").alias(key), "other")


def member_counts(df: DataFrame, key: str, members: Column, names: DataFrame, name: str, other: str) -> DataFrame:
    """key, n, total: how many others a member of a row's list names, and the sum of their (numeric) keys, without itself.

    Names are counted before they are joined, so a common name costs one row and pairs are never formed.
    """
    named = names.groupBy(F.col(name).alias("_member")).agg(F.count("*").alias("_n"), F.sum(other).alias("_sum"))
    own = names.select(F.col(other).alias(key), F.col(name).alias("_member"), F.lit(1).alias("_own"))
    edges = df.select(key, F.explode(members).alias("_member")).distinct()
    met = edges.join(named, "_member").join(own, [key, "_member"], "left")
    less = F.coalesce("_own", F.lit(0))
    return met.groupBy(key).agg(F.sum(F.col("_n") - less).alias("n"), F.sum(F.col("_sum") - less * F.col(key)).alias("total")).where("n > 0")


def containing(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """(needle_key, key) where the text holds the needle, ignoring case. Null and empty needles are in no text.

    Texts that hold a needle hold its inner words as whole ones, and its others within words. Texts are exploded to keys and
    distinct words, joined on the longest inner word of each needle, or else on all words of the texts around its longest
    one, found by a gram of up to three characters; needles without a word are joined on their first character. Only the
    texts of those pairs are tested for the whole needle.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    own = words(F.col(needle))
    inner = F.slice(own, F.lit(2), F.greatest(F.lit(0), F.size(own) - 2))
    wanted = needles.where(F.col(needle) != "").select(needle_key, F.lower(needle).alias("_needle"), longest(inner).alias("_word"), longest(own).alias("_part"))
    keyed = texts.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("_word"))
    grams = lambda w: F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, n)))))
    around = keyed.select("_word").distinct().select("_word", F.explode(grams(F.col("_word"))).alias("_gram"))
    partly = wanted.where("_word is null and _part is not null").drop("_word").withColumn("_gram", F.substring("_part", 1, 3))
    found = partly.join(around, "_gram").where(F.contains("_word", F.col("_part")))
    routed = wanted.where("_word is not null").drop("_part").unionByName(found.drop("_gram", "_part"))
    signs = texts.select(key, F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[\p{L}\p{N}]+", ""), ""))).alias("_sign"))
    wordless = wanted.where("_part is null").drop("_word", "_part").withColumn("_sign", F.substring("_needle", 1, 1))
    met = keyed.join(routed, "_word").drop("_word").unionByName(signs.join(wordless, "_sign").drop("_sign"))
    rows = met.join(texts.select(key, F.lower(text).alias("_text")), key).where(F.contains("_text", F.col("_needle")))
    return rows.select(needle_key, key).distinct()


def not_yet(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not known."""
    return new.join(known.select(keys).distinct(), keys, "left_anti")
