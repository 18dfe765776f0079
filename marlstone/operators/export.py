"""Training sets from records: balanced samples, two-message samples, bundles, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import codes
from marlstone.functions.scalars import lit_map

SHARES = {"simple": 0.4, "medium": 0.4, "complex": 0.2}
#: Instructions by language; those of the last one are for all others.
PROMPTS = {
    "JA_JP": "このカードの情報をすべて JSON で書き出してください。",
    "ZH_TW": "請以 JSON 寫出這張卡牌的所有資訊。",
    "EN_US": "Write out everything on this card as JSON.",
}


def has_image(found: Column, *urls: Column) -> Column:
    """A file that was found, or any address."""
    out = F.coalesce(found, F.lit(False))
    for url in urls:
        out = out | F.coalesce(url != "", F.lit(False))
    return out


def balanced(cards: DataFrame, others: DataFrame, target: int, order: list[Column], key: str = "id", languages: list[str] = codes.LANGUAGES, shares: dict[str, float] = SHARES) -> DataFrame:
    """key, language, part of a sample of at most ``target`` rows.

    Every language gets the same number: floors of its shares by complexity ('quota'), then any others of it ('refill');
    what is missing in all comes evenly from ``others`` ('extra'). Rows are taken in the given order, which makes the sample
    repeatable; ranks are cut before rows are shuffled.
    """
    per = target // len(languages)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    quota = F.create_map(*[F.lit(x) for k, s in shares.items() for x in (k, int(per * s))])[F.col("complexity")]
    known = cards.where(F.col("language").isin(languages))
    first = known.withColumn("_n", rank("language", "complexity")).where(F.col("_n") <= F.coalesce(quota, F.lit(0))).drop("_n")
    left = known.join(first.select(key), key, "left_anti")
    have = first.groupBy("language").agg(F.count("*").alias("_have"))  # a row for each language
    more = left.withColumn("_n", rank("language")).where(F.col("_n") <= per).join(F.broadcast(have), "language", "left").where(F.col("_n") <= per - F.coalesce("_have", F.lit(0)))
    out = first.select(key, "language", F.lit("quota").alias("part"), F.lit(0).alias("_o")).unionByName(more.select(key, "language", F.lit("refill").alias("part"), F.lit(1).alias("_o")))
    missing = out.agg(F.floor((F.lit(target) - F.count("*")) / len(languages)).alias("_missing"))  # one row
    extra = others.where(F.col("language").isin(languages)).withColumn("_n", rank("language")).where(F.col("_n") <= target).join(F.broadcast(missing), F.col("_n") <= F.col("_missing"))
    return out.unionByName(extra.select(key, "language", F.lit("extra").alias("part"), F.lit(2).alias("_o"))).orderBy("_o", "language", key).limit(target).drop("_o")


def sample_of(image: Column, language: Column, answer: Column, metadata: Column) -> Column:
    """A sample as two messages: image and instruction, then the answer as JSON text (nulls left out)."""
    prompt = F.coalesce(F.element_at(lit_map(PROMPTS), language), F.lit(PROMPTS["EN_US"]))
    part = lambda kind, image, text: F.struct(F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text"))
    none = F.lit(None)
    return F.struct(
        F.array(
            F.struct(F.lit("user").alias("role"), F.array(part("image", image, none), part("text", none, prompt)).alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.array(part("text", none, answer)).alias("content")),
        ).alias("messages"),
        metadata.alias("metadata"),
    )


def samples(cards: DataFrame, image: Column) -> DataFrame:
    """One sample for each card that has an image: ``image``, ``sample`` and ``done`` (false where there is none)."""
    size = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(F.col(c)), "$", "array<variant>"), F.array().cast("array<variant>"))
    fields = ["name", "hp", "types", "subtypes", "supertype", "rarity", "artist", "evolutionStage", "evolvesTo", "regulationMark", "webCardId"]
    own = [c for c in fields if c in cards.columns]
    answer = F.to_json(F.struct(*own, F.get("types", F.lit(0)).alias("type"), F.get("subtypes", F.lit(0)).alias("subtype"), codes.locale(F.col("language")).alias("language")))
    about = F.struct("webCardId", codes.locale(F.col("language")).alias("language"), (F.size(size("abilities")) > 0).alias("hasAbilities"), (F.size(size("attacks")) > 0).alias("hasAttacks"), "supertype", "complexity", image.alias("imagePath"))
    rows = cards.withColumn("image", image)
    return rows.select("id", "image", F.when(F.col("image") != "", sample_of(F.col("image"), F.col("language"), answer, about)).alias("sample"), F.coalesce(F.col("image") != "", F.lit(False)).alias("done"))


def read_sample(messages: Column) -> Column:
    """image, prompt and answer of a sample's messages; of several the last one counts."""
    parts = lambda role: F.flatten(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]))
    last = lambda role, kind, field: F.try_element_at(F.filter(F.transform(F.filter(parts(role), lambda p: p["type"] == kind), lambda p: p[field]), lambda x: x.isNotNull()), F.lit(-1))
    return F.struct(last("user", "image", "image").alias("image"), last("user", "text", "text").alias("prompt"), last("assistant", "text", "text").alias("answer"))


def write_samples(rows: DataFrame, path: str) -> None:
    """The samples as JSON lines, one folder for each split."""
    rows.where("done").select("split", "sample.*").write.partitionBy("split").mode("overwrite").json(path)


def export_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("done").alias("n_written"), F.count_if(~F.col("done")).alias("n_failed"))


def shortened(column: Column, most: int = 500) -> Column:
    return F.substring(column, 1, most)


def missing_fields(rows: DataFrame, json: str, required: list[str]) -> DataFrame:
    """field, n of required fields that JSON texts lack, most often missing first; texts that don't parse lack all."""
    value = lambda f: F.try_variant_get(F.try_parse_json(json), f"$.{f}", "variant")
    lacking = F.array(*[F.when(value(f).isNull() | F.is_variant_null(value(f)), F.lit(f)) for f in required])
    return rows.select(F.explode(F.array_compact(lacking)).alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """least, most and mean of each column, as one row."""
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max), ("mean", lambda x: F.round(F.avg(x), 6)))])


def verdict(rows: DataFrame, sound: Column, has_file: Column, least: int = 1000, missing: float = 0.1) -> DataFrame:
    """One row: n, n_invalid, n_missing and whether each is critical; passed if none is."""
    counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("n_invalid"), F.count_if(~F.coalesce(has_file, F.lit(False))).alias("n_missing"))
    few, invalid, lost = F.col("n") < least, F.col("n_invalid") > 0, F.col("n_missing") > F.col("n") * missing
    return counts.select("*", few.alias("too_few"), invalid.alias("has_invalid"), lost.alias("too_many_missing"), (~few & ~invalid & ~lost).alias("passed"))


def across_splits(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split, and in how many."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")
