"""Imports of card records: normalising, dimensions, upserts, repairs. Set-based: every step is a join or a projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import codes
from marlstone.functions.scalars import collector_number, leading_int, mapped
from marlstone.operators.records import latest, quarantined, upsert
from marlstone.operators.search import patterns

# Codes of products by the label of a shop.
PRODUCT_LABELS = {
    "拡張パック": "expansion_pack", "強化拡張パック": "enhanced_expansion", "入門セット": "starter_set", "構築デッキ": "constructed_deck", "周辺グッズ": "accessories", "その他の商品": "special_products", "デッキ": "deck",
    "Expansion Pack": "expansion_pack", "Enhanced Expansion Pack": "enhanced_expansion", "Starter Set": "starter_set", "Constructed Deck": "constructed_deck", "Accessories": "accessories", "Special Products": "special_products", "Deck": "deck",
}
# Labels of products by texts in their titles, and texts that speak against them; the first rule counts.
PRODUCT_RULES = [
    ("拡張パック", ["擴充包"], []),
    ("拡張パック", ["Scarlet & Violet", "Sword & Shield", "Sun & Moon", "Mega Evolution"], ["Basic Energy", "Promo", "151", "Celebrations", "Pokémon GO"]),
    ("強化拡張パック", ["強化擴充包", "高級擴充包"], []),
    ("スターターセット", ["初階牌組", "挑戰牌組", "スターター", "スタートデッキ", "起始組合", "V起始牌組", "G超起始牌組"], []),
    ("構築デッキ", ["構築デッキ", "デッキ", "牌組構築BOX", "戰術牌組", "VSTAR&VMAX 高級牌組"], []),
    ("周辺グッズ", ["周辺グッズ", "デッキケース", "デッキシールド", "カードボックス", "Basic Energy"], []),
    ("その他の商品", ["スペシャルカード", "その他の商品", "特別組合", "特典", "Trianers Camp", "特別牌組組合", "頂級訓練家收藏箱", "V-UNION", "寶可夢卡牌家庭組合", "Promo", "151", "Celebrations", "Pokémon GO"], []),
]


def signature(abilities: Column, attacks: Column, form: str = "object") -> Column:
    """Content signature of JSON texts as they are, missing ones as []: of one object with both ('object') or of the two
    with a bar between ('bar'). The forms never agree, so one store keeps to one of them."""
    a, b = (F.coalesce(c, F.lit("[]")) for c in (abilities, attacks))
    text = F.concat(a, F.lit("|"), b) if form == "bar" else F.concat(F.lit('{"abilities":'), a, F.lit(',"attacks":'), b, F.lit("}"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def _or_null(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def normalised(raw: DataFrame, form: str = "service") -> DataFrame:
    """Raw records with their codes translated.

    'service' keeps the first type only, takes no subtype codes but translated ones and no placeholder for a missing
    number; 'direct' keeps all types and subtypes, takes the number from the id if need be, reads language and region, and
    puts a trainer's effect into its abilities, with no text left.
    """
    direct = form == "direct"
    kind = codes.supertype(F.col("supertype"))
    number = collector_number(F.col("collectorNumber"), _or_null("cardNumber"), F.col("webCardId") if direct else F.lit(""))
    effect = F.coalesce(_or_null("effectText"), _or_null("text"))
    folded = F.lit(direct) & (kind == "TRAINER") & _or_null("effectText").isNotNull()
    told = F.to_json(F.array(F.struct(F.lit("ABILITY").alias("type"), F.lit("").alias("name"), F.col("effectText").alias("text"))))
    members = F.col("subtypes") if not direct else F.coalesce("subtypes", F.when(_or_null("subtype").isNotNull(), F.array("subtype")))
    region = codes.region(F.col("region")) if direct else F.lit("JP")
    return raw.select(
        "webCardId",
        "name",
        kind.alias("supertype"),
        codes.subtypes(members, strict=not direct).alias("subtypes"),
        codes.types(F.coalesce("pokemonTypes", "types"), first_only=not direct).alias("types"),
        codes.stage(F.col("evolutionStage"), kind).alias("evolutionStage"),
        codes.rule_box(F.col("ruleBox")).alias("ruleBox"),
        codes.rarity(F.col("rarity")).alias("rarity"),
        codes.variant(F.col("variantType")).alias("variantType"),
        leading_int(F.col("hp")).alias("hp"),
        F.when(F.coalesce(folded, F.lit(False)), told).otherwise(F.col("abilities")).alias("abilities"),
        "attacks",
        F.when(F.coalesce(folded, F.lit(False)), F.lit(None)).otherwise(effect).alias("text"),
        effect.alias("updated_text"),
        number.alias("cardNumber"),
        F.lower("expansionCode").alias("code"),
        F.upper("expansionCode").alias("primary_code"),
        region.alias("region"),
        (codes.import_language(F.col("language")) if direct else F.lit("JA_JP")).alias("language"),
        signature(F.col("abilities"), F.col("attacks"), "bar" if direct else "object").alias("skillsSignature"),
    )


def checked(cards: DataFrame, need_number: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) normalised cards; bad rows say why: ids, names and expansions are required, and a type of those that
    have types."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    problems = {c: missing(c) for c in ("webCardId", "name", "code")} | {"types": (F.col("supertype") == "POKEMON") & (F.size("types") == 0)}
    if need_number:
        problems["cardNumber"] = F.col("cardNumber").isNull()
    return quarantined(cards, problems)


def without_placeholder(cards: DataFrame, name: str = codes.PLACEHOLDER) -> DataFrame:
    return cards.where(F.col("name").isNull() | (F.col("name") != name))


def outcomes(raw: DataFrame, good: DataFrame, bad: DataFrame, name: str = codes.PLACEHOLDER) -> DataFrame:
    """success, failed, skipped rows of an import, and their share that succeeded, as one row."""
    counts = good.select(F.lit("success").alias("o")).unionByName(bad.select(F.lit("failed").alias("o"))).unionByName(raw.where(F.col("name") == name).select(F.lit("skipped").alias("o")))
    out = counts.agg(*[F.count_if(F.col("o") == k).alias(k) for k in ("success", "failed", "skipped")])
    return out.withColumn("pct", F.round(F.coalesce(100.0 * F.try_divide(F.col("success"), F.col("success") + F.col("failed")), F.lit(0.0)), 6))


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, unchanged, and the wanted ones whose key is not there, one for each key."""
    return existing.unionByName(wanted.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti"), allowMissingColumns=True)


def expansions_of(cards: DataFrame, primaries: DataFrame, regionals: DataFrame, title: str = "Set ") -> tuple[DataFrame, DataFrame]:
    """Primary and regional expansions after all codes of the cards have been met; new ones have placeholder names."""
    met = cards.select("code", "primary_code", "region").where("code is not null").distinct()
    primary = met.select(F.col("primary_code").alias("code"), F.concat(F.lit(title), "primary_code").alias("nameEn"))
    regional = met.select("code", "region", F.concat("primary_code", F.lit(" ("), "region", F.lit(")")).alias("name"), F.col("primary_code").alias("primaryExpansion"))
    return get_or_create(primaries, primary, ["code"]), get_or_create(regionals, regional, ["primaryExpansion", "region"])


def primary_cards(existing: DataFrame, cards: DataFrame) -> DataFrame:
    """Primary cards by (name, signature): a card that comes again brings its expansion and number."""
    keys = ["name", "skillsSignature"]
    last = latest(cards, keys, [F.desc("webCardId")]).select(*keys, F.col("primary_code").alias("primaryExpansion"), "cardNumber")
    return upsert(existing, last, keys, {"primaryExpansion": "new", "cardNumber": "new"})


def card_upsert(existing: DataFrame, cards: DataFrame, form: str = "service") -> DataFrame:
    """Cards by web id. 'service' never moves a card to another primary card, 'direct' does; neither changes language."""
    kept = ["language"] + (["skillsSignature"] if form == "service" else [])
    columns = [c for c in existing.columns if c != "webCardId"]
    new = latest(cards, ["webCardId"], [F.desc("name")]).select("webCardId", *columns)
    return upsert(existing, new, ["webCardId"], {c: "keep" if c in kept else "new" for c in columns})


def sparse_update(rows: DataFrame, patches: DataFrame, key: str, given: str = "given") -> DataFrame:
    """Rows with the patched values of the columns named in ``given`` (an array), also where these are null."""
    columns = [c for c in patches.columns if c not in (key, given)]
    p = patches.select(key, F.col(given).alias("_given"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = rows.join(p, key, "left")
    has = lambda c: F.coalesce(F.array_contains("_given", c), F.lit(False))
    return out.select(*[F.when(has(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def evolution_update(rows: DataFrame, patches: DataFrame, key: str = "webCardId") -> DataFrame:
    """Both ends of the evolution are replaced wherever a patch names the card; empty text means none."""
    ends = ("evolvesFrom", "evolvesTo")
    p = patches.select(key, F.lit(True).alias("_there"), *[_or_null(c).alias(f"_new_{c}") for c in ends])
    out = rows.join(p, key, "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in ends else F.col(c) for c in rows.columns])


def merged(rows: DataFrame, extracted: DataFrame, key: str, strategy: str = "merge") -> DataFrame:
    """'merge' takes values that are not null, 'overwrite' takes all, of rows that are there; nothing is inserted."""
    columns = [c for c in extracted.columns if c != key]
    e = extracted.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = rows.join(e, key, "left")
    new = (lambda c: F.coalesce(f"_new_{c}", c)) if strategy == "merge" else (lambda c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.select(*[new(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def from_extraction(extracted: DataFrame, primaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, primary cards) of extraction results. Ids that are missing come from a hash of the content, so a repeated
    run makes the same ones; the number belongs to the primary card; known primary cards stay as they are."""
    sig = signature(F.col("abilities"), F.col("attacks"))
    made = F.concat(F.lit("vl_"), F.substring(F.sha2(F.concat_ws("|", "name", "locale", sig), 256), 1, 12))
    rows = extracted.withColumn("skillsSignature", sig).withColumn("webCardId", F.coalesce(_or_null("webCardId"), made))
    known = get_or_create(primaries, rows.select("name", "skillsSignature", "cardNumber"), ["name", "skillsSignature"])
    none = F.array().cast("array<string>")
    cards = rows.select("webCardId", codes.language(F.col("locale")).alias("language"), "name", "supertype", F.coalesce("types", none).alias("types"), F.nullif("hp", F.lit(0)).alias("hp"), "abilities", "attacks", "skillsSignature", F.lit("NORMAL").alias("variantType"))
    return cards, known


def updated_where(rows: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where the condition holds; null conditions don't."""
    hit = F.coalesce(which, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """(what is left, the number of rows that went as one row): a caller that expects one finds none."""
    hit = F.coalesce(which, F.lit(False))
    return rows.where(~hit), rows.agg(F.count_if(hit).alias("deleted"))


def needing_repair(cards: DataFrame) -> DataFrame:
    """Cards without supertype, or with types missing where they must have one (null lists don't count as empty)."""
    return cards.where(F.col("supertype").isNull() | ((F.col("supertype") == "POKEMON") & (F.size("types") == 0)))


def exportable(cards: DataFrame) -> DataFrame:
    """Cards with a name, and with hp if they are of the supertype that has it."""
    return cards.where((F.col("name") != "") & ((F.col("supertype") != "POKEMON") | F.col("hp").isNotNull()))


def repaired(rows: DataFrame, source: DataFrame, key: str, fill: list[str], always: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): missing values of ``fill`` come from the source, those of ``always`` do wherever the source has
    one; counts are rows, rows found in the source, and rows not found."""
    s = source.dropDuplicates([key]).select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_src_{c}") for c in [*fill, *always]])
    met = rows.join(s, key, "left")
    new = {c: F.coalesce(c, f"_src_{c}") for c in fill} | {c: F.coalesce(f"_src_{c}", c) for c in always}
    counts = met.agg(F.count("*").alias("n"), F.count_if(F.col("_there")).alias("n_found"), F.count_if(F.col("_there").isNull()).alias("n_missing"))
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns]), counts


def refreshed(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns taken from the source wherever it knows the key, and whether it did (``found``)."""
    s = source.dropDuplicates([key]).select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_src_{c}") for c in columns])
    met = rows.join(s, key, "left")
    return met.select(*[F.when(F.col("_there"), F.col(f"_src_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], F.coalesce("_there", F.lit(False)).alias("found"))


def product_edit(products: DataFrame, edits: DataFrame, kinds: DataFrame) -> DataFrame:
    """Products with the edited name, note and kind: a kind is a code of ``kinds`` (code, kind_id); an unknown code leaves
    the product's kind. Columns that an edit leaves null stay."""
    e = edits.join(kinds.withColumnRenamed("code", "kind_code"), "kind_code", "left").select("id", F.col("name").alias("_name"), F.col("note").alias("_note"), F.col("kind_id").alias("_kind"))
    out = products.join(e, "id", "left")
    return out.select("id", F.coalesce("_name", "name").alias("name"), F.coalesce("_note", "note").alias("note"), F.coalesce("_kind", "kind_id").alias("kind_id"))


def product_kind(label: Column) -> Column:
    return mapped(label, PRODUCT_LABELS, sorted(set(PRODUCT_LABELS.values())))


def product_label(title: Column, label: Column) -> Column:
    """The label by the first rule that a title meets, where it has none yet."""
    out = label
    for name, include, exclude in PRODUCT_RULES:
        out = F.coalesce(out, F.when(patterns(title, include, exclude), name))
    return out


def reparsed(logs: DataFrame, parsed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Logs with all derived columns taken from a new reading of their text."""
    return logs.drop(*columns).join(parsed.select(key, *columns), key, "left")


def detected(images: DataFrame, boxes: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row for each detected box with its result, null where none came; an image without boxes gives no row.

    Results are as many as boxes, or more, so they are never sent to the driver and every task, however small the files
    that they were made from.
    """
    found = images.join(boxes, key).withColumn("box", F.row_number().over(Window.partitionBy(key).orderBy("top", "left")))
    return found.join(results.hint("merge"), [key, "box"], "left")


def per_file(rows: DataFrame, file: str, problems: Column) -> DataFrame:
    """n, n_good, n_bad of each file."""
    bad = F.coalesce(problems, F.lit(False))
    return rows.groupBy(file).agg(F.count("*").alias("n"), F.count_if(~bad).alias("n_good"), F.count_if(bad).alias("n_bad"))


def in_batches(rows: DataFrame, order: list[str], size: int, failing: Column) -> DataFrame:
    """Rows in batches of ``size`` in this order, with the batch's number and outcome: a batch with a failing row fails as
    a whole, as one transaction does."""
    numbered = rows.withColumn("_key", F.struct(*order))
    # Places by range partitions and offsets: no task sorts everything.
    # Kept, as ranges that were drawn anew for either use might differ.
    dealt = numbered.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_part", F.spark_partition_id()).persist()
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("_key"))).join(F.broadcast(offsets), "_part")
    batch = F.floor((F.col("_before") + F.col("_at") - 1) / size).cast("long")
    rows = placed.withColumn("batch", batch).drop("_key", "_part", "_before", "_at")
    failed = F.max(F.coalesce(failing, F.lit(False))).over(Window.partitionBy("batch"))
    return rows.withColumn("outcome", F.when(failed, "failed").otherwise("success"))


def attempted(rows: DataFrame, f, schema: str, at_once: int = 1) -> DataFrame:
    """``f`` on every row (a dict) where the rows lie; what it raises becomes the row's ``error``, and no other row fails.
    A task has up to ``at_once`` calls running, and gives results in the order of its rows."""
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def one(row: dict) -> dict:
        try:
            return {**row, **dict.fromkeys(names), **f(row), "error": None}
        except Exception as e:  # noqa: BLE001 - the error is the result
            return {**row, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}

    columns = [c for c in rows.columns if c not in [*names, "error"]]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields if x.name in columns)

    def run(parts):
        with ThreadPoolExecutor(at_once) as pool:
            for p in parts:
                yield pd.DataFrame(pool.map(one, p.to_dict("records")), columns=[*columns, *names, "error"])

    return rows.select(columns).mapInPandas(run, f"{fields}, {schema}, error string")


def all_required(columns: list[str]) -> Column:
    """None of the columns is null or empty."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns])
