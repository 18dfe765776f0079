"""Import and repair queries over raw records made from the ``part`` and ``orders`` tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import codes
from marlstone.operators import imports
from marlstone.plans.catalog import _t, query


def _raw(array) -> dict[str, str]:
    """Columns of a raw record; ``array`` writes a list of string expressions in either dialect."""
    return {
        "webCardId": "case when p_partkey % 37 = 0 then '' else concat('jp', cast(p_partkey as string)) end",
        "name": "case when p_partkey % 41 = 0 then 'カード検索' else p_name end",
        "supertype": "case p_partkey % 6 when 0 then 'ポケモン' when 1 then 'POKEMON' when 2 then 'トレーナーズ' when 3 then 'ENERGY' when 4 then 'bogus' else null end",
        "subtypes": f"case p_partkey % 4 when 0 then {array(['グッズ', 'TERA', 'what'])} when 1 then {array(['スタジアム'])} else null end",
        "subtype": "case when p_partkey % 4 = 2 then 'サポート' else null end",
        "pokemonTypes": f"case p_partkey % 5 when 0 then {array(['炎', 'WATER'])} when 1 then {array(['weird', '水'])} when 2 then {array(['METAL'])} else null end",
        "types": f"case when p_partkey % 5 = 3 then {array(['雷'])} else null end",
        "evolutionStage": "case p_partkey % 4 when 0 then 'たね' when 1 then '2進化' when 2 then 'STAGE_1' else 'VMAX' end",
        "ruleBox": "case p_partkey % 5 when 0 then 'ex' when 1 then 'VSTAR' when 2 then 'TERA' else null end",
        "rarity": "case p_partkey % 6 when 0 then 'rr' when 1 then 'SR' when 2 then 'PROMO' when 3 then 'AMAZING_RARE' when 4 then 'zz' else null end",
        "variantType": "case p_partkey % 4 when 0 then 'ar' when 1 then 'HOLO' when 2 then 'SECRET_RARE' else null end",
        "hp": "case p_partkey % 4 when 0 then '120' when 1 then ' 90x' when 2 then 'none' else null end",
        "abilities": "case when p_partkey % 3 = 0 then null else concat('[{\"name\":\"', p_type, '\"}]') end",
        "attacks": "case when p_partkey % 2 = 0 then null else '[{\"name\":\"Tackle\"}]' end",
        "effectText": "case when p_partkey % 3 = 0 then concat('Draw ', cast(p_size as string), ' cards.') else null end",
        "text": "case when p_partkey % 7 = 0 then 'plain' else null end",
        "collectorNumber": "case when p_partkey % 3 = 0 then concat(cast(p_size as string), '/100') else null end",
        "cardNumber": "case when p_partkey % 3 = 1 then cast(p_size as string) else null end",
        "expansionCode": "case when p_partkey % 43 = 0 then null else concat('sv', right(p_brand, 1)) end",
        "region": "case p_partkey % 4 when 0 then 'HK' when 1 then 'CN' when 2 then 'EN' else null end",
        "language": "case p_partkey % 4 when 0 then 'ZH_TW' when 1 then 'ZH_CN' when 2 then 'EN_US' else null end",
    }


SPARK_RAW = _raw(lambda xs: "array({})".format(", ".join(f"'{x}'" for x in xs)))
_SQL_RAW = ", ".join(f'{e} as "{c}"' for c, e in _raw(lambda xs: "[{}]".format(", ".join(f"'{x}'" for x in xs))).items())


def _case(column: str, pairs: dict[str, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items()) + f" else {other} end"


def _in(values: list[str]) -> str:
    return "({})".format(", ".join(f"'{v}'" for v in values))


def _member(column: str, values: list[str]) -> str:
    return f"case when {column} in {_in(values)} then {column} end"


_SUPERTYPE = _case("supertype", codes.SUPERTYPE_NAMES, _member("supertype", codes.SUPERTYPES))
_ONE_TYPE = _case("x", codes.TYPE_NAMES, _member("x", codes.TYPES))
_ONE_SUBTYPE = _case("x", codes.SUBTYPE_NAMES, _member("x", codes.SUBTYPES))
_STRICT_SUBTYPE = _case("x", codes.SUBTYPE_NAMES, "null")
_EFFECT = "coalesce(nullif(\"effectText\", ''), nullif(text, ''))"
_NUMBER = "coalesce(nullif(split_part(\"collectorNumber\", '/', 1), ''), nullif(\"cardNumber\", '')"


def _normal(form: str) -> str:
    direct = form == "direct"
    types = "coalesce(\"pokemonTypes\", types, [])"
    members = "coalesce(subtypes, case when subtype <> '' then [subtype] end, [])" if direct else "coalesce(subtypes, [])"
    joined = "coalesce(abilities, '[]') || '|' || coalesce(attacks, '[]')" if direct else "'{\"abilities\":' || coalesce(abilities, '[]') || ',\"attacks\":' || coalesce(attacks, '[]') || '}'"
    clean = "array_to_string(list_filter(list_transform({}, lambda x: {}), lambda x: x is not null), ',')"
    folded = f"({_SUPERTYPE} = 'TRAINER' and \"effectText\" <> '')" if direct else "false"
    number = _NUMBER + (", nullif(regexp_extract(\"webCardId\", '(\\d+)$', 1), '')" if direct else "") + ")"
    return f"""select "webCardId", name, {_SUPERTYPE} as supertype, {clean.format(members, _ONE_SUBTYPE if direct else _STRICT_SUBTYPE)} as subtypes, {clean.format(types if direct else types + '[1:1]', _ONE_TYPE)} as types,
  case when {_SUPERTYPE} = 'POKEMON' then {_case('"evolutionStage"', codes.STAGE_NAMES, 'null')} end as "evolutionStage", case when upper("ruleBox") in {_in(codes.RULE_BOXES)} then upper("ruleBox") end as "ruleBox",
  {_case('upper(rarity)', codes.RARITY_NAMES, _member('rarity', codes.RARITIES))} as rarity, case when upper("variantType") in {_in(codes.IMPORTED_VARIANTS)} then upper("variantType") else 'NORMAL' end as "variantType",
  coalesce(try_cast(nullif(regexp_extract(hp, '^\\s*([+-]?\\d+)', 1), '') as int), -1) as shown_hp,
  case when coalesce({folded}, false) then '[{{"type":"ABILITY","name":"","text":"' || "effectText" || '"}}]' else abilities end as abilities, attacks, case when coalesce({folded}, false) then null else {_EFFECT} end as text, {_EFFECT} as updated_text,
  {number} as "cardNumber", lower("expansionCode") as code, upper("expansionCode") as primary_code, {f"case when region in {_in(codes.REGIONS)} then region else 'JP' end" if direct else "'JP'"} as region,
  {f"case when language in {_in(codes.LANGUAGES)} then language else 'JA_JP' end" if direct else "'JA_JP'"} as language, substr(sha256({joined}), 1, 16) as "skillsSignature" from raw"""


WITH_RAW = f"with raw as (select {_SQL_RAW} from part)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(*[f"{e} as {c}" for c, e in SPARK_RAW.items()])


def _shown(cards: DataFrame) -> DataFrame:
    """Lists as text, and no null numbers, so that rows compare."""
    rest = [c for c in cards.columns if c not in ("types", "subtypes", "hp", "problems")]
    return cards.select(*rest, F.array_join("types", ",").alias("types"), F.array_join("subtypes", ",").alias("subtypes"), F.coalesce("hp", F.lit(-1)).alias("shown_hp"))


@query(f"{WITH_RAW} {_normal('service')}")
def import_normalised(spark, sf_dir):
    return _shown(imports.normalised(raw(spark, sf_dir)))


@query(f"{WITH_RAW} {_normal('direct')}")
def import_normalised_direct(spark, sf_dir):
    return _shown(imports.normalised(raw(spark, sf_dir), "direct"))


_GOOD = "\"webCardId\" <> '' and name <> '' and code <> '' and not coalesce(supertype = 'POKEMON' and types = '', false) and \"cardNumber\" is not null"


@query(f"""{WITH_RAW}, n as ({_normal('direct')}), k as (select * from n where name <> 'カード検索')
select count(*) filter ({_GOOD}) as success, count(*) filter (not coalesce({_GOOD}, false)) as failed, (select count(*) from n where name = 'カード検索') as skipped, round(100.0 * count(*) filter ({_GOOD}) / count(*), 6) as pct from k
""")
def import_outcomes(spark, sf_dir):
    rows = imports.normalised(raw(spark, sf_dir), "direct")
    good, bad = imports.checked(imports.without_placeholder(rows), need_number=True)
    return imports.outcomes(rows, good, bad)


@query(f"""{WITH_RAW}, n as ({_normal('direct')}), met as (select distinct code, primary_code, region from n where code is not null),
old_primary as (select 'SV1' as code, 'Old one' as name), old_regional as (select 'SV2' as primary_code, 'HK' as region, 'Old HK' as name)
select 'primary' as level, code, '' as region, name from old_primary union all select distinct 'primary', primary_code, '', 'Set ' || primary_code from met where primary_code <> 'SV1'
union all select 'regional', primary_code, region, name from old_regional union all select distinct 'regional', primary_code, region, primary_code || ' (' || region || ')' from met where not (primary_code = 'SV2' and region = 'HK')
""")
def import_expansions(spark, sf_dir):
    """Dimensions after an import: those that were there stay as they are, missing ones are made once."""
    primaries = spark.createDataFrame([("SV1", "Old one")], "code string, nameEn string")
    regionals = spark.createDataFrame([("sv2", "HK", "Old HK", "SV2")], "code string, region string, name string, primaryExpansion string")
    a, b = imports.expansions_of(imports.normalised(raw(spark, sf_dir), "direct"), primaries, regionals)
    level = lambda c: F.lit(c).alias("level")
    return a.select(level("primary"), "code", F.lit("").alias("region"), F.col("nameEn").alias("name")).unionByName(b.select(level("regional"), F.col("primaryExpansion").alias("code"), "region", "name"))


@query(f"""{WITH_RAW}, n as ({_normal('direct')}), o as (select distinct name, "skillsSignature", 'OLD' as e, '0' as c from n where length(name) % 2 = 0),
l as (select name, "skillsSignature", primary_code, "cardNumber", row_number() over (partition by name, "skillsSignature" order by "webCardId" desc) as i from n where "webCardId" <> '')
select coalesce(o.name, l.name) as name, coalesce(o."skillsSignature", l."skillsSignature") as "skillsSignature", case when l.name is not null then l.primary_code else o.e end as "primaryExpansion", case when l.name is not null then l."cardNumber" else o.c end as "cardNumber",
  case when o.name is null then 'inserted' when l.name is null then 'kept' else 'updated' end as outcome
from o full join (select * from l where i = 1) l on o.name = l.name and o."skillsSignature" = l."skillsSignature"
""")
def import_primary_cards(spark, sf_dir):
    rows = imports.normalised(raw(spark, sf_dir), "direct")
    old = rows.where(F.length("name") % 2 == 0).select("name", "skillsSignature", F.lit("OLD").alias("primaryExpansion"), F.lit("0").alias("cardNumber")).distinct()
    return imports.primary_cards(old, rows.where("webCardId <> ''"))


def _upsert_sql(form: str) -> str:
    return f"""{WITH_RAW}, n as ({_normal(form)}), o as (select "webCardId", 'Old' as name, 'XX' as language, 'old' as "skillsSignature", 'NORMAL' as "variantType" from n where length("webCardId") % 2 = 0 and "webCardId" <> ''), l as (select * from n where "webCardId" <> '')
select coalesce(o."webCardId", l."webCardId") as "webCardId", coalesce(l.name, o.name) as name, coalesce(o.language, l.language) as language, {'coalesce(l."skillsSignature", o."skillsSignature")' if form == 'direct' else 'coalesce(o."skillsSignature", l."skillsSignature")'} as "skillsSignature",
  coalesce(l."variantType", o."variantType") as "variantType", case when o."webCardId" is null then 'inserted' when l."webCardId" is null then 'kept' else 'updated' end as outcome from o full join l on o."webCardId" = l."webCardId"
"""


def _card_upsert(form: str):
    def run(spark, sf_dir):
        rows = imports.normalised(raw(spark, sf_dir), form).where("webCardId <> ''")
        old = rows.where(F.length("webCardId") % 2 == 0).select("webCardId", F.lit("Old").alias("name"), F.lit("XX").alias("language"), F.lit("old").alias("skillsSignature"), F.lit("NORMAL").alias("variantType"))
        return imports.card_upsert(old, rows, form)

    return run


for _form, _name in (("service", "import_upsert"), ("direct", "import_upsert_direct")):
    _f = _card_upsert(_form)
    _f.__name__ = _name
    query(_upsert_sql(_form))(_f)


@query("""
select o_orderkey, case when o_orderkey % 4 in (0, 1) then 'N' || cast(o_orderkey as string) else o_orderstatus end as o_orderstatus, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 2 then 'low' else o_orderpriority end as o_orderpriority from orders
""")
def sparse_merge(spark, sf_dir):
    """Patches change the columns they name, also to null."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey") % 4
    given = F.when(k == 0, F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority"))).when(k == 1, F.array(F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_orderpriority")))
    patches = orders.where(k < 3).select("o_orderkey", given.alias("given"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("o_orderstatus"), F.when(k == 2, "low").alias("o_orderpriority"))
    return imports.sparse_update(orders, patches, "o_orderkey")


@query("""
select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as merged, case when o_orderkey % 3 = 0 then 'X' when o_orderkey % 3 = 1 then null else o_orderstatus end as overwritten from orders
""")
def merge_strategies(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.where("o_orderkey % 3 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").alias("o_orderstatus"))
    a = imports.merged(orders, new, "o_orderkey").withColumnRenamed("o_orderstatus", "merged")
    return a.join(imports.merged(orders, new, "o_orderkey", "overwrite").withColumnRenamed("o_orderstatus", "overwritten"), "o_orderkey")


@query("""
select concat('c', cast(p_partkey as string)) as "webCardId", case when p_partkey % 3 = 0 then nullif(case when p_partkey % 2 = 0 then '' else 'a' end, '') else 'from' end as "evolvesFrom", case when p_partkey % 3 = 0 then 'b' else 'to' end as "evolvesTo" from part
""")
def evolution_update(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("webCardId"), F.lit("from").alias("evolvesFrom"), F.lit("to").alias("evolvesTo"), "p_partkey")
    patches = rows.where("p_partkey % 3 = 0").select("webCardId", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("a").alias("evolvesFrom"), F.lit("b").alias("evolvesTo"))
    return imports.evolution_update(rows.drop("p_partkey"), patches)


@query("""
select p_partkey, case when p_partkey % 5 = 0 then case when p_partkey % 2 = 0 then 'src' end else p_brand end as p_brand, case when p_partkey % 2 = 0 then 'new' else p_type end as p_type,
  (select count(*) from part where p_partkey % 2 = 0) as n_found, (select count(*) from part where p_partkey % 2 <> 0) as n_missing from part
""")
def repaired(spark, sf_dir):
    """Missing brands filled and types replaced from a source that knows every second part."""
    part = _t(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("p_brand"), "p_type")
    source = part.where("p_partkey % 2 = 0").select("p_partkey", F.lit("src").alias("p_brand"), F.lit("new").alias("p_type"))
    out, counts = imports.repaired(rows, source, "p_partkey", ["p_brand"], ["p_type"])
    return out.crossJoin(F.broadcast(counts.select("n_found", "n_missing")))  # one row


@query("select p_partkey, case when p_partkey % 3 = 0 then null else p_type end as p_type, p_partkey % 3 = 0 as found from part")
def refreshed(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    return imports.refreshed(part, part.where("p_partkey % 3 = 0").withColumn("p_type", F.lit(None).cast("string")), "p_partkey", ["p_type"])


@query("""
select s_suppkey as id, case when s_suppkey % 2 = 0 then 'Edited' else s_name end as name, 'old' as note, case when s_suppkey % 4 = 0 then 1 else s_nationkey end as kind_id from supplier
""")
def product_edit(spark, sf_dir):
    """Edits of every second product; of their kinds only one code is known."""
    products = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("old").alias("note"), F.col("s_nationkey").alias("kind_id"))
    edits = products.where("id % 2 = 0").select("id", F.lit("Edited").alias("name"), F.lit(None).cast("string").alias("note"), F.when(F.col("id") % 4 == 0, "known").otherwise("unknown").alias("kind_code"))
    return imports.product_edit(products, edits, spark.createDataFrame([("known", 1)], "code string, kind_id int"))


@query("select p_type as label, case p_type when 'SMALL' then 'constructed_deck' end as kind, case p_type when 'LARGE' then 'JA_JP' else 'EN_US' end as language, count(*) as n from part group by all")
def label_maps(spark, sf_dir):
    label = F.when(F.col("p_type") == "SMALL", "構築デッキ").otherwise(F.col("p_type"))
    place = F.when(F.col("p_type") == "LARGE", "ja-JP").otherwise("xx")
    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("label"), imports.product_kind(label).alias("kind"), codes.language(place).alias("language"))
    return rows.groupBy("label", "kind", "language").agg(F.count("*").alias("n"))


@query("""
select p_partkey, case p_partkey % 6 when 0 then 'mine' when 1 then '拡張パック' when 2 then 'その他の商品' when 3 then '構築デッキ' when 4 then '周辺グッズ' end as label from part
""")
def product_labels(spark, sf_dir):
    """Labels by title; products that have one keep it."""
    n = F.col("p_partkey") % 6
    title = F.when(n == 1, "Sun & Moon x").when(n == 2, "Sun & Moon Promo").when(n == 3, "デッキケース").when(n == 4, "Sun & Moon Basic Energy").otherwise("other")
    label = imports.product_label(title, F.when(n == 0, "mine"))
    return _t(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("""
with r as (select *, (row_number() over (order by p_name, p_partkey) - 1) // 50 as batch from part)
select p_partkey, batch, case when max(cast(p_size = 13 as int)) over (partition by batch) = 1 then 'failed' else 'success' end as outcome from r
""")
def transaction_batches(spark, sf_dir):
    """Batches of fifty in order; one failing row fails its batch."""
    return imports.in_batches(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_partkey"], 50, F.col("p_size") == 13).select("p_partkey", "batch", "outcome")


@query("""
with c as (select distinct p_name as name, case when p_partkey % 2 = 0 then '[1]' end as abilities, case p_partkey % 3 when 0 then 'ja-JP' else 'fr-FR' end as locale from part)
select 'vl_' || substr(sha256(name || '|' || locale || '|' || sig), 1, 12) as "webCardId", case locale when 'ja-JP' then 'JA_JP' else 'EN_US' end as language, name, sig as "skillsSignature", (select count(*) from (select distinct name, abilities from c)) as n_primary
from (select *, substr(sha256('{"abilities":' || coalesce(abilities, '[]') || ',"attacks":[]}'), 1, 16) as sig from c)
""")
def from_extraction(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    rows = part.select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "[1]").alias("abilities"), F.when(F.col("p_partkey") % 3 == 0, "ja-JP").otherwise("fr-FR").alias("locale")).distinct()
    extracted = rows.select("*", none.alias("webCardId"), none.alias("attacks"), none.alias("supertype"), F.lit(None).cast("array<string>").alias("types"), F.lit(0).alias("hp"), none.alias("cardNumber"))
    cards, primaries = imports.from_extraction(extracted, spark.createDataFrame([], "name string, skillsSignature string, cardNumber string"))
    return cards.select("webCardId", "language", "name", "skillsSignature").crossJoin(F.broadcast(primaries.agg(F.count("*").alias("n_primary"))))  # one row


@query("""
select conv_id, turn, case when role = 'user' then 'ValueError: user' end as error, case when role <> 'user' then length(text) end is not null as done from conversations
""")
def attempted_rows(spark, sf_dir):
    """A function on every row: what it raises becomes the row's error."""

    def size(row: dict) -> dict:
        if row["role"] == "user":
            raise ValueError("user")
        return {"size": len(row["text"])}

    rows = imports.attempted(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), size, "size double")
    return rows.select("conv_id", "turn", "error", F.col("size").isNotNull().alias("done"))


@query("""
with b as (select o_custkey as image, o_orderkey % 90 as top, o_orderkey as left_, row_number() over (partition by o_custkey order by o_orderkey % 90, o_orderkey) as box from orders)
select image, box, case when box % 2 = 1 then 'read' end as result from b join customer on image = c_custkey
""")
def detected_boxes(spark, sf_dir):
    images = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"))
    boxes = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 90).alias("top"), F.col("o_orderkey").alias("left"))
    numbers = images.select("image", F.explode(F.sequence(F.lit(1), F.lit(199), F.lit(2))).alias("box"))
    return imports.detected(images, boxes, numbers.withColumn("result", F.lit("read")), "image").select("image", "box", "result")


@query("select substr(url, 1, 12) as file, count(*) as n, count(*) filter (not contains(html, 'e')) as n_bad, count(*) filter (contains(html, 'e')) as n_good from pages group by all")
def per_file_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").withColumn("file", F.substring("url", 1, 12))
    return imports.per_file(rows, "file", ~F.contains("html", F.lit("e")))
