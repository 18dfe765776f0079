"""Card page queries: a page of each site is written for every part, and read back as a record.

The SQL says what each page must give; it never sees the markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import dialects, html
from marlstone.operators.jsonclean import without_empty_members
from marlstone.plans.catalog import _t, query

JP = {
    0: """<html><body><h1> {name} </h1><div class="RightBox"><div class="TopInfo"><span class="type">2&nbsp;進化</span><div class="td-r"><span class="hp">HP</span><span class="hp-num">{hp}</span><span class="icon icon-none"></span><i class="icon icon-fire"></i></div></div>
<h2 class="mt20">特性</h2><h4>Shield</h4><p>Guards &amp; waits.</p><h2>ワザ</h2><h4><span class="icon icon-fire"></span><span class="icon icon-none"></span>Flare<span class="f_right Text-fjalla">{hp}</span></h4><p>Burns <b>a lot</b>.</p><h4><span class="icon icon-dragon"></span>Wait</h4>
<h2>進化</h2><div class="evolution evbox"><a href="#">Nextmon</a></div><div class="evolution evbox"><a href="#">Topmon</a><a>X</a></div></div>
<table><tr><th>弱点</th><th>抵抗力</th><th>にげる</th></tr><tr><td><span class="icon-water icon"></span>×2</td><td><span class="icon-psychic icon"></span>-30</td><td><span class="icon-none icon"></span><span class="icon-none icon"></span></td></tr></table>
<div class="card"><h4>No.{n} Fire</h4><p>高さ：1.5 m 重さ：20.0 kg</p></div><div class="subtext"><img class="img-regulation" src="x.gif" alt="{code}"> 105 / 100 </div><img src="/assets/images/card_images/large/{n}.jpg"><h5>イラストレーター</h5><p><a href="#">Some Artist</a></p></body></html>""",
    1: """<html><body><h1>{name}</h1><h2>サポート</h2><p>自分の山札を1枚引く。それから手札を1枚選ぶ。</p><p>© 任天堂</p><div class="subtext">228 / SV-P <img src="/assets/rarity/ic_rare_sar.gif?x"></div><a href="/ex/{code}/">set</a> ACE SPEC</body></html>""",
    2: """<html><body><h1>{name} エネルギー</h1><h3>基本エネルギー</h3><p>short</p><div class="subtext">7/70<img src="/rarity/ic_rare_u_c.gif"></div></body></html>""",
}
ASIA = {
    0: """<html><body><h1><span class="evolveMarker">{stage}</span> {name} V</h1><p class="mainInfomation"><span class="hitPoint">HP</span><span class="number">{hp}</span><img src="/img/Grass.png"></p><img src="https://asia.pokemon-card.com/{folder}/card-img/{prefix}000{n}.png">
<div class="skillInformation"><h3>{moves}</h3><div class="skill"><span class="skillName">[特性]  Shield</span><span class="skillCost"></span><span class="skillDamage"></span><p class="skillEffect">Guards.</p></div>
<div class="skill"><span class="skillName">Slam</span><span class="skillCost"><img src="/Fire.png"><img src="/Colorless.png"></span><span class="skillDamage">30+</span><p class="skillEffect">Hits.</p></div><div class="skill"><span class="skillName">Nap</span><p class="skillEffect">Sleeps.</p></div></div>
<table><tr><td class="weakpoint"><img src="/Water.png">×2</td><td class="resist">--</td><td class="escape"><img src="a.png"><img src="b.png"></td></tr></table>
<section class="expansionColumn"><span class="expansionSymbol"><img src="/x/expansion_mark_{code}.png"></span><span class="alpha">h</span><span class="collectorNumber">012/071</span></section><span class="rarity">ar</span>
<div class="evolution"><ul><li><a href="#">Base</a></li><li><a href="#">Top</a></li></ul></div><div class="extraInformation"><h3>No. {n} Mouse</h3><p class="size">Tall</p><p class="discription">It hides.</p></div></body></html>""",
    1: """<html><body><h1>{name}</h1><h3>{kind}</h3><p>Draw cards until you hold five, then your turn ends.</p><a href="/list/?expansionCodes={code}&x=1">set</a><table><tr><th>Rarity</th><td>tr</td></tr></table><span class="regulationMark">long</span></body></html>""",
    2: """<html><body><h1>{name} Energy</h1><h3>Basic Energy</h3><p class="size">none</p></body></html>""",
}
_N = "p_partkey"


def _filled(templates: dict[int, str], values: dict[str, Column]) -> Column:
    chain = F.when(F.lit(False), "")
    for k, text in templates.items():
        chain = chain.when(F.col(_N) % 3 == k, text)
    for name, value in values.items():
        chain = F.replace(chain, F.lit(f"{{{name}}}"), value)
    return chain


def _pages(spark: SparkSession, sf_dir: str, templates: dict[int, str], url: Column, **more: str) -> DataFrame:
    values = {"name": F.col("p_name"), "hp": (F.col("p_size") * 10).cast("string"), "n": F.col(_N).cast("string"), "code": F.concat(F.lit("SV"), F.substring("p_brand", -1, 1)), **{k: F.lit(v) for k, v in more.items()}}
    # A page takes a hundred times as long to read as its part, so parts are dealt to all cores first, whatever files they lie in.
    part = _t(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    return part.select(_filled(templates, values).alias("html"), url.alias("url"))


def _flat(cards: DataFrame) -> DataFrame:
    """Numbers without nulls and lists as JSON, so that rows compare."""
    numbers = {"hp", "pokedexNumber", "retreatCost"}
    lists = {"attacks", "abilities", "rules"}
    return cards.select(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) if c in numbers else F.to_json(c).alias(c) if c in lists else F.col(c) for c in cards.columns])


def _expected(rows: dict[str, tuple[str, str, str]]) -> str:
    """A column for each entry: SQL for pages of a creature, a trainer and an energy."""
    return "select " + ", ".join(f"case p_partkey % 3 when 0 then {a} when 1 then {b} else {c} end as \"{name}\"" for name, (a, b, c) in rows.items()) + " from part"


_all = lambda x: (x, x, x)
_own = lambda x, other="null": (x, other, other)
_KIND = ("'POKEMON'", "'TRAINER'", "'ENERGY'")
_JP = {
    "webCardId": _all("'jp' || p_partkey"), "name": ("p_name", "p_name", "p_name || ' エネルギー'"), "language": _all("'JA_JP'"), "region": _all("'JP'"), "supertype": _KIND, "subtype": ("null", "'SUPPORTER'", "'BASIC_ENERGY'"),
    "variantType": ("'SECRET_RARE'", "'SAR'", "'NORMAL'"), "rawRarity": ("null", "'SAR'", "'U'"), "rarity": ("'COMMON'", "'SPECIAL_ILLUSTRATION_RARE'", "'UNCOMMON'"), "expansionCode": ("'sv' || right(p_brand, 1)", "'sv' || right(p_brand, 1)", "'promo'"),
    "collectorNumber": ("'105/100'", "'228'", "'7/70'"), "regulationMark": _all("cast(null as varchar)"), "hp": _own("p_size * 10", "-1"), "type": _own("'FIRE'"), "evolutionStage": _own("'STAGE_2'"), "evolvesTo": _own("'Nextmon, Topmon'"), "ruleBox": _all("cast(null as varchar)"),
    "pokedexNumber": _own("p_partkey", "-1"), "weakness": _own("'WATER'"), "weaknessValue": _own("'×2'"), "resistance": _own("'PSYCHIC'"), "resistanceValue": _own("'-30'"), "retreatCost": _own("2", "-1"),
    "attacks": _own("'[{\"name\":\"Flare\",\"cost\":[\"炎\",\"無\"],\"damage\":\"' || p_size * 10 || '\",\"effect\":\"Burns a lot .\"},{\"name\":\"Wait\",\"cost\":[\"龍\"]}]'"), "abilities": _own("'[{\"name\":\"Shield\",\"description\":\"Guards & waits.\"}]'"),
    "effectText": ("null", "'自分の山札を1枚引く。それから手札を1枚選ぶ。'", "null"), "flavorText": _own("'高さ：1.5 m 重さ：20.0 kg Guards & waits.'"), "rules": ("null", "'[\"You can''t have more than 1 ACE SPEC card in your deck\"]'", "null"),
    "imageUrl": _own("'https://www.pokemon-card.com/assets/images/card_images/large/' || p_partkey || '.jpg'"), "illustrator": _own("'Some Artist'"), "sourceUrl": _all("'https://www.pokemon-card.com/card-search/details.php/card/' || p_partkey"),
}


def _asia(prefix: str, folder: str, language: str, region: str, abilities: str, nap: bool) -> dict[str, tuple[str, str, str]]:
    attacks = '{"name":"Slam","cost":["炎","無"],"damage":"30+","effect":"Hits."}' + (',{"name":"Nap","effect":"Sleeps."}' if nap else "")
    return {
        "webCardId": _all(f"'{prefix}' || p_partkey"), "name": ("p_name || ' V'", "p_name", "p_name || ' Energy'"), "language": _all(f"'{language}'"), "region": _all(f"'{region}'"), "supertype": _KIND, "subtype": ("null", "'SUPPORTER'", "'BASIC_ENERGY'"),
        "variantType": ("'AR'", "'NORMAL'", "'NORMAL'"), "rawRarity": ("'AR'", "'TR'", "null"), "rarity": ("'ILLUSTRATION_RARE'", "'TRAINER_RARE'", "'COMMON'"), "expansionCode": ("'sv' || right(p_brand, 1)", "'sv' || right(p_brand, 1)", "null"), "collectorNumber": _own("'012/071'"),
        "regulationMark": _own("'H'"), "hp": _own("p_size * 10", "-1"), "type": _own("'GRASS'"), "evolutionStage": _own("'STAGE_1'"), "evolvesTo": _own("'Base, Top'"), "ruleBox": _own("'V'"), "pokedexNumber": _own("p_partkey", "-1"), "weakness": _own("'WATER'"), "weaknessValue": _own("'×2'"),
        "retreatCost": _own("2", "-1"), "attacks": _own(f"'[{attacks}]'"), "abilities": _own(f"'[{abilities}]'"), "effectText": ("null", "'Draw cards until you hold five, then your turn ends.'", "null"), "flavorText": _own("'Tall It hides.'"),
        "imageUrl": _own(f"'https://asia.pokemon-card.com/{folder}/card-img/{prefix}000' || p_partkey || '.png'"), "sourceUrl": _all(f"'https://asia.pokemon-card.com/{folder}/card-search/detail/' || p_partkey || '/'"),
    }


@query(_expected(_JP))
def card_pages_jp(spark, sf_dir):
    return _flat(dialects.japanese(_pages(spark, sf_dir, JP, dialects.card_url("jp", F.col(_N).cast("string")))))


@query(_expected(_asia("hk", "hk", "ZH_TW", "HK", '{"name":"Shield","description":"Guards."}', True)))
def card_pages_hk(spark, sf_dir):
    pages = _pages(spark, sf_dir, ASIA, dialects.card_url("hk", F.col(_N).cast("string")), stage="1階進化", folder="hk", prefix="hk", moves="招式", kind="支援者")
    return _flat(dialects.asian(pages, "hk"))


@query(_expected(_asia("en", "hk-en", "EN_US", "EN", '{"name":"[特性] Shield","description":"Guards."},{"name":"Nap","description":"Sleeps."}', False)))
def card_pages_en(spark, sf_dir):
    pages = _pages(spark, sf_dir, ASIA, dialects.card_url("en", F.col(_N).cast("string")), stage="Stage 1", folder="hk-en", prefix="en", moves="Attack", kind="Supporter")
    return _flat(dialects.asian(pages, "en"))


@query("select case p_partkey % 2 when 0 then 'jp' else 'hk' end as site, p_partkey % 3 = 0 as has_hp, count(*) as n from part group by all")
def card_pages_all(spark, sf_dir):
    """Pages of two sites in one table; records without a name or id are set apart."""
    a = _pages(spark, sf_dir, JP, dialects.card_url("jp", F.col(_N).cast("string"))).withColumn("site", F.lit("jp"))
    b = _pages(spark, sf_dir, ASIA, dialects.card_url("hk", F.col(_N).cast("string")), stage="基礎", folder="hk", prefix="hk", moves="招式", kind="Item").withColumn("site", F.lit("hk"))
    number = F.regexp_extract("url", r"(\d+)", 1).cast("long") % 2
    pages = a.where(number == 0).unionByName(b.where(number == 1)).unionByName(spark.createDataFrame([("<p>no name</p>", "u/1", "jp")], "html string, url string, site string"))
    sound, _ = dialects.valid(dialects.extracted(pages, {"jp": "jp", "hk": "hk"}))
    return sound.groupBy(F.when(F.col("region") == "JP", "jp").otherwise("hk").alias("site"), F.col("hp").isNotNull().alias("has_hp")).agg(F.count("*").alias("n"))


@query("""
select doc_id, to_json(struct_pack(lang := lang, n := case when n_chars > 500 then n_chars end)) as kept_json from documents
""".replace("to_json(struct_pack(lang := lang, n := case when n_chars > 500 then n_chars end))", "case when lang is null or lang = '' then case when n_chars > 500 then '{\"n\":' || n_chars || '}' else '{}' end when n_chars > 500 then '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' else '{\"lang\":\"' || lang || '\"}' end"))
def without_empty(spark, sf_dir):
    """Fields as JSON without empty ones."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("n"), F.lit("").alias("blank"), F.array().cast("array<string>").alias("list"))
    return rows.select("doc_id", html.without_empty(rows, ["lang", "n", "blank", "list"]).alias("kept_json"))


@query("select page_id, count(*) as n_links from (select page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) as code from pages) where code <> '' group by 1")
def expansion_links(spark, sf_dir):
    """Codes that a page's links and checkboxes offer, as rows."""
    return html.offered(_t(spark, sf_dir, "pages"), "page_id", "html", r'href="/([^"]*)"').groupBy("page_id").agg(F.count("*").alias("n_links"))


#: A nested record in either dialect: what a part lacks is empty in it, at three depths and in a list. The sign ' is a ".
_NESTED = "{'name': '<name>', 'size': <n>, 'tags': <tags>, 'inner': {'a': '<brand>', 'b': null, 'deep': {'c': [], 'z': 0}}, 'list': [{'a': '', 'b': <n>}, ''], 'odd': ':null,', 'flag': false}"


def _nested_record() -> F.Column:
    out = F.lit(_NESTED.replace("'", '"'))
    n = F.col("p_partkey") % 3
    for name, value in {"<name>": F.col("p_name"), "<n>": n.cast("string"), "<tags>": F.when(n == 1, '["x"]').otherwise("[]"), "<brand>": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")}.items():
        out = F.replace(out, F.lit(name), value)
    return out


def _tidy(body: str) -> str:
    """SQL for what must be left of it: between < and > stand expressions, ' is a quote."""
    out = []
    for i, piece in enumerate(body.split("<")):
        expression, rest = ("", piece) if i == 0 else piece.split(">", 1)
        out += ([f"({expression})"] if expression else []) + ["'" + rest.replace("'", '"') + "'"]
    return " || ".join(out)


_TAGS = "<case when p_partkey % 3 = 1 then ',\"tags\":[\"x\"]' else '' end>"
_BRAND = "<case when p_partkey % 2 = 0 then '\"a\":\"' || p_brand || '\",' else '' end>"
_SIZE = "<case p_partkey % 3 when 0 then '' else ',\"size\":' || p_partkey % 3 end>"
_LEFT_JP = f"{{'name':'<p_name>','size':<p_partkey % 3>{_TAGS},'inner':{{{_BRAND}'deep':{{'z':0}}}},'list':[{{'b':<p_partkey % 3>}},''],'odd':':null,','flag':false}}"
_LEFT_ASIA = f"{{'name':'<p_name>'{_SIZE}{_TAGS},'inner':{{{_BRAND}'deep':{{}}}},'list':[{{'a':'','b':<p_partkey % 3>}},''],'odd':':null,'}}"


@query(f"select p_partkey, {_tidy(_LEFT_JP)} as jp, {_tidy(_LEFT_ASIA)} as asia from part")
def nested_without_empty(spark, sf_dir):
    """Nested records without empty members, in the way of either dialect."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", _nested_record().alias("j"))
    return rows.select("p_partkey", without_empty_members(F.col("j"), "jp").alias("jp"), without_empty_members(F.col("j"), "asia").alias("asia"))
