"""Card records from pages of three regional sites, as expressions over the page's text.

A dialect is a set of columns: names, numbers, types and lists are cut out by patterns on the JVM side, without a parser.
Elements are found by tag and class. Tags of elements that may lie in their own kind are numbered first by how deep they do,
so an element ends at the end tag of its number, whatever lies in it; others end at the first end tag of their name.

A page is searched once for each thing: what several columns read is a column of its own first (``staged``), or the argument
of a function (``once``), as Spark writes an expression out wherever it is used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import lit_map, prefixed_id, variant_of
from marlstone.operators.html import first, once, text_of

# Names of element icons with the type and the symbol of each, in the order they are tried in.
ICON_TYPES = {
    "fire": "FIRE", "water": "WATER", "lightning": "LIGHTNING", "electric": "LIGHTNING", "grass": "GRASS", "fighting": "FIGHTING", "psychic": "PSYCHIC", "darkness": "DARKNESS",
    "dark": "DARKNESS", "metal": "METAL", "steel": "METAL", "none": "COLORLESS", "colorless": "COLORLESS", "fairy": "FAIRY", "dragon": "DRAGON",
}
SYMBOLS = {"FIRE": "炎", "WATER": "水", "LIGHTNING": "雷", "GRASS": "草", "FIGHTING": "闘", "PSYCHIC": "超", "DARKNESS": "悪", "METAL": "鋼", "COLORLESS": "無", "FAIRY": "フェアリー", "DRAGON": "ドラゴン"}
JP_SYMBOLS = SYMBOLS | {"FAIRY": "妖", "DRAGON": "龍"}
# Types in the order in which image names are searched for them.
IMAGE_TYPES = ["Grass", "Fire", "Water", "Lightning", "Psychic", "Fighting", "Darkness", "Metal", "Fairy", "Dragon", "Colorless"]
# Rarities as the sites write them.
RARITIES = {
    "C": "COMMON", "U": "UNCOMMON", "R": "RARE", "RR": "DOUBLE_RARE", "RRR": "ULTRA_RARE", "SR": "SPECIAL_ILLUSTRATION_RARE", "UR": "HYPER_RARE", "AR": "ILLUSTRATION_RARE",
    "SAR": "SPECIAL_ILLUSTRATION_RARE", "SSR": "SPECIAL_ILLUSTRATION_RARE", "MUR": "ULTRA_RARE", "MA": "AMAZING_RARE", "CHR": "SHINY_RARE", "PROMO": "PROMO", "S": "PROMO",
}
RARITY_FILES = {"ic_rare_s_2.gif": "S", "ic_rare_ar.gif": "AR", "ic_rare_sr_c.gif": "SR", "ic_rare_mur.gif": "MUR", "ic_rare_sar.gif": "SAR", "ic_rare_ssr.gif": "SSR", "ic_rare_ur.gif": "UR"}
VARIANTS = ["AR", "SAR", "SR", "SSR", "UR", "MUR", "MA", "CHR"]
JP_STAGES = {"たね": "BASIC", "たねポケモン": "BASIC", "1 進化": "STAGE_1", "1進化": "STAGE_1", "2 進化": "STAGE_2", "2進化": "STAGE_2", "M進化": "MEGA", "VMAX": "VMAX", "VSTAR": "VSTAR"}
MARKER_STAGES = {"基礎": "BASIC", "Basic": "BASIC", "1階進化": "STAGE_1", "Stage 1": "STAGE_1", "2階進化": "STAGE_2", "Stage 2": "STAGE_2"}
MARKER_WORDS = {"VMAX": "VMAX", "VSTAR": "VSTAR", "V-UNION": "V_UNION", "BREAK": "BREAK"}
# Rule boxes by patterns of the name, in order.
RULE_BOXES = {"EX": r"\bEX\b", "GX": r"\bGX\b", "V": r"\bV$", "VMAX": r"\bVMAX\b", "VSTAR": r"\bVSTAR\b"}
# Headings, words and notices by which effect texts are told from others; texts of the terastal kind.
JP_SECTIONS = ["グッズ", "サポート", "スタジアム", "ポケモンのどうぐ", "特殊エネルギー", "基本エネルギー"]
HK_SECTIONS = ["物品", "支援者", "競技場", "寶可夢的道具", "特殊能量", "基本能量", "Item", "Supporter", "Stadium", "Pokémon Tool", "Special Energy", "Basic Energy"]
JP_WORDS = ["このカード", "自分の番", "相手の", "ダメージ", "ポケモン", "トラッシュ", "手札", "山札"]
HK_WORDS = ["this card", "your turn", "opponent", "damage", "pokemon", "這張卡", "你的回合", "對手", "傷害", "寶可夢"]
EN_WORDS = ["this card", "your turn", "opponent", "damage", "pokemon", "shuffle", "deck", "hand", "discard"]
JP_NOTICES = ["©", "ポケットモンスター", "任天堂"]
JP_BENCH = "このポケモンは、ベンチにいるかぎり、ワザのダメージを受けない。"
HK_BENCH = "這隻寶可夢在備戰區時"
TERA = ["テラスタル", "太晶", "Tera"]
ACE = "You can't have more than 1 ACE SPEC card in your deck"


def _class(name: str) -> str:
    return rf'class\s*=\s*["\'][^"\']*(?<![\w-]){name}(?![\w-])[^"\']*["\']'


#: Elements that may hold their own kind.
NESTING = ("div", "span", "section", "table", "td", "th")


def numbered(page: Column) -> Column:
    """The page without comments and scripts, with each tag of a nesting element as ``<div~n`` or ``</div~n``: n counts the
    elements of its kind that are open there, with its own. Running counts over the page's tags give it."""
    bare = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    pattern = rf"(?i)</?(?:{'|'.join(NESTING)})(?=[\s>/])"
    codes = lit_map({f"<{end}{t}": -k if end else k for k, t in enumerate(NESTING, 1) for end in ("", "/")})
    start = F.struct(F.array().cast("array<int>").alias("numbers"), F.array(*[F.lit(0)] * len(NESTING)).alias("open"))

    def step(acc: Column, code: Column) -> Column:
        kind = F.abs(code) - 1
        number = F.get(acc["open"], kind) + F.when(code > 0, 1).otherwise(0)
        left = F.when(code > 0, number).otherwise(F.greatest(F.lit(0), number - 1))
        return F.struct(F.concat(acc["numbers"], F.array(number)).alias("numbers"), F.transform(acc["open"], lambda n, i: F.when(i == kind, left).otherwise(n)).alias("open"))

    def joined(text: Column, tags: Column) -> Column:
        numbers = F.aggregate(F.transform(tags, lambda t: F.element_at(codes, t)), start, step)["numbers"]
        marks = F.zip_with(tags, numbers, lambda t, n: F.concat(t, F.lit("~"), n.cast("string")))
        return F.array_join(F.zip_with(F.split(text, pattern), marks, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")

    return once(bare, lambda text: once(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.lower(t)), lambda tags: joined(text, tags)))


def staged(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is worked out here, once: the optimizer writes it neither into filters on it nor into
    what reads it, as it would with a plain column."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def _element(tag: str, marked: str, group: int = 1) -> str:
    """A pattern of an element with its inside; a nesting one's number is caught as ``group``, and its inside as the next."""
    if tag in NESTING:
        return rf"<{tag}~(\d+){marked}>(.*?)</{tag}~\{group}\s*>"
    return rf"<{tag}{marked}>(.*?)</{tag}\s*>"


_ANY = r"(?:\s[^>]*)?"


def inner(page: Column, tag: str, cls: str | None = None) -> Column:
    """The inside of the first element of this tag and class, null without one."""
    pattern = "(?is)" + _element(tag, rf"[^>]*{_class(cls)}[^>]*" if cls else _ANY)
    return found(page, pattern, 2 if tag in NESTING else 1)


def found(page: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match (which is never empty, nor looks beyond its end)."""
    return once(F.regexp_extract(page, pattern, 0), lambda m: F.when(m != "", F.regexp_extract(m, pattern, group)))


def every(page: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(page, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def told(html: Column) -> Column:
    """The text of an element, null if it has none."""
    return once(text_of(html), lambda t: F.nullif(t, F.lit("")))


def holds_any(column: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words]), F.lit(False))


def first_known(values: Column, keep: Callable[[Column], Column] = lambda x: x.isNotNull()) -> Column:
    return F.get(F.filter(values, keep), F.lit(0))


def some(values: Column) -> Column:
    """A list, null if it is empty."""
    return F.when(F.size(values) > 0, values)


def icons(html: Column, tags: str = r"\w+") -> Column:
    """Types of the icons in an element, in order; null for unknown ones."""
    return F.transform(every(html, rf'(?is)<(?:{tags})\b[^>]*class\s*=\s*["\'][^"\']*(?<![\w-])icon-([a-z]+)'), lambda x: F.element_at(lit_map(ICON_TYPES), x))


def first_icon(html: Column) -> Column:
    """The first type with a colour."""
    return first_known(icons(html, "span|div|i"), lambda x: x.isNotNull() & (x != "COLORLESS"))


def image_type(src: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for word in IMAGE_TYPES:
        chain = chain.when(F.contains(src, F.lit(word)), word.upper())
    return chain


def image_symbol(src: Column) -> Column:
    """The symbol of the first icon name that the image's name holds."""
    chain = F.when(F.lit(False), "")
    for word, kind in ICON_TYPES.items():
        chain = chain.when(F.contains(F.lower(src), F.lit(word)), SYMBOLS[kind])
    return chain


def sources(html: Column) -> Column:
    return every(html, r'(?is)<img\b[^>]*\bsrc\s*=\s*["\']([^"\']*)')


def headings(page: Column) -> Column:
    """Texts of second and third level headings, as one."""
    return F.array_join(F.transform(every(page, r"(?is)<h[23](?:\s[^>]*)?>(.*?)</h[23]\s*>"), text_of), " ")


def section(page: Column, title: str) -> Column:
    """What follows the second-level heading with exactly this text, up to the next one; null without it."""
    pattern = rf"(?is)<h2(?:\s[^>]*)?>\s*{title}\s*</h2\s*>(.*?)(?=<h2[\s>]|\Z)"
    return F.when(page.rlike(pattern), F.regexp_extract(page, pattern, 1))


def cells(table: Column) -> Column:
    """Cells of a table."""
    return every(table, "(?is)" + _element("td", _ANY), 2)


def table_headers(table: Column) -> Column:
    return F.transform(every(table, "(?is)" + _element("th", _ANY), 2), text_of)


def supertype(text: Column, name: Column, energy: Column, titles: Column, moves: list[str]) -> Column:
    """By hp in the page's text, the name's ending, an energy's name, the headings of moves, in this order."""
    return (
        F.when(text.rlike(r"HP\s*\d+") | name.rlike(r"(VSTAR|VMAX|V|GX|EX|ex)$"), "POKEMON")
        .when(energy, "ENERGY")
        .when(holds_any(titles, moves), "POKEMON")
        .otherwise("TRAINER")
    )


def hp(text: Column) -> Column:
    return first(text, r"HP\s*(\d+)").try_cast("int")


def collector_number(page: Column, whole: Column, promos: bool) -> Column:
    """n/m of the line under the card, else of the page's ``whole`` text; of promotional cards the left part."""
    both = r"\b(\d{1,4})\s*/\s*(\d{1,4})\b"

    def number(text: Column) -> Column:
        found = F.when(text.rlike(both), F.concat(F.regexp_extract(text, both, 1), F.lit("/"), F.regexp_extract(text, both, 2)))
        return F.coalesce(found, first(text, r"\b(\d{1,4})\s*/\s*[A-Za-z0-9\-]+\b")) if promos else found

    return once(F.coalesce(text_of(inner(page, "div", "subtext")), whole), number)


def rule_box(name: Column, radiant: str, attacks: Column, abilities: Column, bench: Column) -> Column:
    """By the name, then by abilities and attacks of the terastal kind; values beyond the enumeration are kept as told."""
    chain = F.when(F.lit(False), "")
    for box, pattern in RULE_BOXES.items():
        chain = chain.when(name.rlike(pattern), box)
    chain = chain.when(name.rlike(radiant), "RADIANT")
    tera = F.coalesce(bench, F.lit(False)) | F.coalesce(F.exists(attacks, lambda a: holds_any(a["name"], TERA)), F.lit(False))
    return F.coalesce(chain, F.when(tera, "TERA"))


def effect(page: Column, sections: list[str], words: list[str], skip: Callable[[Column], Column], fallback: Column | None = None) -> Column:
    """A trainer's or energy's text: the paragraph after a heading of its kind, else the first that sounds like an effect,
    else what the dialect falls back to."""
    after = [told(found(page, p)) for p in (rf"(?is)<h[23](?:\s[^>]*)?>[^<]*{s}[^<]*</h[23]\s*>.*?<p(?:\s[^>]*)?>(.*?)</p\s*>" for s in sections)]
    by_title = [once(t, lambda x: F.when((F.length(x) > 15) & ~skip(x), x)) for t in after]
    paragraphs = F.transform(every(page, r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), text_of)
    by_word = first_known(paragraphs, lambda t: (F.length(t) > 20) & holds_any(F.lower(t), [w.lower() for w in words]) & ~skip(t))
    return F.coalesce(*by_title, by_word, *([fallback] if fallback is not None else []))


# -- the Japanese site


def jp_moves(page: Column, title: str) -> Column:
    """name, cost, damage, text of the moves in a section."""
    below = rf"(?:{_element('p', _ANY)}|{_element('div', _ANY, 3)})"
    blocks = every(section(page, title), rf"(?is)(<h4(?:\s[^>]*)?>.*?</h4\s*>\s*{below}?)")
    damage = "(?is)" + _element("span", r"""[^>]*class\s*=\s*["'][^"']*Text-fjalla[^"']*["'][^>]*""")
    cost = lambda head: F.array_compact(F.transform(icons(head), lambda k: F.element_at(lit_map(JP_SYMBOLS), k)))
    headed = F.transform(blocks, lambda b: F.struct(b.alias("block"), inner(b, "h4").alias("head")))
    return F.transform(
        headed,
        lambda x: F.struct(
            text_of(F.regexp_replace(x["head"], damage, "")).alias("name"),
            once(cost(x["head"]), some).alias("cost"),
            told(once(F.regexp_extract(x["head"], damage, 2), lambda d: F.nullif(d, F.lit("")))).alias("damage"),
            told(once(F.regexp_extract(x["block"], r"(?is)</h4\s*>\s*<(?:p|div~\d+)(?:\s[^>]*)?>(.*)</(?:p|div~\d+)\s*>", 1), lambda d: F.nullif(d, F.lit("")))).alias("effect"),
        ),
    )


def japanese(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Card records of Japanese pages with a name; ``url`` gives the id."""
    page, text, titles, table = F.col(html), F.col("_text"), F.col("_titles"), F.col("_table")
    rows = staged(staged(pages, html, numbered(page)), "name", inner(page, "h1")).where("name is not null").withColumn("name", text_of(F.col("name")))
    web_id = prefixed_id("jp", first(F.col(url), r"/card/(\d+)"))
    rows = staged(staged(rows, "_text", text_of(page)), "_titles", headings(page))
    kind = supertype(text, F.col("name"), F.endswith("name", F.lit("エネルギー")), titles, ["ワザ", "特性"])
    rows = staged(rows.withColumn("webCardId", web_id), "supertype", kind)
    own = F.col("supertype") == "POKEMON"
    only = lambda c: F.when(own, c)
    rows = staged(staged(staged(rows, "_table", only(inner(page, "table"))), "_attacks", only(jp_moves(page, "ワザ"))), "_abilities", only(jp_moves(page, "特性")))
    bare = F.regexp_replace(page, r"(?is)<table~(\d+)\b.*?</table~\1\s*>", "")
    top = inner(page, "div", "td-r")
    rows = staged(staged(rows, "_cells", cells(table)), "_headers", table_headers(table))
    attacks, abilities = F.col("_attacks"), F.col("_abilities")
    weak, resists, retreats = (F.get("_cells", F.lit(i)) for i in range(3))
    has = lambda title: F.array_contains("_headers", title)
    rows = staged(rows, "_file", F.lower(F.regexp_extract(page, r'(?is)<img\b[^>]*\bsrc\s*=\s*["\'][^"\']*/rarity/(?:[^"\']*/)?([^"\'/?#]+)', 1)))
    file = F.col("_file")
    part = F.regexp_extract(file, r"^ic_rare_([^_.]+)", 1)
    rows = staged(rows, "_rarity", F.coalesce(F.element_at(lit_map(RARITY_FILES), file), F.when((part != "") & ~part.rlike(r"^\d+$"), F.upper(part))))
    rarity = F.col("_rarity")
    code = F.coalesce(F.nullif(F.trim(F.regexp_extract(page, rf'(?is)<img\b(?=[^>]*{_class("img-regulation")})[^>]*\balt\s*=\s*["\']([^"\']*)', 1)), F.lit("")), first(page, r'(?is)<a\b[^>]*\bhref\s*=\s*["\']/ex/([^/"\']+)/'))
    rows = staged(rows, "_image", first(page, r'(?is)<img\b[^>]*\bsrc\s*=\s*["\']([^"\']*/card_images/large/[^"\']*)'))
    image = F.col("_image")
    links = every(F.regexp_extract(section(page, "進化"), r"(?is)^\s*((?:<div~(\d+)[^>]*evolution[^>]*>.*?</div~\2\s*>\s*)*)", 1), r"(?is)<a\b[^>]*>(.*?)</a\s*>")
    evolves = F.filter(F.transform(links, text_of), lambda x: F.length(x) > 1)
    subtype = (
        F.when(own, None)
        .when(F.col("supertype") == "ENERGY", F.when(F.contains(text, F.lit("基本")), "BASIC_ENERGY").otherwise("SPECIAL_ENERGY"))
        .when(holds_any(titles, ["ポケモンのどうぐ"]), "TOOL").when(holds_any(titles, ["スタジアム"]), "STADIUM").when(holds_any(titles, ["サポート"]), "SUPPORTER").otherwise("ITEM")
    )
    notice = lambda t: holds_any(t, JP_NOTICES) | t.rlike("^(高さ|重さ)")
    paragraphs = F.transform(every(page, r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), text_of)
    told_effect = effect(page, JP_SECTIONS, JP_WORDS, notice, first_known(paragraphs, lambda t: (F.length(t) > 30) & ~notice(t)))
    height, weight = (F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in (r"高さ：[\d.]+\s*m", r"重さ：[\d.]+\s*kg"))
    described = F.trim(F.regexp_replace(F.regexp_replace(text_of(F.regexp_extract(page, r"(?is)<h4(?:\s[^>]*)?>.*?</h4\s*>\s*<p(?:\s[^>]*)?>(.*?)</p\s*>", 1)), r"高さ：[\d.]+\s*m|重さ：[\d.]+\s*kg", ""), r"\s+", " "))
    spaced = lambda c: F.regexp_replace(c, r"([\d.]+)\s*(m|kg)$", "$1 $2")
    flavor = F.nullif(F.concat_ws(" ", spaced(height), spaced(weight), F.nullif(described, F.lit(""))), F.lit(""))
    name = F.col("name")
    boxes = [F.when(name.rlike(p), F.lit(f"{b} rule applies")) for b, p in {**RULE_BOXES, "RADIANT": "^かがやく"}.items()]
    rules = F.array_compact(F.array(*boxes, F.when(F.contains(text, F.lit("ACE SPEC")), F.lit(ACE))))
    mega = F.when(name.rlike(r"M([^a-z]|$)"), "MEGA")
    bench = F.exists(abilities, lambda a: F.contains(a["effect"], F.lit(JP_BENCH)))
    by_name = rule_box(name, "^かがやく", F.lit(None).cast("array<struct<name:string>>"), abilities, F.lit(False))
    rows = staged(rows, "_number", collector_number(page, text, promos=True))
    number = F.col("_number")
    out = rows.select(
        "webCardId", "name", F.lit("JA_JP").alias("language"), F.lit("JP").alias("region"), "supertype", subtype.alias("subtype"),
        variant_of(rarity, number, VARIANTS).alias("variantType"), rarity.alias("rawRarity"), F.coalesce(F.element_at(lit_map(RARITIES), rarity), F.lit("COMMON")).alias("rarity"),
        F.coalesce(F.lower(code), F.lit("promo")).alias("expansionCode"), number.alias("collectorNumber"), F.lit(None).cast("string").alias("regulationMark"),
        only(hp(text)).alias("hp"), only(F.coalesce(first_icon(top), first_icon(bare))).alias("type"),
        only(F.coalesce(F.element_at(lit_map(JP_STAGES), text_of(inner(page, "span", "type"))), F.lit("BASIC"))).alias("evolutionStage"),
        only(once(F.array_join(F.slice(evolves, 1, 5), ", "), lambda t: F.nullif(t, F.lit("")))).alias("evolvesTo"),
        F.coalesce(by_name, mega, F.when(own, rule_box(name, "^かがやく", attacks, abilities, bench))).alias("ruleBox"),
        first(text_of(F.coalesce(F.nullif(F.regexp_extract(page, rf"(?is)<div[^>]*{_class('card')}[^>]*>.*?<h4(?:\s[^>]*)?>(.*?)</h4", 1), F.lit("")), inner(page, "h4"))), r"No\.(\d+)").try_cast("int").alias("pokedexNumber"),
        only(F.when(has("弱点"), first_known(icons(weak)))).alias("weakness"), only(F.when(has("弱点") & F.contains(text_of(weak), F.lit("×2")), "×2")).alias("weaknessValue"),
        only(F.when(text_of(resists) != "--", first_known(icons(resists)))).alias("resistance"), only(F.when((text_of(resists) != "--") & (text_of(resists) != ""), text_of(resists))).alias("resistanceValue"),
        only(F.when(has("にげる"), F.nullif(F.size(icons(retreats)), F.lit(0)))).alias("retreatCost"),
        attacks.alias("attacks"), F.transform(abilities, lambda a: F.struct(a["name"].alias("name"), a["effect"].alias("description"))).alias("abilities"),
        F.when(~own, told_effect).alias("effectText"), only(flavor).alias("flavorText"), once(rules, some).alias("rules"),
        F.when(F.startswith(image, F.lit("/")), F.concat(F.lit("https://www.pokemon-card.com"), image)).otherwise(image).alias("imageUrl"),
        told(F.nullif(F.regexp_extract(page, r"(?is)<h5(?:\s[^>]*)?>\s*イラストレーター\s*</h5\s*>.*?<p(?:\s[^>]*)?>.*?<a\b[^>]*>(.*?)</a", 1), F.lit(""))).alias("illustrator"),
        F.col(url).alias("sourceUrl"),
    )
    return out


# -- the Asian sites


def skills(page: Column) -> Column:
    """name, cost, damage, effect of every skill on the page."""
    blocks = every(F.regexp_extract(page, rf"(?is)<div[^>]*{_class('skillInformation')}[^>]*>(.*)", 1), "(?is)" + _element("div", rf"[^>]*{_class('skill')}[^>]*"), 2)
    named = F.filter(F.transform(blocks, lambda b: F.struct(b.alias("block"), inner(b, "span", "skillName").alias("name"))), lambda x: x["name"].isNotNull())
    cost = lambda b: F.array_compact(F.transform(sources(inner(b, "span", "skillCost")), image_symbol))
    return F.transform(
        named,
        lambda x: F.struct(
            text_of(x["name"]).alias("name"),
            once(cost(x["block"]), some).alias("cost"),
            told(inner(x["block"], "span", "skillDamage")).alias("damage"),
            told(inner(x["block"], "p", "skillEffect")).alias("effect"),
        ),
    )


def asian(pages: DataFrame, site: str, html: str = "html", url: str = "url") -> DataFrame:
    """Card records of pages of the Chinese ('hk') or English ('en') site with a name.

    The sites differ: 'hk' takes skills with a mark for abilities and reads language and region from the image; 'en' takes
    all skills without damage for abilities. Empty values and zeros become null.
    """
    hk = site == "hk"
    page, text, titles, marker = F.col(html), F.col("_text"), F.col("_titles"), F.col("_marker")
    rows = staged(staged(pages, html, numbered(page)), "_h1", inner(page, "h1")).where("_h1 is not null")
    rows = staged(staged(rows, "_marker", told(inner(F.col("_h1"), "span", "evolveMarker"))), "_h1", text_of(F.col("_h1")))
    name = F.when(marker.isNotNull(), F.trim(F.regexp_replace("_h1", r"^(基礎|1階進化|2階進化|Basic|Stage\s*1|Stage\s*2)\s*", ""))).otherwise(F.col("_h1"))
    rows = staged(staged(staged(rows, "name", name), "_text", text_of(page)), "_titles", headings(page))
    name = F.col("name")
    energy = holds_any(name, ["Energy", "能量"] if hk else ["Energy"])
    rows = staged(staged(rows, "supertype", supertype(text, name, energy, titles, ["招式", "特性"] if hk else ["Attack", "Ability"])), "_skills", skills(page))
    own = F.col("supertype") == "POKEMON"
    only = lambda c: F.when(own, c)
    marked = lambda x: holds_any(x["name"], ["[特性]", "[Ability]"])
    tera = lambda x: x["name"].isin("太晶", "テラスタル")
    bare_name = lambda x: F.replace(x["name"], F.lit("[Ability]"), F.lit(""))
    clean = lambda x: F.trim(F.replace(bare_name(x), F.lit("[特性]"), F.lit("")) if hk else bare_name(x))
    if hk:
        attacks = only(F.filter("_skills", lambda x: ~marked(x) & ~tera(x)))
        powers = only(F.filter("_skills", lambda x: marked(x) & ~tera(x)))
        bench = F.exists(powers, lambda a: F.contains(a["effect"], F.lit(HK_BENCH)))
    else:
        attacks = only(F.filter("_skills", lambda x: x["damage"].isNotNull()))
        powers = only(F.filter("_skills", lambda x: x["damage"].isNull()))
        bench = F.exists(powers, lambda a: F.contains(a["effect"], F.lit("As long as this Pokémon is on your Bench")) & F.contains(a["effect"], F.lit("prevent all damage")))
    abilities = F.transform(powers, lambda x: F.struct(clean(x).alias("name"), x["effect"].alias("description")))
    rows = staged(rows, "_image", first(page, r'(?is)<img\b[^>]*\bsrc\s*=\s*["\']([^"\']*/card-img/[^"\']*)'))
    image = F.col("_image")
    english = F.lit(True) if not hk else F.coalesce(F.contains(image, F.lit("/hk-en/")), F.lit(False))
    number = F.coalesce(first(image, r"en(\d+)\.png" if not hk else r"(?:hk|default)(\d+)\.png"), first(F.col(url), r"/(?:detail|card)/(\d+)")).try_cast("int").cast("string")
    rows = staged(rows, "_number", number)
    number = F.col("_number")
    rarity_file = F.regexp_extract(page, r'(?is)<img\b[^>]*\bsrc\s*=\s*["\'][^"\']*/rarity/(?:[^"\']*/)?ic_rare_([^"\'/?.]+)', 1)
    header = "Rarity|稀有度" if hk else "Rarity"
    rarity = F.coalesce(F.upper(once(rarity_file, lambda x: F.nullif(x, F.lit("")))), F.upper(told(inner(page, "span", "rarity"))), F.upper(told(once(F.regexp_extract(page, rf"(?is)<th~\d+{_ANY}>[^<]*(?:{header})[^<]*</th~\d+\s*>\s*{_element('td', _ANY)}", 2), lambda x: F.nullif(x, F.lit(""))))))
    rows = staged(rows, "_rarity", rarity)
    rarity = F.col("_rarity")
    symbol = F.regexp_extract(inner(page, "span", "expansionSymbol"), r"expansion_mark_([A-Za-z0-9]+)\.png", 1)
    logo = F.trim(F.regexp_extract(page, rf'(?is)<img\b(?=[^>]*{_class("img-regulation")})[^>]*\balt\s*=\s*["\']([^"\']*)', 1))
    column = F.regexp_extract(inner(page, "section", "expansionColumn"), r'(?is)<img\b[^>]*\bsrc\s*=\s*["\'](?:[^"\']*/)?([A-Za-z0-9]+?)(?:_exp)?\.png', 1)
    known = lambda c, *empty: once(c, lambda x: F.when(~x.isin("", *empty), x))
    code = F.coalesce(known(F.regexp_extract(page, r"expansionCodes=([A-Za-z0-9]+)", 1)), known(symbol), known(logo, "expansion"), known(column, "expansion"))
    mark = F.coalesce(*[once(told(inner(page, "span", c)), lambda t: F.when(t.rlike(r"^\p{L}$"), F.upper(t))) for c in ("alpha", "regulationMark")])
    stage = F.coalesce(F.element_at(lit_map(MARKER_STAGES), marker), *[F.when(F.contains(marker, F.lit(w)), v) for w, v in MARKER_WORDS.items()], F.lit("BASIC"))
    rows = staged(staged(rows, "_main", only(F.get(sources(inner(page, "p", "mainInfomation")), F.lit(0)))), "_table", only(inner(page, "table")))
    main = F.col("_main")
    bare = F.regexp_replace(page, r"(?is)<table~(\d+)\b.*?</table~\1\s*>", "")
    rows = staged(rows, "_weak", F.regexp_extract("_table", "(?is)" + _element("td", rf"[^>]*{_class('weakpoint')}[^>]*"), 2))
    weak = F.col("_weak")
    escape = F.regexp_extract("_table", "(?is)" + _element("td", rf"[^>]*{_class('escape')}[^>]*"), 2)
    upper = F.upper("name")
    if hk:
        boxes = [(holds_any(upper, ["EX", "ＥＸ"]), "EX"), (holds_any(upper, ["GX", "ＧＸ"]), "GX"), (holds_any(upper, ["V-UNION"]), "V_UNION"), (holds_any(upper, ["VSTAR", "ＶＳＴＡＲ"]), "VSTAR"), (holds_any(upper, ["VMAX", "ＶＭＡＸ"]), "VMAX"), (upper.rlike("( V|Ｖ)$"), "V"), (holds_any(upper, ["RADIANT", "光輝"]), "RADIANT"), (holds_any(upper, ["ULTRA BEAST", "異獸"]), "ULTRA_BEAST")]
        named = F.coalesce(*[F.when(c, b) for c, b in boxes])
        box = F.coalesce(named, F.when(F.coalesce(bench, F.lit(False)) | F.coalesce(F.exists(attacks, lambda a: holds_any(a["name"], ["太晶", "Tera"])), F.lit(False)), "TERA"))
    else:
        box = rule_box(name, "^Radiant", attacks, abilities, bench)
    basic = holds_any(text, ["基本", "Basic"] if hk else ["Basic"])
    words = {"TOOL": ["Tool", "道具"], "STADIUM": ["Stadium", "競技場"], "SUPPORTER": ["Supporter", "支援者"]}
    kinds = [F.when(holds_any(titles, w if hk else w[:1]), k) for k, w in words.items()]
    shielded = F.exists("_skills", lambda x: tera(x) | F.contains(x["effect"], F.lit(HK_BENCH)))
    subtype = F.when(own, F.when(F.coalesce(shielded, F.lit(False)) & F.lit(hk), "TERA")).when(F.col("supertype") == "ENERGY", F.when(basic, "BASIC_ENERGY").otherwise("SPECIAL_ENERGY")).otherwise(F.coalesce(*kinds, F.lit("ITEM")))
    measured = lambda t: F.lower(t).rlike("身高:|體重:|height:|weight:") | t.rlike("^(身高|體重|Height|Weight)")
    told_effect = effect(page, HK_SECTIONS, HK_WORDS, measured, F.get("_skills", F.lit(0))["effect"]) if hk else effect(page, [], EN_WORDS, lambda t: F.lower(t).rlike("height:|weight:"))
    rows = staged(rows, "_extra", only(inner(page, "div", "extraInformation")))
    extra = F.col("_extra")
    flavor = F.nullif(F.concat_ws(" ", told(inner(extra, "p", "size")), told(inner(extra, "p", "discription"))), F.lit(""))
    evolves = F.array_compact(F.transform(every(inner(page, "div", "evolution"), r"(?is)<a\b[^>]*>(.*?)</a\s*>"), told))
    folder = F.when(english, "hk-en").otherwise("hk")
    return rows.select(
        F.concat(F.when(english, "en").otherwise("hk"), number).alias("webCardId"), "name", F.when(english, "EN_US").otherwise("ZH_TW").alias("language"), F.when(english, "EN").otherwise("HK").alias("region"),
        "supertype", subtype.alias("subtype"), F.when(rarity.isin(VARIANTS), rarity).otherwise("NORMAL").alias("variantType"), rarity.alias("rawRarity"),
        F.coalesce(F.element_at(lit_map({**RARITIES, "TR": "TRAINER_RARE"}), rarity), F.lit("COMMON")).alias("rarity"), F.lower(code).alias("expansionCode"), collector_number(page, text, promos=False).alias("collectorNumber"),
        mark.alias("regulationMark"), only(once(hp(text), lambda n: F.nullif(n, F.lit(0)))).alias("hp"), only(F.coalesce(image_type(main), first_icon(bare))).alias("type"), only(stage).alias("evolutionStage"),
        only(once(F.array_join(evolves, ", "), lambda t: F.nullif(t, F.lit("")))).alias("evolvesTo"), only(box).alias("ruleBox"), only(first(text_of(extra), r"No\.?\s*(\d+)").try_cast("int")).alias("pokedexNumber"),
        only(image_type(F.get(sources(weak), F.lit(0)))).alias("weakness"), only(F.when(F.contains(text_of(weak), F.lit("×2")), "×2")).alias("weaknessValue"),
        only(once(F.size(sources(escape)), lambda n: F.nullif(n, F.lit(0)))).alias("retreatCost"), once(attacks, some).alias("attacks"), once(abilities, some).alias("abilities"), F.when(~own, told_effect).alias("effectText"), only(flavor).alias("flavorText"),
        F.when(F.startswith(image, F.lit("/")), F.concat(F.lit("https://asia.pokemon-card.com"), image)).otherwise(image).alias("imageUrl"),
        F.concat(F.lit("https://asia.pokemon-card.com/"), folder, F.lit("/card-search/detail/"), number, F.lit("/")).alias("sourceUrl"),
    )


def card_url(site: str, digits: Column) -> Column:
    """The address of a card's page."""
    if site == "jp":
        return F.concat(F.lit("https://www.pokemon-card.com/card-search/details.php/card/"), digits)
    return F.concat(F.lit(f"https://asia.pokemon-card.com/{'hk-en' if site == 'en' else 'hk'}/card-search/detail/"), digits, F.lit("/"))


def valid(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with a name and an id, all others)."""
    sound = F.coalesce((F.col("name") != "") & (F.col("webCardId") != ""), F.lit(False))
    return cards.where(sound), cards.where(~sound)


def extracted(pages: DataFrame, sites: dict[str, str], site: str = "site") -> DataFrame:
    """Records of pages of several sites in one table: ``sites`` names the dialect of each value of ``site``."""
    parts = [japanese(pages.where(F.col(site) == k)) if d == "jp" else asian(pages.where(F.col(site) == k), d) for k, d in sites.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
