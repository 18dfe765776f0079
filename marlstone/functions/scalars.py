"""Scalar functions on columns; each is a composition of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def contains_ci(column: Column, needle: str) -> Column:
    """Literal case-insensitive containment; wildcard characters mean themselves."""
    return F.contains(F.lower(column), F.lit(needle.lower()))


def json_state(column: Column) -> Column:
    """sql_null, json_null, empty ([] or {}), invalid or value, of JSON text."""
    parsed = F.try_parse_json(column)
    return (
        F.when(column.isNull(), "sql_null")
        .when(parsed.isNull(), "invalid")
        .when(F.is_variant_null(parsed), "json_null")
        .when(F.regexp_replace(column, r"\s", "").isin("[]", "{}"), "empty")
        .otherwise("value")
    )


def has_json(column: Column, wanted: bool | None) -> Column:
    """Tri-state facet: True keeps values other than JSON null, False keeps JSON null, None keeps all rows."""
    if wanted is None:
        return F.lit(True)
    state = json_state(column)
    return state.isin("empty", "value") if wanted else state == "json_null"


def lenient_json(column: Column) -> Column:
    """JSON from text that may fence or surround it: as it is, the first fenced block, or first brace to last brace;
    ``<think>`` blocks are cut first."""
    bare = F.regexp_replace(column, r"(?s)<think>.*?</think>", "")
    fenced = F.nullif(F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.coalesce(valid(blank(bare)), valid(blank(fenced)), valid(braces), valid(F.nullif(F.regexp_extract(column, r"(?s)(\{.*\})", 1), F.lit(""))))


def leading_int(column: Column) -> Column:
    """The integer a text begins with, else null: '120' and '12abc' give 120 and 12."""
    return F.nullif(F.regexp_extract(column, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def csv_list(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def csv_member(column: Column, value: str, separator: str = ",") -> Column:
    """Exact member of a separated list after trimming; false for null."""
    return F.coalesce(F.exists(F.split(column, F.lit(separator)), lambda x: F.trim(x) == value), F.lit(False))


def signature(*parts: Column, length: int = 16) -> Column:
    """Prefix of the SHA-256 of the parts' text, missing ones as []."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("[]")) for p in parts]).cast("binary"), 256), 1, length)


def mapped(column: Column, pairs: dict[str, str], allowed: list[str]) -> Column:
    """The translation of a code, else the code itself if it is allowed, else null."""
    return F.coalesce(F.element_at(lit_map(pairs), column), F.when(column.isin(allowed), column))


def truthy_text(column: Column) -> Column:
    return F.coalesce(column.isin("1", "true", "Yes"), F.lit(False))


def collector_number(number: Column, fallback: Column, web_id: Column) -> Column:
    """Part before the slash, else the fallback, else the trailing digits of the id."""
    return F.coalesce(F.nullif(F.split_part(number, F.lit("/"), F.lit(1)), F.lit("")), fallback, F.nullif(F.regexp_extract(web_id, r"(\d+)$", 1), F.lit("")))


def complexity_score(abilities: Column, attacks: Column, stage: Column, rule_box: Column) -> Column:
    """Number of abilities and attacks, 0 to 2 for the stage, 2 for a rule box."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return size(abilities) + size(attacks) + F.when(stage == "STAGE_2", 2).when(stage == "STAGE_1", 1).otherwise(0) + F.when(rule_box.isNotNull(), 2).otherwise(0)


def complexity(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 4, "medium").otherwise("complex")


def confidence(name: Column, hp: Column, types: Column, moves: Column) -> Column:
    """0.5 and 0.1 for each of name (twice), hp, types and moves present; 1 at most."""
    tenth = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + 2 * tenth(name.isNotNull()) + tenth(hp.isNotNull()) + tenth(F.size(types) > 0) + tenth(F.size(moves) > 0))


def clamp(column: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(column, F.lit(default)), F.lit(low)), F.lit(high))


def variant_of(rarity: Column, number: Column, known: list[str]) -> Column:
    """A known rarity, else SECRET_RARE if the number is above the set's size (n/size), else NORMAL."""
    n, size = (F.split_part(number, F.lit("/"), F.lit(i)).try_cast("int") for i in (1, 2))
    return F.when(rarity.isin(known), rarity).when(n > size, "SECRET_RARE").otherwise("NORMAL")


def url_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:detail|card)/(\d+)", 1), F.lit(""))


def prefixed_id(prefix: str, digits: Column) -> Column:
    return F.concat(F.lit(prefix), digits.try_cast("int").cast("string"))


def swapped_prefix(column: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(column, F.lit(old)), F.concat(F.lit(new), F.substring(column, F.lit(len(old) + 1), F.length(column)))).otherwise(column)


def versus(a: Column, b: Column) -> Column:
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    return F.concat(name(a), F.lit(" vs "), name(b))


def box_clamped(box: Column) -> Column:
    """Box corners held within 0 to 100; the whole frame if there is none."""
    return F.coalesce(F.transform(box, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))), F.array(*map(F.lit, (0.0, 0.0, 100.0, 100.0))))


def same_members(a: Column, b: Column) -> Column:
    """Equal as sets of texts; empty members don't count."""
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    return clean(a) == clean(b)


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def card_code(column: Column) -> Column:
    """code and rest of 'CODE rest': letters and digits that begin with a letter, then what follows; null without both."""
    pattern = r"^([A-Za-z][A-Za-z0-9]*)\s+(.+)$"
    return F.when(column.rlike(pattern), F.struct(F.regexp_extract(column, pattern, 1).alias("code"), F.regexp_extract(column, pattern, 2).alias("rest")))


def data_address(column: Column) -> Column:
    """The bytes of a data address or of plain Base64."""
    return F.unbase64(F.regexp_replace(column, r"^data:[^,]*,", ""))


def attack_cost(column: Column) -> Column:
    """The symbols of a cost: the members of a JSON list, else the characters of the text."""
    listed = F.try_variant_get(F.try_parse_json(column), "$", "array<string>")
    return F.coalesce(F.when(F.startswith(F.trim(column), F.lit("[")), listed), F.filter(F.split(column, ""), lambda x: x != ""))


def same_text(a: Column, b: Column) -> Column:
    """Equal as texts: 1 and 1.0 differ."""
    return a.cast("string") == b.cast("string")


def pixel_crop(box: Column, padding: Column, width: Column, height: Column) -> Column:
    """left, top, right, bottom in pixels of a box in per cent, widened by a padding and held within the image."""
    at = lambda i, size, sign: F.least(size, F.greatest(F.lit(0), (F.round(box[i] / 100 * size) + sign * padding).cast("int")))
    return F.array(at(0, width, -1), at(1, height, -1), at(2, width, 1), at(3, height, 1))
