"""Codes of card records: enumerations in declared order, and the translations that importers accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.scalars import lit_map, mapped

# Enumerations, in the order they sort by.
LANGUAGES = ["JA_JP", "ZH_TW", "EN_US"]
SUPERTYPES = ["POKEMON", "TRAINER", "ENERGY"]
TYPES = ["COLORLESS", "DARKNESS", "DRAGON", "FAIRY", "FIGHTING", "FIRE", "GRASS", "LIGHTNING", "METAL", "PSYCHIC", "WATER"]
SUBTYPES = ["ITEM", "SUPPORTER", "STADIUM", "TOOL", "BASIC_ENERGY", "SPECIAL_ENERGY", "TERA"]
STAGES = ["BASIC", "STAGE_1", "STAGE_2"]
RULE_BOXES = ["EX", "GX", "V", "VMAX", "VSTAR", "RADIANT", "MEGA"]
RARITIES = ["COMMON", "UNCOMMON", "RARE", "DOUBLE_RARE", "ULTRA_RARE", "ILLUSTRATION_RARE", "SPECIAL_ILLUSTRATION_RARE", "HYPER_RARE", "PROMO", "AMAZING_RARE", "SHINY_RARE", "ACE_SPEC"]
VARIANTS = ["NORMAL", "REVERSE_HOLO", "HOLO", "FULL_ART", "SECRET_RARE", "PROMO", "AR", "SAR", "SSR", "SR", "UR", "MUR", "MA", "CHR", "U", "BWR", "ACE", "R", "C"]
REGIONS = ["HK", "JP", "EN"]

# Translations of imported codes.
SUPERTYPE_NAMES = {"ポケモン": "POKEMON", "トレーナーズ": "TRAINER", "エネルギー": "ENERGY"}
SUBTYPE_NAMES = {"グッズ": "ITEM", "サポート": "SUPPORTER", "スタジアム": "STADIUM", "ポケモンのどうぐ": "TOOL", "基本エネルギー": "BASIC_ENERGY", "特殊エネルギー": "SPECIAL_ENERGY"}
STAGE_NAMES = {"たね": "BASIC", "たねポケモン": "BASIC", "BASIC": "BASIC", "1進化": "STAGE_1", "STAGE_1": "STAGE_1", "2進化": "STAGE_2", "STAGE_2": "STAGE_2"}
TYPE_NAMES = {"無色": "COLORLESS", "悪": "DARKNESS", "ドラゴン": "DRAGON", "フェアリー": "FAIRY", "闘": "FIGHTING", "炎": "FIRE", "草": "GRASS", "雷": "LIGHTNING", "鋼": "METAL", "超": "PSYCHIC", "水": "WATER"}
RARITY_NAMES = {"C": "COMMON", "U": "UNCOMMON", "R": "RARE", "RR": "DOUBLE_RARE", "RRR": "ULTRA_RARE", "AR": "ILLUSTRATION_RARE", "SAR": "SPECIAL_ILLUSTRATION_RARE", "UR": "HYPER_RARE", "PROMO": "PROMO", "SR": "SHINY_RARE", "ACE": "ACE_SPEC"}
IMPORTED_VARIANTS = ["NORMAL", "REVERSE_HOLO", "HOLO", "AR", "SAR", "SSR", "SR", "UR", "MUR", "MA"]
LOCALES = {"ja-JP": "JA_JP", "zh-HK": "ZH_TW", "en-US": "EN_US"}
PLACEHOLDER = "カード検索"


def rank_of(column: Column, order: list[str]) -> Column:
    """The place of a code in its enumeration, for sorting; null for other values."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0))


def supertype(column: Column) -> Column:
    return mapped(column, SUPERTYPE_NAMES, SUPERTYPES)


def supertype_any_case(column: Column) -> Column:
    """A supertype written in any case of letters, or a translated one; null for others."""
    return supertype(F.when(F.upper(column).isin(SUPERTYPES), F.upper(column)).otherwise(column))


def subtypes(column: Column, strict: bool = False) -> Column:
    """The members with a translation (with ``strict``), or also those that are codes already; others are dropped."""
    return F.array_compact(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: mapped(x, SUBTYPE_NAMES, [] if strict else SUBTYPES)))


def stage(column: Column, supertype: Column) -> Column:
    """Only of the supertype that evolves."""
    return F.when(supertype == "POKEMON", mapped(column, STAGE_NAMES, STAGES))


def rule_box(column: Column) -> Column:
    return F.when(F.upper(column).isin(RULE_BOXES), F.upper(column))


def types(column: Column, first_only: bool = False) -> Column:
    """Translated members in order. With ``first_only`` the first member alone counts, even if it has no translation."""
    known = F.coalesce(column, F.array().cast("array<string>"))
    some = F.slice(known, 1, 1) if first_only else known
    return F.array_compact(F.transform(some, lambda x: mapped(x, TYPE_NAMES, TYPES)))


def rarity(column: Column) -> Column:
    return F.coalesce(F.element_at(lit_map(RARITY_NAMES), F.upper(column)), F.when(column.isin(RARITIES), column))


def variant(column: Column) -> Column:
    return F.when(F.upper(column).isin(IMPORTED_VARIANTS), F.upper(column)).otherwise("NORMAL")


def language(locale: Column) -> Column:
    """From a locale; unknown ones are English."""
    return F.coalesce(F.element_at(lit_map(LOCALES), locale), F.lit("EN_US"))


def locale(language: Column) -> Column:
    """To a locale; unknown languages stay as they are."""
    return F.coalesce(F.element_at(lit_map({v: k for k, v in LOCALES.items()}), language), language)


def region(column: Column) -> Column:
    return F.when(column.isin(REGIONS), column).otherwise("JP")


def import_language(column: Column) -> Column:
    return F.when(column.isin(LANGUAGES), column).otherwise("JA_JP")
