"""Card search by request: facets, sort keys, pages with their totals, nested rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import codes
from marlstone.functions.scalars import contains_ci, csv_member, has_json
from marlstone.operators.search import DEFAULT_ROWS, all_of, between, envelope, ordering, page

#: Sort keys of a request; enumerations sort in declared order.
SORTS = {
    "id": F.col,
    "webCardId": F.col,
    "name": F.col,
    "hp": F.col,
    "createdAt": F.col,
    "updatedAt": F.col,
    "rarity": lambda c: codes.rank_of(F.col(c), codes.RARITIES),
    "supertype": lambda c: codes.rank_of(F.col(c), codes.SUPERTYPES),
    "expansionReleaseDate": F.col,
}


@dataclass(frozen=True)
class Request:
    """A search; a facet that is None, empty or (but for hp and the flags) zero filters nothing."""

    skip: int = 0
    take: int = DEFAULT_ROWS
    webCardId: str | None = None
    language: str | None = None
    expansionCode: str | None = None
    name: str | None = None
    supertype: str | None = None
    types: str | None = None
    rarity: str | None = None
    sortBy: str | None = None
    sortOrder: str | None = None
    subtypes: str | None = None
    evolutionStage: str | None = None
    ruleBox: str | None = None
    variantType: str | None = None
    minHp: int | None = None
    maxHp: int | None = None
    artist: str | None = None
    regulationMark: str | None = None
    hasAbilities: bool | None = None
    hasAttackText: bool | None = None
    evolvesTo: str | None = None
    attackName: str | None = None


def redirected(request: Request) -> Request:
    """Stages and rule boxes that are asked for as subtypes, as they once were, go to their own facets."""
    if request.subtypes in codes.STAGES:
        return replace(request, evolutionStage=request.subtypes, subtypes=None)
    if request.subtypes in codes.RULE_BOXES:
        return replace(request, ruleBox=request.subtypes, subtypes=None)
    return request


def has_member(column: Column, value: str) -> Column:
    """Null and empty arrays hold nothing."""
    return F.coalesce(F.array_contains(column, F.lit(value)), F.lit(False))


def has_any(column: Column, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False))


def named_object(column: Column, name: str, field: str = "name") -> Column:
    """Whether JSON text is an array with an object whose field is exactly ``name``."""
    members = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    return F.coalesce(F.exists(members, lambda x: F.try_variant_get(x, f"$.{field}", "string") == name), F.lit(False))


def facets(request: Request) -> list[Column | None]:
    """The predicates of a request on card columns; ``expansion_code`` is that of the regional expansion."""
    r = redirected(request)
    equal = [F.col(c) == F.lit(v) for c, v in ((n, getattr(r, n)) for n in ("webCardId", "language", "supertype", "rarity", "evolutionStage", "ruleBox", "variantType", "regulationMark")) if v]
    return [
        *equal,
        contains_ci(F.col("name"), r.name) if r.name else None,
        contains_ci(F.col("artist"), r.artist) if r.artist else None,
        has_member(F.col("types"), r.types) if r.types else None,
        has_any(F.col("subtypes"), [r.subtypes]) if r.subtypes else None,
        between(F.col("hp"), r.minHp, r.maxHp),
        F.lower("expansion_code") == r.expansionCode.lower() if r.expansionCode else None,
        has_json(F.col("abilities"), r.hasAbilities) if r.hasAbilities is not None else None,
        has_json(F.col("attacks"), r.hasAttackText) if r.hasAttackText is not None else None,
        csv_member(F.col("evolvesTo"), r.evolvesTo) if r.evolvesTo else None,
        named_object(F.col("attacks"), r.attackName) if r.attackName else None,
    ]


def found(cards: DataFrame, request: Request) -> DataFrame:
    """All cards of a request: every facet that is set holds."""
    return cards.where(all_of(facets(request)))


def sort_of(request: Request) -> list[Column]:
    """The request's order with the id behind it; an unknown key means newest first, whatever the direction asked for."""
    allowed = {k: f("expansion_release" if k == "expansionReleaseDate" else k) for k, f in SORTS.items()}
    return ordering(request.sortBy, request.sortOrder, allowed, F.col("createdAt"), F.col("id"))


def search(cards: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(the page, its envelope) of a request."""
    rows = found(cards, request)
    return page(rows, sort_of(request), request.skip, request.take), envelope(rows, request.skip, request.take)


def with_expansions(cards: DataFrame, primaries: DataFrame, regionals: DataFrame, expansions: DataFrame) -> DataFrame:
    """Cards with their primary card, regional expansion, and the primary expansion by either path (card_expansion by the
    primary card, expansion by the regional one): each null where a reference is missing.

    ``expansion_code`` and ``expansion_release`` are what requests filter and sort by. Spark broadcasts small sides.
    """
    p = primaries.select(F.col("id").alias("primaryCardId"), F.struct(*primaries.columns).alias("primary_card"))
    r = regionals.select(F.col("id").alias("regionalExpansionId"), F.struct(*regionals.columns).alias("regional"))
    both = lambda name: expansions.select(F.col("id").alias(f"_{name}"), F.struct(*expansions.columns).alias(name))
    rows = cards.join(p, "primaryCardId", "left").join(r, "regionalExpansionId", "left")
    rows = rows.withColumn("_card_expansion", F.col("primary_card.primaryExpansionId")).withColumn("_expansion", F.col("regional.primaryExpansionId"))
    rows = rows.join(both("card_expansion"), "_card_expansion", "left").join(both("expansion"), "_expansion", "left").drop("_card_expansion", "_expansion")
    return rows.withColumn("expansion_code", F.col("regional.code")).withColumn("expansion_release", F.col("card_expansion.releaseDate"))


def nested(rows: DataFrame) -> DataFrame:
    """Rows of ``with_expansions`` in the shape of an answer: primaryCard and regionalExpansion objects with their primary
    expansions, null where a reference is missing; the two expansions keep their own paths."""
    brief = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.code", f"{c}.nameEn", f"{c}.releaseDate"))
    primary = F.when(F.col("primary_card").isNotNull(), F.struct("primary_card.name", "primary_card.skillsSignature", brief("card_expansion").alias("primaryExpansion")))
    regional = F.when(F.col("regional").isNotNull(), F.struct("regional.id", "regional.code", "regional.name", "regional.region", brief("expansion").alias("primaryExpansion")))
    flat = [c for c in rows.columns if c not in ("primary_card", "regional", "card_expansion", "expansion", "expansion_code", "expansion_release")]
    return rows.select(*flat, primary.alias("primaryCard"), regional.alias("regionalExpansion"))


def name_search(cards: DataFrame, name: str, most: int = 100) -> DataFrame:
    """Up to ``most`` cards whose name holds the text, newest first."""
    return cards.where(contains_ci(F.col("name"), name)).orderBy(F.desc_nulls_last("createdAt"), "id").limit(most)


def envelope_of_page(rows: DataFrame, skip: int, take: int) -> DataFrame:
    """total and has_more by what the page really holds: skip + rows returned < total."""
    return envelope(rows, skip, take).select("total", (F.lit(skip) + F.least(F.lit(take), F.greatest(F.lit(0), F.col("total") - skip)) < F.col("total")).alias("has_more"))


def page_counts(total: Column, skip: int, take: int) -> Column:
    """The number of pages and, from 1, that of the page at ``skip``."""
    return F.struct(F.ceil(total / take).cast("long").alias("pages"), F.lit(skip // take + 1).cast("long").alias("page"))
