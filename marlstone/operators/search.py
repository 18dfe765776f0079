"""Faceted search with stable pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS, DEFAULT_ROWS = 100, 50


def all_of(facets: list[Column | None]) -> Column:
    """Conjunction of the facets that are set; no facet keeps every row."""
    return reduce(lambda a, b: a & b, [f for f in facets if f is not None], F.lit(True))


def any_of(facets: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, facets, F.lit(False))


def between(column: Column, low=None, high=None) -> Column | None:
    """Closed range with either bound optional; null is outside."""
    parts = [column >= low if low is not None else None, column <= high if high is not None else None]
    return all_of(parts) if any(p is not None for p in parts) else None


def patterns(column: Column, include: list[str], exclude: list[str]) -> Column:
    """Contains any of the first and none of the second."""
    has = lambda words: any_of([F.contains(column, F.lit(w)) for w in words])
    return (has(include) if include else F.lit(True)) & ~has(exclude)


def ordering(sort: str | None, direction: str | None, allowed: dict[str, Column], default: Column, key: Column) -> list[Column]:
    """Sort key by name (else the default, descending), nulls last, with a unique key behind it."""
    column = allowed.get(sort or "")
    if column is None:
        return [default.desc_nulls_last(), key]
    return [column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last(), key]


def page(df: DataFrame, order: list[Column], skip: int = 0, take: int = DEFAULT_ROWS) -> DataFrame:
    """One page; ``take`` is at most 100. Spark plans it as a top-k with offset, so no full sort is written."""
    return df.orderBy(*order).offset(max(0, skip)).limit(max(0, min(take, MOST_ROWS)))


def envelope(df: DataFrame, skip: int = 0, take: int = DEFAULT_ROWS, capped: bool = True) -> DataFrame:
    """total, skip, take, has_more of a search as one row; the cap on ``take`` counts, unless ``take`` is to count as asked
    for (``capped`` is false)."""
    took = max(0, min(take, MOST_ROWS) if capped else take)
    return df.agg(F.count("*").alias("total")).select("total", F.lit(skip).alias("skip"), F.lit(took).alias("take"), (F.lit(skip + took) < F.col("total")).alias("has_more"))


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """The row with this key, or none."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def by_code(df: DataFrame, codes: DataFrame, code_column: str, code: str, on: str) -> DataFrame:
    """Rows of the code's id; an unknown code gives no row rather than all."""
    wanted = codes.where(F.col(code_column) == F.lit(code)).select(on)
    return df.join(wanted, on, "left_semi")


def keyword(columns: list[str], text: str | None) -> Column | None:
    """Text in the columns taken together, ignoring case; blank keeps all."""
    if not text or not text.strip():
        return None
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower()))
