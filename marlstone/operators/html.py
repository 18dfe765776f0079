"""Fields of HTML pages by patterns, on the JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(html: Column, pattern: str) -> Column:
    return once(F.trim(F.regexp_extract(html, pattern, 1)), lambda x: F.nullif(x, F.lit("")))


def text_of(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; the common references decoded, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def fields(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, lang, n_paragraphs, n_links."""
    page = F.col(html)
    return pages.select(
        key,
        F.trim(F.regexp_extract(page, "<title>([^<]*)</title>", 1)).alias("title"),
        first(page, '<html lang="([a-z]+)"').alias("lang"),
        F.size(F.regexp_extract_all(page, F.lit("(<p>)"), F.lit(1))).cast("long").alias("n_paragraphs"),
        F.size(F.regexp_extract_all(page, F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
    )


def record(pages: DataFrame, html: str, patterns: dict[str, str], lists: dict[str, str] | None = None) -> DataFrame:
    """One column per pattern (its first group, or null) and per list pattern (all first groups): a dialect is a pair of
    dictionaries, so a region's layout is data."""
    page = F.col(html)
    one = [first(page, p).alias(k) for k, p in patterns.items()]
    many = [F.transform(F.regexp_extract_all(page, F.lit(p), F.lit(1)), lambda x: F.trim(x)).alias(k) for k, p in (lists or {}).items()]
    return pages.select(*(c for c in pages.columns if c != html), *one, *many)


def without_empty(df: DataFrame, columns: list[str], keep_zero: bool = True) -> Column:
    """The columns as JSON without nulls, empty texts, lists and objects, and (unless kept) zeros and false."""
    from pyspark.sql.types import ArrayType, BooleanType, MapType, NumericType, StringType

    def kept(name: str) -> Column:
        c, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, StringType):
            return F.nullif(c, F.lit(""))
        if isinstance(kind, (ArrayType, MapType)):
            return F.when(F.size(c) > 0, c)
        if isinstance(kind, BooleanType) and not keep_zero:
            return F.when(c, c)
        if isinstance(kind, NumericType) and not keep_zero:
            return F.when(c != 0, c)
        return c

    return F.to_json(F.struct(*[kept(c).alias(c) for c in columns]))


def offered(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """key, code: the first group of every match in a page, not empty, trimmed, each place a row."""
    codes = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("code"))
    return codes.select(key, F.trim("code").alias("code")).where("code <> ''")
