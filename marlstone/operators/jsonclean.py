"""Empty members removed from JSON texts of any depth, on the JVM side.

Strings are cut out first, by a pattern that reads them from the left, and stand as numbers in what is left; there, members
with empty values are found by one more pattern, whatever the strings hold, and strings are put back in the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*"'
#: A string: s, or e if it is empty, and its number; an empty list is A, a removed member ~.
_MARK = r"[se](\d+);"
_ZERO = r"-?0(?:\.0+)?(?:[eE][+-]?\d+)?"


def _joined(pieces: Column, between: Column) -> Column:
    """Pieces with one text between each and the next."""
    return F.array_join(F.zip_with(pieces, between, lambda p, b: F.concat(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _marked(json: Column) -> Column:
    names = F.transform(F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)), lambda s, i: F.concat(F.when(s == '""', "e").otherwise("s"), i.cast("string"), F.lit(";")))
    bare = F.transform(F.split(json, _STRING), lambda p: F.regexp_replace(p, r"\s+", ""))
    return F.replace(_joined(bare, names), F.lit("[]"), F.lit("A"))


def _plain(text: Column, strings: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(_MARK), F.lit(1)), lambda n: F.element_at(strings, n.cast("int") + 1))
    return _joined(F.split(F.replace(text, F.lit("A"), F.lit("[]")), _MARK), numbers)


def _struck(text: Column, falsy: bool) -> Column:
    """Members with empty values as ~."""
    values = rf"null|e\d+;|A|\{{\}}{'|false|' + _ZERO if falsy else ''}"
    return F.regexp_replace(text, rf"[se]\d+;:(?:{values})(?=[,}}]|$)", "~")


def _outside_lists(text: Column, change) -> Column:
    """The text with what lies in no list changed."""
    parts = F.split(text, r"(?=[\[\]])|(?<=[\[\]])")
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(0).alias("depth"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "[", 1).when(part == "]", -1).otherwise(0)
        return F.struct(F.concat(acc["seen"], F.array(F.greatest(acc["depth"], depth))).alias("seen"), depth.alias("depth"))

    depths = F.aggregate(parts, start, step)["seen"]
    return F.array_join(F.zip_with(parts, depths, lambda p, d: F.when(d == 0, change(p)).otherwise(p)), "")


def _depth(text: Column) -> Column:
    """How deep lists and objects lie in each other."""
    ends = F.split(F.regexp_replace(text, r"[^\[\]{}]", ""), "")
    step = lambda acc, c: F.struct((acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(acc["most"], acc["now"] + 1).alias("most"))
    return F.aggregate(ends, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def without_empty_members(json: Column, dialect: str = "jp", cascade: bool = False) -> Column:
    """A JSON text without the members of its objects whose values are empty; null where it is no JSON.

    'jp' takes null, empty texts, lists and objects as empty, and looks into lists; 'asia' takes zeros and false too, and
    leaves lists as they are. Items of lists are never removed. What is empty counts before anything is removed, so an
    object that loses all its members stays as an empty one; with ``cascade`` it goes as well, and so on upwards.
    """
    falsy = dialect == "asia"
    change = lambda t: _struck(t, falsy)
    strings = F.regexp_extract_all(json, F.lit(_STRING), F.lit(0))

    def once(text: Column) -> Column:
        struck = _outside_lists(text, change) if falsy else change(text)
        return F.replace(F.replace(F.replace(struck, F.lit("~,"), F.lit("")), F.lit(",~"), F.lit("")), F.lit("~"), F.lit(""))

    text = _marked(json)
    text = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), _depth(text))), text, lambda acc, _: once(acc)) if cascade else once(text)
    return F.when(F.try_parse_json(json).isNotNull(), _plain(text, strings))
