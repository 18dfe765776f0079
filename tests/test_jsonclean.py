"""Empty members of nested JSON against a walk over the parsed value."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators.jsonclean import without_empty_members


def walk(value, dialect, cascade):
    gone = (lambda v: not v) if dialect == "asia" else (lambda v: v is None or (not isinstance(v, (bool, int, float)) and len(v) == 0))
    if isinstance(value, dict):
        if cascade:
            done = {k: walk(v, dialect, cascade) for k, v in value.items()}
            return {k: v for k, v in done.items() if not gone(v)}
        return {k: walk(v, dialect, cascade) for k, v in value.items() if not gone(v)}
    return [walk(v, dialect, cascade) for v in value] if isinstance(value, list) and dialect == "jp" else value


def made(rng, depth=0):
    kind = rng.random()
    if depth < 5 and kind < 0.35:
        return {rng.choice(["a", "b", "", "s1;", 'q"', "x,", "漢", "e0;:null", "~"]) + str(i % 3 * i): made(rng, depth + 1) for i in range(rng.randrange(4))}
    if depth < 5 and kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, "", 0, 0.0, -0.0, False, True, 1, 10, 0.5, "x", ":null", '"', "\\", '\\"', "[]", "{}", ",", "A", "~", "e1;", "[", "}", " ", "\n", "0", "1e5", 100000.0, 1e300])


@pytest.mark.parametrize("dialect", ["jp", "asia"])
@pytest.mark.parametrize("cascade", [False, True])
def test_against_a_walk(spark, dialect, cascade):
    rng = random.Random(len(dialect) + cascade)
    values = [made(rng) for _ in range(400)] + [{"s": {"a": ""}, "l": [{"a": ""}]}, {}, [], "", 0, None]
    texts = [json.dumps(v, ensure_ascii=i % 2 > 0, indent=i % 3 or None) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", without_empty_members(F.col("t"), dialect, cascade).alias("t"))
    for r in df.collect():
        assert json.loads(r.t) == walk(json.loads(texts[r.i]), dialect, cascade), (texts[r.i], r.t)


def test_order_numbers_and_what_is_no_json(spark):
    df = spark.createDataFrame([('{"b": 1.50, "a": 0e3, "c": "", "d": "\\u00e9"}',), ("{broken",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(without_empty_members(F.col("t"), "jp"), without_empty_members(F.col("t"), "asia")).collect()]
    assert got == [('{"b":1.50,"a":0e3,"d":"\\u00e9"}', '{"b":1.50,"d":"\\u00e9"}'), (None, None), (None, None), (None, None)]
