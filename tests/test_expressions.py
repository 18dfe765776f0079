"""Expressions on literal rows where the standard tables have no such values."""

import json

from pyspark.sql import functions as F

from marlstone.functions import codes
from marlstone.functions import scalars as S
from marlstone.operators import dialects, facets, html, imports, records, summaries


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_without_empty(spark):
    rows = spark.createDataFrame([(0.5, "x", 0, False, "", None), (0.0, "", 3, True, "y", [1])], "a double, b string, n int, f boolean, s string, l array<int>")
    kept = [json.loads(r[0]) for r in rows.select(html.without_empty(rows, rows.columns)).collect()]
    assert kept == [{"a": 0.5, "b": "x", "n": 0, "f": False}, {"a": 0.0, "n": 3, "f": True, "s": "y", "l": [1]}]
    bare = [json.loads(r[0]) for r in rows.select(html.without_empty(rows, rows.columns, keep_zero=False)).collect()]
    assert bare == [{"a": 0.5, "b": "x"}, {"n": 3, "f": True, "s": "y", "l": [1]}]


def test_json_states(spark):
    rows = spark.createDataFrame([(None,), ("null",), ("[]",), ('[{"name": "X"}]',), ("{bad",)], "a string")
    assert [r[0] for r in rows.select(S.has_json(F.col("a"), True)).collect()] == [False, False, True, True, False]
    assert [r[0] for r in rows.select(S.has_json(F.col("a"), False)).collect()] == [False, True, False, False, False]
    assert [r[0] for r in rows.select(facets.named_object(F.col("a"), "X")).collect()] == [False, False, False, True, False]


def test_redirects():
    assert facets.redirected(facets.Request(subtypes="V", ruleBox="EX")) == facets.Request(ruleBox="V")
    assert facets.redirected(facets.Request(subtypes="BASIC", evolutionStage="STAGE_1")) == facets.Request(evolutionStage="BASIC")
    assert facets.redirected(facets.Request(subtypes="TOOL")) == facets.Request(subtypes="TOOL")


def test_codes(spark):
    kinds = F.array(F.lit("weird"), F.lit("水"), F.lit("FIRE"))
    got = one(spark, codes.types(kinds).alias("all"), codes.types(kinds, first_only=True).alias("first"), codes.stage(F.lit("たね"), F.lit("TRAINER")).alias("stage"), codes.region(F.lit("CN")).alias("region"), codes.rank_of(F.lit("RARE"), codes.RARITIES).alias("rank"))
    assert (got["all"], got["first"], got.stage, got.region, got["rank"]) == (["WATER", "FIRE"], [], None, "JP", 3)


def test_signatures_differ(spark):
    got = one(spark, *[imports.signature(F.lit("[]"), F.lit(None).cast("string"), f) for f in ("object", "bar")])
    assert got[0] != got[1] and len(got[0]) == len(got[1]) == 16


def test_split_leaves_unknown_strata_out(spark):
    rows = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 17 else None) for i in range(20)], "id int, lang string")
    counts = {(r.lang, r.split): r["count"] for r in records.stratified_split(rows, ["lang"], [F.col("id")]).groupBy("lang", "split").count().collect()}
    assert counts == {("a", "train"): 5, ("a", "test"): 2, ("b", "train"): 8, ("b", "validation"): 1, ("b", "test"): 1}


def test_timing_places(spark):
    rows = spark.range(1, 101).select(F.lit("x").alias("k"), F.col("id").alias("v")).unionByName(spark.range(1, 11).select(F.lit("y").alias("k"), F.col("id").alias("v")))
    got = {r.k: (r.p95, r.median) for r in summaries.timing(rows, ["k"], "v").collect()}
    assert got == {"x": (96, 50.5), "y": (10, 5.5)}


def test_rule_boxes(spark):
    none = F.lit(None).cast("array<struct<name:string, effect:string>>")
    box = lambda name: one(spark, dialects.rule_box(F.lit(name), "^Radiant", none, none, F.lit(False)).alias("b")).b
    assert [box(n) for n in ("Lucario EX", "Lucario ex", "Pikachu V", "Pikachu VMAX", "Radiant Eevee", "Eevee")] == ["EX", None, "V", "VMAX", "RADIANT", None]


def test_hong_kong_ladders(spark):
    page = "<h1><span class='evolveMarker'>V-UNION</span>Mewtwo ex</h1><p>HP 100</p><section class='expansionColumn'><img src='/a/M2F_exp.png'></section><table><tr><td class='weakpoint'>--</td></tr></table><div class='skillInformation'><div class='skill'><span class='skillName'>太晶</span><p class='skillEffect'>x</p></div></div>"
    r = dialects.asian(spark.createDataFrame([(page, "https://x/detail/00123/"), ("<p>none</p>", "u")], "html string, url string"), "hk").collect()
    assert len(r) == 1
    r = r[0]
    assert (r.webCardId, r.evolutionStage, r.expansionCode, r.ruleBox, r.subtype, r.attacks, r.abilities, r.retreatCost, r.weakness, r.regulationMark) == ("hk123", "V_UNION", "m2f", "EX", "TERA", None, None, None, None, None)


def test_japanese_ladders(spark):
    page = "<h1>メガルカリオM</h1><h2>ワザ</h2><h4>テラスタルパンチ</h4><a href='/ex/sv9a/x'>x</a><div class='subtext'>12/345</div>"
    r = dialects.japanese(spark.createDataFrame([(page, "https://x/card/7/")], "html string, url string")).first()
    assert (r.webCardId, r.supertype, r.expansionCode, r.collectorNumber, r.ruleBox, r.evolutionStage, r.variantType, r.effectText) == ("jp7", "POKEMON", "sv9a", "12/345", "MEGA", "BASIC", "NORMAL", None)
    assert [(a.name, a.cost, a.damage, a.effect) for a in r.attacks] == [("テラスタルパンチ", None, None, None)] and r.abilities == []
