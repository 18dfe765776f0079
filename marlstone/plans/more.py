"""Queries on exports, quality, decks and prices, files and streams, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import designed, export, linking, quality, summaries
from marlstone.plans.cards import WITH, cards
from marlstone.plans.catalog import _t, query
from marlstone.sources import files
from marlstone.streaming import events as streams

# -- exports

_LEVEL = "case when p_size <= 17 then 'simple' when p_size <= 34 then 'medium' else 'complex' end"
_LEVELS = f"{WITH}, leveled as (select c.*, {_LEVEL} as complexity from cards c join part on id = p_partkey)"


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("p_size") <= 17, "simple").when(F.col("p_size") <= 34, "medium").otherwise("complex")
    return cards(spark, sf_dir).join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), level.alias("complexity")), "id")


@query(f"""{_LEVELS}, own as (select * from leveled where supertype = 'POKEMON'),
q as (select *, row_number() over (partition by language, complexity order by id * 7919 % 10007, id) as i from own), f as (select * from q where i <= case complexity when 'complex' then 12 else 24 end),
h as (select language, count(*) as have from f group by 1), l as (select o.*, row_number() over (partition by o.language order by o.id * 7919 % 10007, o.id) as i from own o where o.id not in (select id from f)),
m as (select l.* from l left join h on l.language = h.language where i <= 60 - coalesce(have, 0)), n as (select (180 - (select count(*) from f) - (select count(*) from m)) // 3 as missing),
x as (select *, row_number() over (partition by language order by id * 7919 % 10007, id) as i from leveled where supertype = 'TRAINER')
select id, language, 'quota' as part from f union all select id, language, 'refill' from m union all select id, language, 'extra' from x, n where i <= missing
""")
def balanced_sample(spark, sf_dir):
    rows = _leveled(spark, sf_dir)
    order = [F.col("id") * 7919 % 10007, F.col("id")]
    return export.balanced(rows.where("supertype = 'POKEMON'"), rows.where("supertype = 'TRAINER'"), 180, order)


@query(f"""{_LEVELS}
select id, case when id % 8 = 0 then null else 'img/' || id || '.png' end as image, case language when 'JA_JP' then 'このカードの情報をすべて JSON で書き出してください。' when 'ZH_TW' then '請以 JSON 寫出這張卡牌的所有資訊。' else 'Write out everything on this card as JSON.' end as prompt,
  name as answer_name, case language when 'JA_JP' then 'ja-JP' when 'ZH_TW' then 'zh-HK' else 'en-US' end as answer_language, coalesce(abilities like '[{{%', false) as has_abilities, complexity from leveled where id % 8 <> 0
""")
def training_samples(spark, sf_dir):
    """Samples written as messages and read back; cards without an image give none."""
    image = F.when(F.col("id") % 8 != 0, F.concat(F.lit("img/"), F.col("id").cast("string"), F.lit(".png")))
    rows = export.samples(_leveled(spark, sf_dir), image).where("done")
    back = rows.select("id", export.read_sample(F.col("sample.messages")).alias("s"), F.col("sample.metadata").alias("m"))
    return back.select("id", "s.image", "s.prompt", F.get_json_object("s.answer", "$.name").alias("answer_name"), F.get_json_object("s.answer", "$.language").alias("answer_language"), F.coalesce("m.hasAbilities", F.lit(False)).alias("has_abilities"), "m.complexity")



@query(f"""{_LEVELS} select count(*) filter (id % 8 <> 0) as n_written, count(*) filter (id % 8 = 0) as n_failed from leveled""")
def export_counts(spark, sf_dir):
    return export.export_counts(export.samples(_leveled(spark, sf_dir), F.when(F.col("id") % 8 != 0, F.concat(F.lit("i"), F.col("id").cast("string")))))


@query("select 'train' as split, count(*) as n from part where p_partkey % 10 < 8 union all select 'validation', count(*) from part where p_partkey % 10 = 8 union all select 'test', count(*) from part where p_partkey % 10 = 9")
def export_bundle(spark, sf_dir):
    """Samples written as JSON lines by split, and read back."""
    split = F.when(F.col("id") % 10 < 8, "train").when(F.col("id") % 10 == 8, "validation").otherwise("test")
    rows = export.samples(_leveled(spark, sf_dir), F.concat(F.lit("i"), F.col("id").cast("string"))).withColumn("split", split)
    path = files.scratch(spark, "bundle")
    export.write_samples(rows, path)
    return spark.read.json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("select page_id, substr(html, 1, 500) as shown from pages")
def shortened_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", export.shortened(F.col("html")).alias("shown"))


_JSON = "case event_id % 4 when 0 then '{\"name\": \"' || event_type || '\", \"hp\": ' || event_id % 9 || '}' when 1 then '{\"name\": null}' when 2 then 'broken' else '{}' end"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions (prediction, truth, lang, seconds) that are right, wrong, partial or broken."""
    e, k = F.col("event_id"), F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit('{"name": "'), "event_type", F.lit('", "hp": '), (e % 9).cast("string"), F.lit("}"))).when(k == 1, '{"name": null}').when(k == 2, "broken").otherwise("{}")
    truth = F.when(e % 7 == 0, "no json").otherwise(F.concat(F.lit('{"name": "'), F.when(e % 3 == 0, "click").otherwise(F.col("event_type")), F.lit('", "hp": '), (e % 9).cast("string"), F.lit("}")))
    return _t(spark, sf_dir, "events").select("event_id", text.alias("prediction"), truth.alias("truth"), F.when(e % 5 == 0, "ja").when(e % 5 == 1, "en").alias("lang"), F.col("value").alias("seconds"), "event_type")


_ANSWERS = f"""with a as (select event_id, event_type, {_JSON} as prediction, event_id % 7 <> 0 as has_truth, case when event_id % 3 = 0 then 'click' else event_type end as true_name, case event_id % 5 when 0 then 'ja' when 1 then 'en' end as lang, value as seconds from events),
j as (select *, event_id % 4 in (0, 1) as readable, event_id % 4 = 1 or (event_id % 4 = 0 and event_type = true_name) as same from a where has_truth)"""


@query(f"{_ANSWERS} select count(*) as n, count(*) filter (readable and same) as n_exact, round(count(*) filter (readable and same) / count(*), 6) as accuracy from j")
def exact_accuracy(spark, sf_dir):
    return quality.exact_accuracy(_answers(spark, sf_dir), "prediction", "truth", ["name", "hp"])


@query(f"{_ANSWERS} select coalesce(lang, 'unknown') as language, count(*) as n, count(*) filter (same) as n_exact, round(count(*) filter (same) / count(*), 6) as accuracy from j where readable group by 1")
def language_accuracy(spark, sf_dir):
    return quality.language_accuracy(_answers(spark, sf_dir), "prediction", "truth", ["name", "hp"], "lang")


@query(f"""{_ANSWERS} select 'name' as field, count(*) filter (event_id % 4 = 0) as n, count(*) filter (event_id % 4 = 0 and same) as n_equal, round(count(*) filter (event_id % 4 = 0 and same) / count(*) filter (event_id % 4 = 0), 6) as accuracy from j where readable
union all select 'hp', count(*) filter (event_id % 4 = 0), count(*) filter (event_id % 4 = 0), 1.0 from j where readable union all select 'artist', 0, 0, 0.0""")
def fields_accuracy(spark, sf_dir):
    return quality.fields_accuracy(_answers(spark, sf_dir), "prediction", "truth", ["name", "hp", "artist"])


@query(f"{_ANSWERS}, c as (select count(*) as n, count(*) filter (event_id % 4 in (0, 1)) as p, count(*) filter (event_id % 4 in (0, 1) and has_truth) as b from a) select n, p as n_predicted, round(100.0 * p / n, 6) as pct_predicted, b as n_both, round(100.0 * b / n, 6) as pct_both from c")
def success_rates(spark, sf_dir):
    return quality.success_rates(_answers(spark, sf_dir), "prediction", "truth")


@query(f"{_ANSWERS} select 'json_parse_error' as kind, count(*) filter (event_id % 4 > 1) as n from a union all select 'missing_name', 0 from a where false union all select 'missing_name', count(*) filter (event_id % 4 < 0) from a union all select 'missing_hp', count(*) filter (event_id % 4 = 1) from a")
def error_tally(spark, sf_dir):
    return quality.errors(_answers(spark, sf_dir), "prediction", F.col("event_id") % 4 < 2, ["name", "hp"])


@query(f"{_ANSWERS} select event_type, count(*) as n, count(*) filter (event_id % 4 = 0) as n_correct, round(avg(seconds), 6) as mean_seconds from a group by 1")
def accuracy_by_class(spark, sf_dir):
    return quality.by_class(_answers(spark, sf_dir), "event_type", F.col("event_id") % 4 == 0, F.col("seconds"))


@query("select event_id, case when event_id % 3 = 0 then 'simple' else 'medium' end as complexity from events")
def joined_complexity(spark, sf_dir):
    """Results with the complexity of their sample, medium where it is not known."""
    rows = _t(spark, sf_dir, "events").select("event_id")
    return linking.with_complexity(rows, rows.where("event_id % 3 = 0").withColumn("complexity", F.lit("simple")), "event_id")


@query("""
with s as (select event_type, 100.0 * count(*) filter (value > 10) / count(*) as success_pct, avg(value) * 100 as mean_ms, 91.0 as name_pct, 50.0 as hp_pct, 80.0 as attacks_pct from events group by 1)
select case when success_pct < 80 then 'more samples' when success_pct < 90 then 'more rounds' else 'ready' end as success, case when mean_ms > 1000 then 'smaller batches' when mean_ms > 800 then 'cheaper images' else 'fast' end as time, 'hp' as weak from s
""")
def advice(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg((100.0 * F.count_if(F.col("value") > 10) / F.count("*")).alias("success_pct"), (F.avg("value") * 100).alias("mean_ms"))
    out = quality.advice(rows.select("*", F.lit(91.0).alias("name_pct"), F.lit(50.0).alias("hp_pct"), F.lit(80.0).alias("attacks_pct")))
    return out.withColumn("weak", F.array_join("weak", ","))


@query("with p as (select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as r from orders group by 1) select count(*) as n_images, count(*) filter (n > 1) as n_multi, sum(n)::bigint as n_cards, sum(r)::bigint as n_read from p")
def two_stage_summary(spark, sf_dir):
    return quality.two_stages(_t(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@query("select 'status' as section, o_orderstatus as item, count(*)::double as value from orders group by 2 union all select 'mean price', o_orderpriority, round(avg(o_totalprice), 4) from orders group by 2")
def combined_report(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    parts = {"status": orders.groupBy("o_orderstatus").count(), "mean price": orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("x"))}
    return quality.report(parts)


@query("select 'zip' as field, count(*) as n from customer union all select 'seg', count(*) filter (c_custkey % 4 = 0) from customer union all select 'name', count(*) filter (c_custkey % 5 = 0) from customer")
def missing_fields(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.to_json(F.struct(F.when(key % 5 != 0, F.col("c_name")).alias("name"), F.when(key % 4 != 0, F.col("c_mktsegment")).alias("seg")))
    return export.missing_fields(_t(spark, sf_dir, "customer").select(text.alias("j")), "j", ["name", "seg", "zip"])


@query("select min(l_quantity) as least_l_quantity, max(l_quantity) as most_l_quantity, round(avg(l_quantity), 6) as mean_l_quantity, min(l_tax) as least_l_tax, max(l_tax) as most_l_tax, round(avg(l_tax), 6) as mean_l_tax from lineitem")
def size_ranges(spark, sf_dir):
    return export.sizes(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"])


@query("select count(*) as n, count(*) filter (doc_id % 50 = 0) as n_invalid, count(*) filter (doc_id % 20 = 0) as n_missing, count(*) < 1000 as too_few, count(*) filter (doc_id % 50 = 0) > 0 as has_invalid, count(*) filter (doc_id % 20 = 0) > count(*) * 0.1 as too_many_missing, false as passed from documents")
def validation_verdict(spark, sf_dir):
    return export.verdict(_t(spark, sf_dir, "documents"), F.col("doc_id") % 50 != 0, F.col("doc_id") % 20 != 0)


@query("select o_custkey, count(distinct o_orderstatus) as n_splits from orders group by 1 having count(distinct o_orderstatus) > 1")
def across_splits(spark, sf_dir):
    return export.across_splits(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("select o_custkey, count(*) - 1 as extra from orders where o_orderstatus = 'F' group by 1 having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return summaries.duplicates(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey")


@query("with c as (select lang, count(*) as n from documents group by 1) select min(n) as least, max(n) as most, max(n) - min(n) > 0.2 * min(n) as unbalanced from c")
def language_imbalance(spark, sf_dir):
    return summaries.imbalance(_t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")))


@query("with c as (select count(*) as n, count(*) filter (event_type = 'click') as h from events) select n, h as n_hit, n - h as n_miss, round(100.0 * h / n, 6) as pct_hit from c")
def cache_hits(spark, sf_dir):
    return quality.hit_rate(_t(spark, sf_dir, "events"), F.col("event_type") == "click")


@query("with i as (select distinct cast(regexp_replace(c_name, '\\D', '', 'g') as bigint) as id from customer) select min(id) as least, max(id) as most, array_to_string(list_sort(list(id))[1:10], ',') as first, array_to_string(list_sort(list(id))[-10:], ',') as last from i".replace("\\D", "\\D"))
def id_range(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return quality.id_range(_t(spark, sf_dir, "customer"), "c_name").select("least", "most", text("first"), text("last"))


@query("select o_custkey as key, string_agg(o_orderkey, ',' order by o_orderkey) as orders from orders group by 1")
def rows_per_key(spark, sf_dir):
    """Rows of a key as one list; a customer's orders are bounded."""
    lists = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return lists.select("key", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("orders"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) - 1 as place, round((row_number() over (partition by conv_id order by turn, role, text) - 1) / count(*) over (partition by conv_id), 6) as progress from conversations")
def progress(spark, sf_dir):
    rows = linking.progress(_t(spark, sf_dir, "conversations"), "conv_id", [F.col("turn"), F.col("role"), F.col("text")])
    return rows.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "progress")


# -- decks, tournaments, prices

_ENTRIES = "with entries as (select l_orderkey as deck, 'c' || l_partkey % 40 as card, cast(l_quantity as int) % 9 + 1 as quantity, l_partkey % 40 < 3 as basic, l_returnflag as kind from lineitem)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.col("l_partkey") % 40
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("deck"), F.concat(F.lit("c"), card.cast("string")).alias("card"), (F.col("l_quantity").cast("int") % 9 + 1).alias("quantity"), (card < 3).alias("basic"), F.col("l_returnflag").alias("kind"))


@query(f"""{_ENTRIES}, p as (select deck, card, sum(quantity) as n, bool_or(basic) as basic from entries group by all)
select deck, sum(n)::bigint as total, array_to_string(list_concat(case when sum(n) <> 60 then ['size: ' || sum(n)::bigint] else [] end, list_concat(coalesce(list_sort(list('too many: ' || card || ' (' || n::bigint || ')') filter (n > 4 and not basic)), []), coalesce(list_sort(list('banned: ' || card) filter (card in ('c7', 'c11'))), []))), '; ') as problems from p group by 1
""")
def deck_problems(spark, sf_dir):
    out = designed.deck_problems(_entries(spark, sf_dir), ["c7", "c11"])
    return out.withColumn("problems", F.array_join("problems", "; "))


@query(f"{_ENTRIES} select deck, coalesce(sum(quantity) filter (kind = 'A'), 0)::bigint as \"A\", coalesce(sum(quantity) filter (kind = 'N'), 0)::bigint as \"N\", coalesce(sum(quantity) filter (kind = 'R'), 0)::bigint as \"R\", sum(quantity)::bigint as total from entries group by 1")
def deck_counts(spark, sf_dir):
    return designed.deck_counts(_entries(spark, sf_dir), "kind", ["A", "N", "R"])


@query(f"{_ENTRIES} select deck, string_agg(quantity || ' ' || card, chr(10) order by quantity desc, card) as text from entries group by 1")
def deck_texts(spark, sf_dir):
    return designed.deck_text(_entries(spark, sf_dir))


@query(f"{_ENTRIES} select 't' || o_custkey || '/' || o_orderkey as deck, o_orderkey as source_deck, card, quantity from orders join entries on deck = o_orderkey where o_orderstatus = 'P'")
def deck_imports(spark, sf_dir):
    results = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("deck"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("tournament"), F.col("o_orderkey").cast("string").alias("placement"))
    return designed.imported_decks(results, _entries(spark, sf_dir))


@query("select coalesce(case o_orderstatus when 'F' then 'AGGRO' when 'O' then 'CONTROL' end, 'OTHER') as archetype, count(*) as n, round(100.0 * count(*) / (select count(*) from orders), 6) as pct from orders group by 1")
def meta_archetypes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "AGGRO").when(F.col("o_orderstatus") == "O", "CONTROL")
    decks = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deck"), kind.alias("archetype"))
    return designed.meta_game(decks, _entries(spark, sf_dir))[0]


@query(f"{_ENTRIES} select card, count(distinct deck) as n_decks, sum(quantity)::bigint as copies from entries group by 1 order by 2 desc, 3 desc, 1 limit 10")
def meta_cards(spark, sf_dir):
    return designed.meta_game(_t(spark, sf_dir, "orders").select(F.lit("x").alias("archetype")), _entries(spark, sf_dir))[1]


_PRICES = "with prices as (select l_partkey as card, l_suppkey as source, l_extendedprice / l_quantity as price, l_shipdate as date, case l_returnflag when 'A' then 'JPY' when 'N' then 'USD' else 'EUR' end as currency, l_orderkey, l_linenumber from lineitem)"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.when(F.col("l_returnflag") == "A", "JPY").when(F.col("l_returnflag") == "N", "USD").otherwise("EUR")
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("card"), F.col("l_suppkey").alias("source"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_shipdate").alias("date"), currency.alias("currency"), "l_orderkey", "l_linenumber")


@query(f"{_PRICES}, r as (select *, row_number() over (partition by card order by price, source) as i from prices) select card, round(min(price), 6) as lowest, round(max(price), 6) as highest, round(avg(price), 6) as average, count(*) as n, max(source) filter (i = 1) as cheapest from r group by 1")
def price_compare(spark, sf_dir):
    return designed.compared_prices(_prices(spark, sf_dir))


@query(f"{_PRICES}, d as (select card, date_diff('day', date '1970-01-01', cast(date as date)) as day, avg(price) as p from prices group by 1, 2), m as (select card, day, p, avg(p) over (partition by card order by day range between 6 preceding and current row) as a, avg(p) over (partition by card order by day range between 89 preceding and current row) as b from d) select card, count(*) as days, round(sum(p), 1) as price, round(sum(a), 1) as mean_7, round(sum(b), 1) as mean_90 from m group by 1")
def price_series(spark, sf_dir):
    """Daily prices with means over a week and a quarter, added up by card."""
    out = designed.recent_prices(_prices(spark, sf_dir), [7, 90])
    return out.groupBy("card").agg(F.count("*").alias("days"), *[F.round(F.sum(c), 1).alias(c) for c in ("price", "mean_7", "mean_90")])


@query(f"{_PRICES}, m as (select card, min(price) as least from prices group by 1) select p_partkey as card, p_retailprice as target from part join m on card = p_partkey where least < p_retailprice")
def price_alerts(spark, sf_dir):
    alerts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("card"), F.col("p_retailprice").alias("target"))
    return designed.price_alerts(alerts, _prices(spark, sf_dir))


@query(f"{_PRICES} select currency, count(*) as n, case currency when 'JPY' then round(sum(price * 0.0067), 1) when 'USD' then round(sum(price), 1) else -1 end as usd from prices group by 1")
def currency_conversion(spark, sf_dir):
    known = spark.createDataFrame([("JPY", 0.0067), ("USD", 1.0)], "currency string, rate double")
    out = designed.converted(_prices(spark, sf_dir), known, "USD")
    return out.groupBy("currency").agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("converted"), 1), F.lit(-1.0)).alias("usd"))


@query("select o_orderkey as tournament from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_orderdate between timestamp '1995-01-01' and timestamp '1997-01-01' and o_custkey in (select c_custkey from customer where contains(lower(c_name), '1'))")
def tournament_search(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tournament"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("region"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("c_custkey"))
    results = orders.select("tournament", "c_custkey").join(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("player")), "c_custkey")
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return designed.tournaments(orders, results, "F", "1-URGENT", day("1995-01-01"), day("1997-01-01"), "1").select("tournament")


@query("""
with u as (select o_custkey as owner, l_partkey as card, sum(l_quantity) as q, any_value(p_brand) as r, any_value(p_type) as k from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2),
b as (select owner, r, sum(q) as n from u group by 1, 2)
select owner, sum(q) as total, count(*) as unique, round(100.0 * count(*) / (select count(*) from part), 6) as completion, coalesce((select n from b where b.owner = u.owner and r = 'Brand#1'), 0) as brand_1 from u group by 1
""")
def collection_completion(spark, sf_dir):
    lineitem, orders, part = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    items = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("card"), F.col("l_quantity").alias("quantity"), "p_brand", "p_type")
    out = designed.collection_stats(items, "owner", "card", "p_brand", "p_type", part.select(F.col("p_partkey").alias("card")))
    return out.select("owner", "total", "unique", "completion", F.coalesce(F.try_element_at("by_rarity", F.lit("Brand#1")), F.lit(0.0)).alias("brand_1"))


# -- files


@query("select doc_id, lang, source from documents where lang = 'de'")
def partitioned_json(spark, sf_dir):
    """Rows written as JSON by language and source, and those of one folder read back."""
    path = files.scratch(spark, "json")
    files.write_by(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path, ["lang", "source"])
    return files.read_by(spark, path, "doc_id long, lang string, source string", lang="de")


@query("select l_suppkey as card, count(*) as n, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by 1")
def price_histories(spark, sf_dir):
    lists = files.price_histories(_t(spark, sf_dir, "lineitem"), "l_suppkey", ["l_shipdate", "l_extendedprice"])
    at = lambda i: F.element_at("history", i)["l_shipdate"]
    return lists.select(F.col("l_suppkey").alias("card"), F.size("history").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("select n_regionkey as batch_of, count(*) as n, case when n_regionkey = 2 then 'refused' end as error from nation group by 1")
def loaded_batches(spark, sf_dir):
    """Rows sent in batches of 100, one folder's worth of which is refused."""

    def send(rows: list[dict]) -> None:
        if any(r["n_regionkey"] == 2 for r in rows):
            raise ValueError("refused")

    nation = _t(spark, sf_dir, "nation")
    parts = [files.loaded(nation.where(F.col("n_regionkey") == k), 100, send).groupBy("error").agg(F.sum("n").alias("n")).select(F.lit(k).alias("batch_of"), "n", "error") for k in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return streams.read_events(spark, sf_dir, schema, pattern="events.parquet")


def _finished(spark: SparkSession, df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    path, checkpoint = files.scratch(spark, name), files.scratch(spark, f"{name}-state")
    (streams.run_available if mode == "append" else streams.run_complete)(df, path, checkpoint, mode).awaitTermination()
    return spark.read.parquet(path)


@query("select time_bucket(interval '15 minutes', ts) as bucket, event_type, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    return _finished(spark, streams.tumbling(_stream(spark, sf_dir), "15 minutes", ["event_type"]), "tumbling").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("with b as (select unnest([time_bucket(interval '15 minutes', ts), time_bucket(interval '15 minutes', ts) - interval '15 minutes']) as bucket, event_type from events) select bucket, event_type, count(*) as n from b group by 1, 2")
def stream_sliding(spark, sf_dir):
    return _finished(spark, streams.sliding(_stream(spark, sf_dir), "30 minutes", "15 minutes", ["event_type"]), "sliding").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


_SESSIONS = """with o as (select user_id, ts, coalesce(ts > lag(ts) over w + interval '20 minutes' or ts = lag(ts) over w + interval '20 minutes', true) as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(cast(new as int)) over (partition by user_id order by ts rows unbounded preceding) as i from o) select user_id, min(ts) as begin, max(ts) + interval '20 minutes' as "end", count(*) as n from s group by user_id, i"""


@query(_SESSIONS)
def stream_sessions(spark, sf_dir):
    out = _finished(spark, streams.sessions(_stream(spark, sf_dir), "20 minutes", "user_id"), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


@query(_SESSIONS)
def session_counts(spark, sf_dir):
    """The same on a table that is there as a whole."""
    return streams.sessions(_t(spark, sf_dir, "events"), "20 minutes", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begin", "end")})


@query("select distinct user_id from events")
def stream_once(spark, sf_dir):
    """Each user once, within a watermark longer than the table."""
    return _finished(spark, streams.once(_stream(spark, sf_dir), ["user_id"], "3650 days").select("user_id"), "once", "append")


@query("""
with e as (select user_id, case when event_type = 'purchase' then -3 else 1 end as d, row_number() over (partition by user_id order by ts, event_id) as i from events), s as (select *, sum(d) over (partition by user_id order by i) as upto from e)
select user_id, count(*) as n, greatest(5 + arg_max(upto, i), arg_max(upto, i) - min(upto))::bigint as level from s group by 1
""")
def stream_levels(spark, sf_dir):
    """A level of each user that is held at zero, with its state kept between batches."""
    rows = _stream(spark, sf_dir).withColumn("delta", F.when(F.col("event_type") == "purchase", -3).otherwise(1))
    out = _finished(spark, streams.levels(rows, "user_id", "delta", 5), "levels", "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("level", "n").alias("level"))


# -- scalars


@query("""
select p_partkey, coalesce(nullif(split_part(case when p_partkey % 3 = 0 then p_size || '/99' end, '/', 1), ''), case when p_partkey % 3 = 1 then 'F' end, nullif(regexp_extract('jp' || p_partkey, '(\\d+)$', 1), '')) as number,
  case when p_partkey % 4 = 0 then 'SECRET_RARE' else 'NORMAL' end as variant, p_brand || ' vs ' || case when p_partkey % 2 = 0 then 'Unknown' else p_name end as title, 'jp' || p_partkey as web_id, 'jpn' || p_partkey as swapped, p_partkey % 5 in (0, 1) as flag,
  p_partkey as url_id, least(1.0, greatest(0.0, case when p_partkey % 6 = 0 then 0.85 else p_size / 40.0 end)) as confidence, p_size / 40.0 < 0.7 or p_partkey % 6 = 0 and false as low
from part
""".replace(" or p_partkey % 6 = 0 and false", ""))
def scalar_ids(spark, sf_dir):
    """Numbers, ids, titles and flags of parts."""
    n = F.col("p_partkey")
    key = n.cast("string")
    web = F.concat(F.lit("jp"), key)
    number = S.collector_number(F.when(n % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("/99"))), F.when(n % 3 == 1, "F"), web)
    flag = F.when(n % 5 == 0, "1").when(n % 5 == 1, "Yes").when(n % 5 == 2, "yes")
    raw = F.when(n % 6 != 0, F.col("p_size") / 40.0)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", number.alias("number"), S.variant_of(F.lit("zz"), F.when(n % 4 == 0, "105/100").otherwise("5/100"), ["AR"]).alias("variant"), S.versus(F.col("p_brand"), F.when(n % 2 != 0, F.col("p_name"))).alias("title"),
        S.prefixed_id("jp", F.concat(F.lit("00"), key)).alias("web_id"), S.swapped_prefix(web, "jp", "jpn").alias("swapped"), S.truthy_text(flag).alias("flag"), S.url_id(F.concat(F.lit("https://x/detail/"), key, F.lit("/"))).cast("long").alias("url_id"),
        S.clamp(raw, 0.0, 1.0, 0.85).alias("confidence"), (F.col("p_size") / 40.0 < 0.7).alias("low"),
    )


@query("""
select p_partkey, (p_partkey % 3 + p_partkey % 4 + case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end + case when p_partkey % 5 = 0 then 2 else 0 end)::int as score,
  case when p_partkey % 3 + p_partkey % 4 + case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end + case when p_partkey % 5 = 0 then 2 else 0 end <= 2 then 'simple' when p_partkey % 3 + p_partkey % 4 + case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end + case when p_partkey % 5 = 0 then 2 else 0 end <= 4 then 'medium' else 'complex' end as complexity,
  round(least(1.0, 0.5 + 0.2 + case when p_partkey % 2 = 0 then 0.1 else 0 end + case when p_partkey % 3 > 0 then 0.1 else 0 end + case when p_partkey % 4 > 0 then 0.1 else 0 end), 6) as confidence, p_partkey % 2 = 0 as same_set, p_partkey % 4 = 0 as same_bag
from part
""")
def scalar_scores(spark, sf_dir):
    """Complexity, confidence and list comparisons of parts."""
    n = F.col("p_partkey")
    of_size = lambda k: F.slice(F.array(*map(F.lit, "abc")), F.lit(1), k.cast("int"))
    stage = F.when(n % 3 == 1, "STAGE_1").when(n % 3 == 2, "STAGE_2").otherwise("BASIC")
    score = S.complexity_score(of_size(n % 3), of_size(n % 4), stage, F.when(n % 5 == 0, "EX"))
    sure = S.confidence(F.col("p_name"), F.when(n % 2 == 0, 10), of_size(n % 3), of_size(n % 4))
    a, b = F.array(F.lit("x"), F.lit("y"), F.lit("")), F.when(n % 4 == 0, F.array(F.lit(""), F.lit("y"), F.lit("x"))).when(n % 2 == 0, F.array(F.lit("y"), F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return _t(spark, sf_dir, "part").select("p_partkey", score.alias("score"), S.complexity(score).alias("complexity"), F.round(sure, 6).alias("confidence"), S.same_members(a, b).alias("same_set"), S.same_multiset(a, b).alias("same_bag"))


@query("""
select event_id, case event_id % 5 when 0 then '{"a": 1}' when 1 then '{"b": 2}' when 2 then '{"c": 3}' when 3 then null else '{"e": 5}' end as json, (event_id % 7)::int as number, event_type || '|x' as members, 'CODE' as letters, 'rest of it' as rest,
  case when event_id % 2 = 0 then '0.0,0.0,100.0,100.0' else '0.0,5.0,100.0,50.0' end as box, 'hello' as decoded, case when event_id % 2 = 0 then 'a,b' else 'ab,c' end as cost from events
""")
def scalar_texts(spark, sf_dir):
    """JSON out of talk, leading numbers, lists, codes, boxes and data addresses."""
    k = F.col("event_id")
    talk = F.when(k % 5 == 0, ' {"a": 1} ').when(k % 5 == 1, 'Sure:\n```json\n{"b": 2}\n```').when(k % 5 == 2, 'It is {"c": 3}, I think').when(k % 5 == 3, "nothing here").otherwise('<think>{"d": 4}</think>{"e": 5}')
    number = S.leading_int(F.concat(F.lit(" "), (k % 7).cast("string"), F.lit("abc")))
    box = F.when(k % 2 != 0, F.array(F.lit(-3.0), F.lit(5.0), F.lit(120.0), F.lit(50.0)))
    code = S.card_code(F.lit("CODE rest of it"))
    cost = F.when(k % 2 == 0, "ab").otherwise('["ab", "c"]')
    return _t(spark, sf_dir, "events").select(
        "event_id", S.lenient_json(talk).alias("json"), number.alias("number"), F.array_join(S.csv_list(F.concat(F.lit(" "), "event_type", F.lit(" , ,x"))), "|").alias("members"), code["code"].alias("letters"), code["rest"].alias("rest"),
        F.array_join(F.transform(S.box_clamped(box), lambda x: x.cast("string")), ",").alias("box"), S.data_address(F.lit("data:text/plain;base64,aGVsbG8=")).cast("string").alias("decoded"), F.array_join(S.attack_cost(cost), ",").alias("cost"),
    )


@query("select p_partkey, case when p_partkey % 2 = 0 then '1' else '1.0' end = case when p_partkey % 4 = 0 then '1' else '1.0' end as same_text, greatest(0, 10 - 5 - p_size) || ',' || least(640, 320 + 5 + p_size) as crop from part")
def scalar_compare(spark, sf_dir):
    """Values compared as texts, and crops in pixels from boxes in per cent."""
    n, size = F.col("p_partkey"), F.col("p_size")
    a, b = F.when(n % 2 == 0, "1").otherwise("1.0"), F.when(n % 4 == 0, "1").otherwise("1.0")
    crop = S.pixel_crop(F.array(F.lit(10 / 6.4), F.lit(0.0), F.lit(50.0), F.lit(100.0)), 5 + size, F.lit(640), F.lit(480))
    return _t(spark, sf_dir, "part").select("p_partkey", S.same_text(a, b).alias("same_text"), F.concat(crop[0].cast("string"), F.lit(","), crop[2].cast("string")).alias("crop"))
