"""Queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import records, relations, search, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
with m as (
  select o_orderkey, c_name, n_name, r_name, o_totalprice from orders
  left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
  where o_orderpriority = '1-URGENT' and contains(lower(c_name), '7') and o_totalprice between 20000 and 400000
)
select *, (select count(*) from m) as total from m order by o_totalprice desc nulls last, o_orderkey limit 50 offset 20
""")
def facet_search_page(spark, sf_dir):
    """A page of urgent orders of customers with a 7 in their name, dearest first."""
    orders, customer, nation, region = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region"))
    rows = relations.with_dimensions(orders, [(customer, "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey"), (region, "n_regionkey", "r_regionkey")])
    facets = [F.col("o_orderpriority") == "1-URGENT", S.contains_ci(F.col("c_name"), "7"), search.between(F.col("o_totalprice"), 20000, 400000)]
    found = rows.where(search.all_of(facets)).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")
    order = search.ordering("price", "desc", {"price": F.col("o_totalprice")}, F.col("o_orderkey"), F.col("o_orderkey"))
    # The count needs the facets' tables only: nation and region are looked up, and drop no row.
    counted = relations.with_dimensions(orders, [(customer, "o_custkey", "c_custkey")]).where(search.all_of(facets))
    total = search.envelope(counted, 20, 50).select("total")
    return search.page(found, order, 20, 50).crossJoin(F.broadcast(total))  # one row


@query("select count(*) as total, 20 as skip, 50 as take, count(*) > 70 as has_more from orders where o_orderpriority = '1-URGENT'")
def page_envelope(spark, sf_dir):
    found = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return search.envelope(found, 20, 50)


@query("select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), '12') or contains(lower(c_mktsegment), 'build')")
def either_side_contains(spark, sf_dir):
    either = search.any_of([S.contains_ci(F.col("c_name"), "12"), S.contains_ci(F.col("c_mktsegment"), "build")])
    return _t(spark, sf_dir, "customer").where(either).select("c_custkey", "c_name", "c_mktsegment")


@query("select event_type, count(*) as n from events where try_cast(json_extract_string(props, '$.k') as integer) > 50 group by event_type")
def json_path_filter(spark, sf_dir):
    value = F.get_json_object("props", "$.k").try_cast("int")
    return _t(spark, sf_dir, "events").where(value > 50).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
with e as (select event_id, case event_id % 5 when 0 then null when 1 then 'null' when 2 then '[]' when 3 then '{broken' else props end as j from events),
s as (select case when j is null then 'sql_null' when not json_valid(j) then 'invalid' when json_type(try_cast(j as json)) = 'NULL' then 'json_null' when j in ('[]', '{}') then 'empty' else 'value' end as state from e)
select state, count(*) as n, count(*) filter (state in ('empty', 'value')) as n_has, count(*) filter (state = 'json_null') as n_has_not from s group by state
""")
def json_null_tristate(spark, sf_dir):
    made = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 5 == 1, "null").when(F.col("event_id") % 5 == 2, "[]").when(F.col("event_id") % 5 == 3, "{broken").otherwise(F.col("props"))
    rows = _t(spark, sf_dir, "events").select(made.alias("j"))
    return rows.groupBy(S.json_state(F.col("j")).alias("state")).agg(F.count("*").alias("n"), F.count_if(S.has_json(F.col("j"), True)).alias("n_has"), F.count_if(S.has_json(F.col("j"), False)).alias("n_has_not"))


@query("select p_partkey, p_name from part where list_contains(list_transform(string_split(p_name, ' '), lambda x: trim(x)), 'widget')")
def csv_member(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(S.csv_member(F.col("p_name"), "widget", " ")).select("p_partkey", "p_name")


@query("select p_partkey, p_name, p_type from part where (contains(p_name, 'red') or contains(p_name, 'blue')) and not (contains(p_name, 'ring') or contains(p_type, 'SMALL'))")
def any_pattern_exclude(spark, sf_dir):
    kept = search.patterns(F.col("p_name"), ["red", "blue"], ["ring"]) & search.patterns(F.col("p_type"), [], ["SMALL"])
    return _t(spark, sf_dir, "part").where(kept).select("p_partkey", "p_name", "p_type")


@query("select n_nationkey, n_name from nation where n_regionkey in (select r_regionkey from region where r_name = 'NOWHERE')")
def code_lookup_empty_page(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return search.by_code(nation, region, "r_name", "NOWHERE", "n_regionkey").select("n_nationkey", "n_name")


@query("select p_partkey, p_name, p_brand from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def keyword_search(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(search.keyword(["p_name", "p_brand", "p_type"], " Brand#1 ")).select("p_partkey", "p_name", "p_brand")


@query("select l_returnflag, n_name, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all")
def left_chain(spark, sf_dir):
    lineitem, orders, customer, nation = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation"))
    rows = relations.with_dimensions(lineitem, [(orders, "l_orderkey", "o_orderkey"), (customer, "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey")])
    return rows.groupBy("l_returnflag", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 300000)")
def semi_relation(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""
select p_partkey, other from (
  select a.p_partkey, b.p_partkey as other, row_number() over (partition by a.p_partkey order by b.p_retailprice desc, b.p_partkey) as n
  from part a join part b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey
) where n <= 3
""")
def variants_topn(spark, sf_dir):
    return relations.variants(_t(spark, sf_dir, "part"), "p_brand", "p_partkey", [-F.col("p_retailprice"), F.col("p_partkey")], 3)


@query("""
with a as (select * from part where p_type = 'SMALL'), b as (select * from part where p_type <> 'SMALL')
select p_brand, p_partkey, p_size, nearest, distance from (
  select a.p_brand, a.p_partkey, a.p_size, b.p_partkey as nearest, abs(a.p_size - b.p_size) as distance,
    row_number() over (partition by a.p_partkey order by abs(a.p_size - b.p_size), b.p_partkey) as n
  from a join b on a.p_brand = b.p_brand
) where n = 1
""")
def nearest_match(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    found = relations.nearest(part.where("p_type = 'SMALL'"), part.where("p_type <> 'SMALL'"), "p_brand", "p_size", "p_size", "p_partkey", "p_partkey")
    return found.where("nearest is not null")


@query("""
with needles as (select item_id, lower(text) as needle from benchmark where text <> ''), words as (select -1 - n_nationkey as item_id, lower(right(n_name, 2)) as needle from nation)
select item_id, doc_id from (select * from needles union all select * from words) join documents on contains(lower(text), needle)
""")
def contains_join(spark, sf_dir):
    """Documents that hold a benchmark item, or one of some short texts."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    short = _t(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("item_id"), F.expr("right(n_name, 2)").alias("needle"))
    return relations.containing(_t(spark, sf_dir, "documents"), "doc_id", "text", items.unionByName(short), "item_id", "needle")


@query("""
with e as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as member from part), names as (select p_partkey as other, string_split(p_name, ' ')[1] as name from part)
select p_partkey, count(*) as n, sum(other)::bigint as total from (select distinct p_partkey, other from e join names on member = name where p_partkey <> other) group by 1
""")
def explode_edges_dedup(spark, sf_dir):
    """For each part the others whose first word is one of its words."""
    part = _t(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("o"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return relations.member_counts(part, "p_partkey", F.split("p_name", " "), names, "name", "o")


@query("""
with e as (select distinct o_orderkey, unnest([o_custkey, o_custkey + 1, o_custkey % 7]) as member from orders), names as (select c_custkey as other, unnest([c_custkey, c_custkey % 500]) as name from customer)
select distinct o_orderkey, other from e join names on member = name where o_orderkey <> other
""")
def member_edges(spark, sf_dir):
    """The pairs themselves: every customer has a name of its own and one that others share."""
    customer = _t(spark, sf_dir, "customer")
    names = customer.select(F.col("c_custkey").alias("o"), F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") % 500)).alias("name"))
    members = F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_custkey") % 7)
    return relations.member_edges(_t(spark, sf_dir, "orders"), "o_orderkey", members, names, "name", "o")


@query("select coalesce(lang, 'unknown') as key, count(*) as n from documents group by all")
def count_by_default_key(spark, sf_dir):
    return summaries.counts_by(_t(spark, sf_dir, "documents"), F.col("lang"))


@query("""
with c as (select p_brand as key, count(*) as n from part group by 1), r as (select *, row_number() over (order by n desc, key) as i from c)
select key, n from r where i <= 10 union all select 'remaining', sum(n)::bigint from r where i > 10
""")
def topn_with_rest(spark, sf_dir):
    return summaries.top_with_rest(summaries.counts_by(_t(spark, sf_dir, "part"), F.col("p_brand")), 10)


@query("select lang, count(*) as n, count(*) filter (toxic = 1) as n_toxic, round(100.0 * count(*) filter (toxic = 1) / count(*), 6) as pct_toxic, count(*) filter (quality = 1) as n_good, round(100.0 * count(*) filter (quality = 1) / count(*), 6) as pct_good from documents join labels using (doc_id) group by lang")
def conditional_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return summaries.rates(rows, ["lang"], {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1})


@query("select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'fr') as fr, count(*) filter (lang = 'es') as es from documents group by source")
def nested_counts(spark, sf_dir):
    wide = _t(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count()
    return wide.na.fill(0, ["en", "de", "fr", "es"])


@query("""
select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std_pop, round(coalesce(stddev_samp(value), 0), 6) as std_sample, min(value) as least, max(value) as most, round(median(value), 6) as median,
  case when count(value) >= 20 then list_sort(list(value))[cast(floor(count(value) * 0.95) as bigint) + 1] else max(value) end as p95
from events group by event_type
""")
def timing_stats(spark, sf_dir):
    return summaries.timing(_t(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
with r as (select d.doc_id, quality, toxic, cast(n_chars > 500 as int) as q, cast(doc_id % 7 = 0 as int) as t from documents d join labels using (doc_id)),
p as (select 'quality' as field, quality = q as e from r union all select 'toxic', toxic = t from r)
select field, count(*) as n, count(*) filter (e) as n_equal, round(100.0 * count(*) filter (e) / count(*), 6) as pct_equal from p group by field
""")
def field_accuracy(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return summaries.field_accuracy(rows, {"quality": ((F.col("n_chars") > 500).cast("int"), F.col("quality")), "toxic": ((F.col("doc_id") % 7 == 0).cast("int"), F.col("toxic"))})


@query("""
with r as (select quality, cast(n_chars > 500 as int) as a, cast(n_chars > 1500 as int) as b from documents join labels using (doc_id))
select 'quality' as field, case when a = quality and b = quality then 'both' when a = quality then 'only_first' when b = quality then 'only_second' else 'neither' end as verdict, count(*) as n from r group by 2
""")
def ab_tally(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return summaries.compared(rows, {"quality": ((F.col("n_chars") > 500).cast("int"), (F.col("n_chars") > 1500).cast("int"), F.col("quality"))})


@query("select lang, count(*) as n, count(l.doc_id) as n_covered, round(100.0 * count(l.doc_id) / count(*), 6) as pct_covered, count(*) - count(l.doc_id) as n_missing from documents d left join labels l on d.doc_id = l.doc_id group by lang")
def coverage_audit(spark, sf_dir):
    return summaries.coverage(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), "doc_id", "lang")


@query("""
with t as (select event_type, count(*) as n, round_even(100.0 * count(*) filter (value > 10) / count(*), 1) as success_pct, round_even(avg(value) filter (value > 0), 1) as mean_seconds from events group by 1)
select *, cast(rank() over (order by success_pct desc, mean_seconds nulls last) as integer) as place from t
""")
def leaderboard(spark, sf_dir):
    return summaries.leaderboard(_t(spark, sf_dir, "events"), "event_type", F.col("value") > 10, F.col("value"))


@query("""
with m as (select *, (sum(cast(role = 'assistant' as int)) over w)::bigint as turn_no, row_number() over (partition by conv_id order by turn, role, text) - 1 as id from conversations window w as (partition by conv_id order by turn, role, text rows unbounded preceding)),
k as (select *, last_value(case when role <> 'user' then role end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as speaker from m)
select conv_id, turn, turn_no, id, speaker, (row_number() over (partition by conv_id order by turn, role, text) - 1) * 200 as ts from k where role <> 'system'
""")
def running_turns(spark, sf_dir):
    """Running marker count, ids with gaps, carried speaker and a synthetic clock over what is kept."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _t(spark, sf_dir, "conversations").select(
        "*",
        F.sum((F.col("role") == "assistant").cast("int")).over(upto).alias("turn_no"),
        (F.row_number().over(order) - 1).cast("long").alias("id"),
        F.last(F.when(F.col("role") != "user", F.col("role")), ignorenulls=True).over(upto).alias("speaker"),
    )
    return rows.where("role <> 'system'").select("conv_id", "turn", "turn_no", "id", "speaker", ((F.row_number().over(order) - 1) * 200).cast("long").alias("ts"))


@query("select p_brand, p_partkey, p_name from (select *, row_number() over (partition by p_brand order by p_partkey) as n from part) where n = 1")
def first_per_group(spark, sf_dir):
    return relations.newest_per_key(_t(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")], 1).select("p_brand", "p_partkey", "p_name")


@query("""
with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id * 7919 % 10007, doc_id) as i, count(*) over (partition by lang) as n from documents where lang is not null)
select doc_id, lang, case when i <= floor(n * 0.8) then 'train' when i <= floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split from r
""")
def stratified_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return records.stratified_split(docs, ["lang"], [F.col("doc_id") * 7919 % 10007, F.col("doc_id")])


@query("""
with c as (select doc_id, lang, case when n_chars <= 500 then 'simple' when n_chars <= 2000 then 'medium' else 'complex' end as level from documents),
r as (select *, row_number() over (partition by lang, level order by doc_id * 7919 % 10007, doc_id) as i from c)
select doc_id, lang, level from r where i <= case level when 'simple' then 24 when 'medium' then 24 else 12 end
""")
def stratified_quota(spark, sf_dir):
    level = F.when(F.col("n_chars") <= 500, "simple").when(F.col("n_chars") <= 2000, "medium").otherwise("complex")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", level.alias("level"))
    return records.stratified_quota(docs, "lang", "level", {"simple": 24, "medium": 24, "complex": 12}, [F.col("doc_id") * 7919 % 10007, F.col("doc_id")])


@query("select substr(sha256(text || '|' || coalesce(lang, '[]')), 1, 16) as sig, min(doc_id) as doc_id, count(*) as n from documents group by 1 having count(*) > 1")
def signature_dedup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", S.signature(F.col("text"), F.col("lang")).alias("sig"))
    return rows.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query("""
with old as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0),
new as (select o_orderkey, case when o_orderkey % 2 = 0 then null else 'N' end as o_orderstatus, round(o_totalprice + 1, 2) as o_totalprice from orders where o_orderkey % 2 = 0 or o_orderkey % 5 = 0)
select coalesce(n.o_orderkey, o.o_orderkey) as o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) as o_orderstatus, case when n.o_orderkey is not null then n.o_totalprice else o.o_totalprice end as o_totalprice,
  case when o.o_orderkey is null then 'inserted' when n.o_orderkey is null then 'kept' else 'updated' end as outcome
from old o full join new n on o.o_orderkey = n.o_orderkey
""")
def latest_wins_upsert(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.when(F.col("o_orderkey") % 2 != 0, "N")
    new = orders.where("o_orderkey % 2 = 0 or o_orderkey % 5 = 0").select("o_orderkey", status.alias("o_orderstatus"), F.round(F.col("o_totalprice") + 1, 2).alias("o_totalprice"))
    return records.upsert(old, new, ["o_orderkey"], {"o_totalprice": "new"})


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P')")
def skip_existing(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.not_yet(_t(spark, sf_dir, "customer"), known, ["c_custkey"]).select("c_custkey", "c_name")


@query("select p_partkey, case when contains(p_name, 'ring') then 'jewel' when contains(p_name, 'bolt') or contains(p_name, 'widget') then 'hardware' else lower(p_type) end as label from part")
def rule_classify(spark, sf_dir):
    label = records.classified(F.col("p_name"), [(["ring"], "jewel"), (["bolt", "widget"], "hardware")], F.lower("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query("select o_orderkey, o_totalprice, list_filter(['price', 'status'], lambda k: (k = 'price' and o_totalprice > 400000) or (k = 'status' and o_orderstatus = 'F')) as problems from orders where o_totalprice > 400000 or o_orderstatus = 'F'")
def quarantine(spark, sf_dir):
    _, bad = records.quarantined(_t(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 400000, "status": F.col("o_orderstatus") == "F"})
    return bad.select("o_orderkey", "o_totalprice", "problems")


@query("""
with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, case when event_type = 'purchase' then -3 else 1 end as d from events),
f as (select user_id, cast(0 as bigint) as i, cast(5 as bigint) as v from (select distinct user_id from events) union all select f.user_id, e.i, greatest(0, f.v + e.d) from f join e on e.user_id = f.user_id and e.i = f.i + 1)
select user_id, max(i) as n, arg_max(v, i) as level from f group by user_id
""")
def clamped_fold(spark, sf_dir):
    """A level that starts at 5, gains 1 with each event, loses 3 with a purchase and never falls below 0."""
    from marlstone.operators.folds import clamped

    events = _t(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "purchase", -3).otherwise(1).cast("long"))
    return clamped(events, "user_id", ["ts", "event_id"], "delta", 5)


@query(r"""
select page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') as lang,
  len(regexp_extract_all(html, '<p>')) as n_paragraphs, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as n_links from pages
""")
def html_title_text(spark, sf_dir):
    from marlstone.operators.html import fields

    return fields(_t(spark, sf_dir, "pages"), "page_id", "html")


@query("select p_brand, count(distinct o_orderkey) as n_orders, count(distinct l_partkey) as n_parts, round(sum(l_extendedprice * (1 - l_discount)), 2) as value, round(min(p_retailprice), 2) as least_price, round(max(p_retailprice), 2) as most_price from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by p_brand")
def collection_stats(spark, sf_dir):
    """By brand. Rows are added up by (brand, order) and (brand, part) first, so no distinct count expands them; every line
    has its order, which is its key."""
    lineitem, part = (_t(spark, sf_dir, n) for n in ("lineitem", "part"))
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = rows.groupBy("p_brand", "l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")).groupBy("p_brand").agg(F.count("*").alias("n_orders"), F.round(F.sum("v"), 2).alias("value"))
    prices = lineitem.select("l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    parts = prices.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.round(F.min("p_retailprice"), 2).alias("least_price"), F.round(F.max("p_retailprice"), 2).alias("most_price"))
    return orders.join(parts, "p_brand")


@query("""
select l_suppkey, date_trunc('month', l_shipdate) as month, round(avg(l_extendedprice / l_quantity), 4) as price, round(avg(l_extendedprice / l_quantity) - lag(avg(l_extendedprice / l_quantity)) over (partition by l_suppkey order by date_trunc('month', l_shipdate)), 4) as change
from lineitem group by 1, 2
""")
def price_history(spark, sf_dir):
    """Mean unit price of each supplier by month and its change."""
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    means = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", month.alias("month")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    before = F.lag("p").over(Window.partitionBy("l_suppkey").orderBy("month"))
    return means.select("l_suppkey", "month", F.round("p", 4).alias("price"), F.round(F.col("p") - before, 4).alias("change"))


@query("select bucket, event_type, n from (select time_bucket(interval '15 minutes', ts) as bucket, event_type, count(*) as n from events group by 1, 2)")
def tumbling_counts(spark, sf_dir):
    from marlstone.streaming.events import tumbling

    return tumbling(_t(spark, sf_dir, "events"), "15 minutes", ["event_type"])
