"""Queries for rows that other queries never meet: battles without a toss, empty type lists, missing lists, successes only."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import battle, imports, summaries
from marlstone.plans.battles import HEAD, logs
from marlstone.plans.cards import WITH, cards
from marlstone.plans.catalog import _t, query

#: Who a line of each kind names first, as an actor; null where no actor is read from it.
_NAMES = "case k when 0 then case other when 1 then me end when 6 then they when 8 then case other when 0 then me end when 9 then case other when 0 then me end else me end"


@query(f"""
with e as (
  select user_id as battle_id, event_id % 10 as k, event_id // 20 % 2 as other, case event_id // 10 % 2 when 0 then 'Ann' else 'Bob' end as me, case event_id // 10 % 2 when 0 then 'Bob' else 'Ann' end as they, row_number() over (partition by user_id order by ts, event_id) as seq from events
), a as (select battle_id, {_NAMES} as name, min(seq) as pos from e group by 1, 2), p as (select battle_id, list(name order by pos) filter (name is not null) as names from a group by 1)
select battle_id, case when battle_id % 3 <> 1 then 'Ann' when len(names) > 1 then names[1] end as player1, case when battle_id % 3 <> 1 then 'Bob' when len(names) > 1 then names[2] end as player2,
  case battle_id % 4 when 0 then 'Bob' when 1 then 'Ann' end as winner from p
""")
def battle_players(spark, sf_dir):
    """Players of battles with and without a toss (then the first two who act), and winners where the log tells one."""
    head, k = "\n".join(HEAD) + "\n", F.col("battle_id")
    ends = F.when(k % 4 == 0, "\nBob wins.").when(k % 4 == 1, "\nBob wins.\nAnn wins.").otherwise("")
    rows = logs(spark, sf_dir).withColumn("raw_log", F.concat(F.when(k % 3 == 1, F.replace("raw_log", F.lit(head), F.lit(""))).otherwise(F.col("raw_log")), ends))
    return battle.players(battle.lines_of(rows)).select("battle_id", "player1", "player2", "winner")


@query(f"{WITH} select id, name, supertype from (select *, case when id % 4 = 0 then [] when id % 4 = 1 then null else types end as t from cards) where supertype is null or (supertype = 'POKEMON' and t is not null and len(t) = 0)")
def needs_repair_empty(spark, sf_dir):
    """Cards to be repaired where type lists are empty, missing or there."""
    n = F.col("id") % 4
    rows = cards(spark, sf_dir).withColumn("types", F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.lit(None)).otherwise(F.col("types")))
    return imports.needing_repair(rows).select("id", "name", "supertype")


@query("""
with m as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as i from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45))
select p_brand, count(*) as n, (select count(*) from m where m.p_brand = p.p_brand) as n_missing, coalesce((select string_agg(cast(p_partkey as varchar), ',' order by p_partkey) from m where m.p_brand = p.p_brand and i <= 20), '') as missing from part p group by 1
""")
def missing_by_group(spark, sf_dir):
    """For each brand the parts that were never sold in large numbers: how many, and the first twenty of them."""
    large = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    out = summaries.missing_lists(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), large, "p_partkey", "p_brand")
    return out.withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


@query("""
select event_type, count(*) as n_rows, round(100.0 * count(*) filter (value > 10) / count(*), 6) as success_pct, count(value) filter (value > 10) as n, round(avg(value) filter (value > 10), 6) as mean, min(value) filter (value > 10) as least, max(value) filter (value > 10) as most, round(median(value) filter (value > 10), 6) as median from events group by 1
""")
def timing_of_successes(spark, sf_dir):
    """Times of what succeeded, beside the share that did."""
    out = summaries.timing_of_successes(_t(spark, sf_dir, "events"), ["event_type"], "value", F.col("value") > 10)
    return out.select("event_type", "n_rows", "success_pct", "n", "mean", "least", "most", "median")
