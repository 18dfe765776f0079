"""Battles replayed as a stream."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import battle
from marlstone.operators.replay import REPLAYED, stream_boards
from marlstone.plans.battles import ACTIONS, _STEPS, parsed
from marlstone.plans.catalog import query
from marlstone.sources import files
from marlstone.streaming import events as streams

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def several_states(spark: SparkSession):
    """The state store that has several states to a key."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def streamed(spark: SparkSession, actions: DataFrame, parts: int = 3) -> DataFrame:
    """The boards of all battles, whose actions arrive in ``parts`` files, one a batch, and end with an hour's silence."""
    folder, out, state = (files.scratch(spark, f"replay-{x}") for x in ("in", "out", "state"))
    part = F.ntile(parts).over(Window.partitionBy("battle_id").orderBy("seq"))
    dealt = actions.select("battle_id", *REPLAYED, F.timestamp_seconds("seq").alias("at"), part.alias("part"))
    dealt.write.partitionBy("part").parquet(f"{folder}-all")
    rows = spark.read.parquet(f"{folder}-all")
    for n in range(1, parts + 1):
        rows.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(folder)
    # A row of another battle much later: the time goes on, and all others end.
    rows.limit(1).drop("part").withColumns({"battle_id": F.lit(-1).cast(rows.schema["battle_id"].dataType), "at": F.lit("2000-01-01").cast("timestamp")}).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with several_states(spark):
        streams.run_available(stream_boards(stream), out, state).awaitTermination()
    return spark.read.parquet(out)


@query(f"{ACTIONS}, {_STEPS} select battle_id, (row_number() over (partition by battle_id order by seq) - 1)::int as step, player, hand::int as hand, deck::int as deck, prizes::int as prizes, (select count(distinct battle_id) from h) as n_battles from h")
def stream_replay(spark, sf_dir):
    """The acting side's hand, deck and prizes after every action, from boards that were kept between batches."""
    rows = streamed(spark, parsed(spark, sf_dir))
    own = lambda name: F.when(F.col("player") == "player1", F.col(f"p1_{name}")).otherwise(F.col(f"p2_{name}"))
    out = rows.select("battle_id", "step", "player", F.size(own("hand")).alias("hand"), own("deck").alias("deck"), own("prizes").alias("prizes"))
    return out.crossJoin(F.broadcast(rows.agg(F.countDistinct("battle_id").alias("n_battles"))))  # one row


def compared(rows: DataFrame, others: DataFrame) -> DataFrame:
    """One row: n of ``rows``, and how many rows of either table the other one lacks, equal ones counted as often as they
    stand there."""
    both = rows.withColumn("_side", F.lit(1)).unionByName(others.withColumn("_side", F.lit(-1)))
    equal = both.groupBy(rows.columns).agg(F.count_if(F.col("_side") == 1).alias("_n"), F.abs(F.sum("_side")).alias("_unlike"))
    return equal.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_unlike"), F.lit(0)).alias("n_unlike"))


@query(f"{ACTIONS} select count(*) as n, 0::bigint as n_unlike from actions")
def stream_replay_whole(spark, sf_dir):
    """All columns of the streamed boards against those of the table: how many there are, and how many are unlike."""
    # Logs are read once, for the stream and the table; boards are made once and held against each other in one count.
    folder = files.scratch(spark, "replay-actions")
    parsed(spark, sf_dir).write.parquet(folder)
    actions = spark.read.parquet(folder)
    whole = battle.boards(actions).drop("n")
    rows = streamed(spark, actions).select(whole.columns)
    return compared(rows, whole)


def _units_sql() -> str:
    """The units of both sides action by action, by recursion over a battle's actions."""
    unit = lambda n, c, k: f"{{'n': {n}, 'c': {c}, 'k': {k}}}"
    new, kind = unit("card", "0.0::double", "0"), "struct(n varchar, c double, k integer)"
    helpers, out = [], []
    for s in (1, 2):
        held = f"case when type = 'RETREAT' and a{s} is not null and player = 'player{s}' then list_append(b{s}, a{s}) else b{s} end"
        helpers += [f"coalesce(list_position(list_transform(b{s}, lambda u: u.n), x), 0) as i{s}", f"{held} as h{s}", f"list_filter(later, lambda m: list_contains(list_transform({held}, lambda u: u.n), m)) as f{s}"]
        changed = lambda where, n, c, k, s=s: f"list_transform(b{s}, lambda u, q: case when q = i{s} then {unit(n, c, k)} else u end)"
        mine, own = f"player = 'player{s}'", f"coalesce(a{s}.n = x, false)"
        j = f"case when len(f{s}) > 0 then list_position(list_transform(h{s}, lambda u: u.n), f{s}[1]) else 1 end"
        out += [
            f"""case when {mine} then case when type = 'PLAY_POKEMON' and position = 'active' then {new} when type = 'ATTACH_ENERGY' and {own} then {unit(f'a{s}.n', f'a{s}.c', f'a{s}.k + 1')} when type = 'EVOLVE' and {own} then {unit('card', f'a{s}.c', f'a{s}.k')}
              when type = 'RETREAT' or type = 'KNOCKOUT' and {own} then h{s}[{j}] else a{s} end when type = 'ATTACK' and {own} then {unit(f'a{s}.n', f'a{s}.c + shown_damage / 10', f'a{s}.k')} else a{s} end as a{s}""",
            f"""case when {mine} then case when type = 'PLAY_POKEMON' and coalesce(position, '') <> 'active' then list_append(b{s}, {new}) when type = 'ATTACH_ENERGY' and not {own} and i{s} > 0 then {changed('', 'u.n', 'u.c', 'u.k + 1')}
              when type = 'EVOLVE' and not {own} and i{s} > 0 then {changed('', 'card', 'u.c', 'u.k')} when type = 'RETREAT' or type = 'KNOCKOUT' and {own} then list_filter(h{s}, lambda u, q: q <> ({j})) when type = 'KNOCKOUT' and i{s} > 0 then list_filter(b{s}, lambda u, q: q <> i{s}) else b{s} end
              when type = 'ATTACK' and not {own} and i{s} > 0 then {changed('', 'u.n', 'u.c + shown_damage / 10', 'u.k')} else b{s} end as b{s}""",
            f"d{s} + case when not ({mine}) then 0 when type in ('PLAY_TRAINER', 'DISCARD') then 1 when type = 'KNOCKOUT' and {own} then 1 + a{s}.k when type = 'KNOCKOUT' and i{s} > 0 then 1 + b{s}[i{s}].k else 0 end as d{s}",
        ]
    ahead = ", ".join(f"case when lead(player, {n}) over w = player and lead(type, {n}) over w in ('ATTACK', 'ABILITY') then lead(card, {n}) over w end" for n in range(1, 5))
    shown = ", ".join(f"a{s}.n as p{s}_active, coalesce(a{s}.c, 0.0) as p{s}_damage, array_to_string(list_transform(b{s}, lambda u: u.n), ',') as p{s}_bench, d{s}::int as p{s}_n_discard" for s in (1, 2))
    return f"""{ACTIONS.replace('with e as', 'with recursive e as', 1)},
o as (select battle_id, row_number() over w - 1 as step, player, type, card, position, shown_damage, case when type = 'KNOCKOUT' then card else target end as x, list_filter([{ahead}], lambda m: m is not null) as later from actions window w as (partition by battle_id order by seq)),
s as (
  select distinct battle_id, -1::bigint as step, null::{kind} as a1, []::{kind}[] as b1, 0 as d1, null::{kind} as a2, []::{kind}[] as b2, 0 as d2 from o
  union all
  select battle_id, step, {', '.join(out)} from (select *, {', '.join(helpers)} from (select s.* exclude (step), o.* exclude (battle_id) from s join o on o.battle_id = s.battle_id and o.step = s.step + 1))
)
select battle_id, step::int as step, {shown} from s where step >= 0"""


@query(_units_sql())
def replay_units(spark, sf_dir):
    """The active unit, its damage, the bench and the pile of both sides after every action."""
    rows = battle.boards(parsed(spark, sf_dir))
    sides = [c for p in ("p1", "p2") for c in (F.col(f"{p}_active"), F.col(f"{p}_damage"), F.array_join(f"{p}_bench", ",").alias(f"{p}_bench"), F.col(f"{p}_n_discard"))]
    return rows.select("battle_id", "step", *sides)
