"""Battle queries: logs are written from the ``events`` table, a user's events being a battle, and read back.

The SQL never sees a line: it says of every event what the parser must find in the line that was written for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import battle, linking
from marlstone.plans.cards import WITH, cards
from marlstone.plans.catalog import _t, query

#: Lines by kind (event_id % 10) and turn (event_id // 20 % 2): A acts, B is the other one.
LINES = {
    0: ("{A}'s Turn", "{A} retreated Budew to the Bench."),
    1: ("{A} drew {n} cards.", "{A} drew a card."),
    2: ("{A} took {n} Prize cards.", "{A} took a Prize card."),
    3: ("{A} played Budew to the Bench.", "{A} played Munkidori to the Active Spot."),
    4: ("{A} attached Basic Fire Energy to Budew on the Bench.", "{A} attached Luminous Energy to Munkidori in the Active Spot."),
    5: ("{A}'s Budew used Slam on {B}'s Munkidori for 30 damage.", "{A}'s Munkidori used Mind Bend on {B}'s Budew for 120 damage."),
    6: ("{B}'s Munkidori was Knocked Out!", "{B}'s Budew was Knocked Out!"),
    7: ("{A} played Iono.", "{A} played Pikachu."),
    8: ("{A}'s Budew used Growl.", "- {A} shuffled the deck."),
    9: ("{A} discarded Iono.", "{A} evolved Budew to Roselia on the Bench."),
}
HEAD = ["Ann won the coin toss.", "Bob chose heads for the opening coin flip."]


def _line() -> Column:
    event, other = F.col("event_id"), F.floor(F.col("event_id") / 20) % 2 == 1
    ann = F.floor(F.col("event_id") / 10) % 2 == 0
    a, b = F.when(ann, "Ann").otherwise("Bob"), F.when(ann, "Bob").otherwise("Ann")
    chain = F.when(F.lit(False), "")
    for k, (x, y) in LINES.items():
        chain = chain.when(event % 10 == k, F.when(other, y).otherwise(x))
    n = (2 + event % 3).cast("string")
    return F.replace(F.replace(F.replace(chain, F.lit("{A}"), a), F.lit("{B}"), b), F.lit("{n}"), n)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """battle_id, raw_log, tournament_id: the log of each user's events, in order."""
    lines = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", _line().alias("line")).alias("x"))
    texts = lines.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("lines"))
    whole = F.array_join(F.concat(F.array(*map(F.lit, HEAD)), "lines"), "\n")
    return texts.select(F.col("user_id").alias("battle_id"), whole.alias("raw_log"), (F.col("user_id") % 5).alias("tournament_id"))


def _by_kind(values: dict[int, tuple[str, str]]) -> str:
    return "case k " + " ".join(f"when {k} then {f'case other when 1 then {y} else {x} end' if x != y else x}" for k, (x, y) in values.items()) + " end"


_same = lambda x: (x, x)
_TYPE = {0: ("null", "'RETREAT'"), 1: _same("'DRAW'"), 2: _same("'PRIZE'"), 3: _same("'PLAY_POKEMON'"), 4: _same("'ATTACH_ENERGY'"), 5: _same("'ATTACK'"), 6: _same("'KNOCKOUT'"), 7: ("'PLAY_TRAINER'", "'PLAY_POKEMON'"), 8: ("'ABILITY'", "null"), 9: ("'DISCARD'", "'EVOLVE'")}
_CARD = {0: _same("'Budew'"), 1: ("cast(2 + event_id % 3 as varchar) || ' cards'", "'1 card'"), 2: ("'Prize cards'", "'Prize card'"), 3: ("'Budew'", "'Munkidori'"), 4: ("'Basic Fire Energy'", "'Luminous Energy'"), 5: ("'Budew'", "'Munkidori'"), 6: ("'Munkidori'", "'Budew'"), 7: ("'Iono'", "'Pikachu'"), 8: _same("'Budew'"), 9: ("'Iono'", "'Roselia'")}
_TARGET = {4: ("'Budew'", "'Munkidori'"), 5: ("'Munkidori'", "'Budew'"), 9: ("null", "'Budew'")}
_COUNT = {1: ("2 + event_id % 3", "1"), 2: ("2 + event_id % 3", "1")}
# Who acts: the named player; the owner of a knocked-out unit; the player whose turn it is where no pattern names one.
_PLAYER = {k: _same("me") for k in range(10)} | {6: _same("they"), 9: ("me", "turn_of")}
#: Every action that the logs must give.
ACTIONS = f"""with e as (
  select user_id as battle_id, event_id, event_id % 10 as k, event_id // 20 % 2 as other, case event_id // 10 % 2 when 0 then 'player1' else 'player2' end as me, case event_id // 10 % 2 when 0 then 'player2' else 'player1' end as they,
    row_number() over (partition by user_id order by ts, event_id) + 1 as seq from events
), f as (
  select *, k = 0 and other = 0 as marker, sum(cast(k = 0 and other = 0 as int)) over w as turn, coalesce(last_value(case when k = 0 and other = 0 then me end ignore nulls) over w, 'player1') as turn_of
  from e window w as (partition by battle_id order by seq rows between unbounded preceding and current row)
), g as (select *, 1 + count(*) over (partition by battle_id order by seq) as id, {_by_kind(_TYPE)} as type from f where not marker),
actions as (
  select battle_id, seq, 'action-' || id as action_id, turn::bigint as turn, (row_number() over (partition by battle_id order by seq) - 1) * 200 as ts, {_by_kind(_PLAYER)} as player, type, {_by_kind(_CARD)} as card, {_by_kind(_TARGET)} as target, coalesce({_by_kind(_COUNT)}, 0) as n_cards,
    {_by_kind({3: ("'bench'", "'active'")})} as position, coalesce({_by_kind({5: ("30", "120")})}, 0) as shown_damage, {_by_kind({5: ("'Slam'", "'Mind Bend'"), 8: _same("'Growl.'")})} as move, k, other
  from g where type is not null
)
"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battle.parse(logs(spark, sf_dir))


@query(f"{ACTIONS} select battle_id, seq, action_id, turn, ts, player, type, card, target, n_cards, position, shown_damage, move from actions")
def log_parse(spark, sf_dir):
    """All actions of all logs."""
    rows = parsed(spark, sf_dir)
    return rows.select("battle_id", "seq", "action_id", "turn", "ts", "player", "type", "card", "target", F.coalesce("count", F.lit(0)).alias("n_cards"), "position", F.coalesce("damage", F.lit(0)).alias("shown_damage"), "move")


@query(f"""{ACTIONS}, m as (select battle_id, count(*) filter (marker) as n from f group by 1)
select battle_id, 'Ann' as player1, 'Bob' as player2, 'Ann vs Bob' as title, ceil(n / 2.0)::int as turn_count, '2024-01-01T00:00:00.000Z' as created_at from m
""")
def battle_list(spark, sf_dir):
    """Battles with their players, without their texts."""
    rows = battle.battles(logs(spark, sf_dir)).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    return battle.public(rows).select("battle_id", "player1", "player2", "title", "turn_count", "created_at")


@query("select distinct user_id as battle_id from events where user_id % 5 = 3")
def battle_search(spark, sf_dir):
    return battle.listed(battle.battles(logs(spark, sf_dir)), name="an", player2="bo", tournament=3).select("battle_id")


@query(f"""{ACTIONS}, u as (select battle_id, player, card, count(distinct type) as n from actions where not regexp_matches(card, '^\\d+ cards?$') and not regexp_matches(card, '^Prize cards?$') group by all)
select battle_id, player, card, case when contains(card, 'Basic') then 2 else least(3, n) end::int as quantity from u
""")
def battle_decks(spark, sf_dir):
    return battle.decks(parsed(spark, sf_dir))


@query(f"""{ACTIONS}, u as (select battle_id, player, card, count(distinct type) as n from actions where not regexp_matches(card, '^\\d+ cards?$') and not regexp_matches(card, '^Prize cards?$') group by all),
q as (select battle_id, player, card, case when contains(card, 'Basic') then 2 else least(3, n) end as n from u)
select battle_id, player, string_agg(n || ' ' || card, ', ' order by n desc, lower(card)) as list, sum(n)::bigint as total from q group by 1, 2
""")
def battle_deck_lists(spark, sf_dir):
    """Decks as texts, in order."""
    lists = battle.deck_lists(battle.decks(parsed(spark, sf_dir)))
    text = F.array_join(F.transform("cards", lambda x: F.concat(x["quantity"].cast("string"), F.lit(" "), x["card"])), ", ")
    total = F.aggregate("cards", F.lit(0).cast("long"), lambda n, x: n + x["quantity"])
    return lists.select("battle_id", "player", text.alias("list"), total.alias("total"))


#: Hand sizes: a sum that is held at zero whenever it would fall below, which is the sum less its least value so far.
_STEPS = """s as (select *, case when type in ('DRAW', 'PRIZE') then n_cards when type in ('PLAY_POKEMON', 'ATTACH_ENERGY', 'EVOLVE', 'PLAY_TRAINER', 'DISCARD') then -1 else 0 end as delta from actions),
r as (select *, sum(delta) over (partition by battle_id, player order by seq) as upto from s),
h as (select *, upto - least(0, min(upto) over (partition by battle_id, player order by seq)) as hand, greatest(0, 60 - sum(case when type = 'DRAW' then n_cards else 0 end) over (partition by battle_id, player order by seq)) as deck,
  greatest(0, 6 - sum(case when type = 'PRIZE' then n_cards else 0 end) over (partition by battle_id, player order by seq)) as prizes, sum(cast(type in ('DISCARD', 'PLAY_TRAINER') as int)) over (partition by battle_id, player order by seq) as gone from r)"""


@query(f"{ACTIONS}, {_STEPS} select battle_id, player, arg_max(deck, seq)::int as deck, arg_max(prizes, seq)::int as prizes, arg_max(hand, seq)::int as hand from h group by 1, 2")
def replay_counters(spark, sf_dir):
    return battle.counters(parsed(spark, sf_dir))


@query(f"{ACTIONS}, {_STEPS} select battle_id, (row_number() over (partition by battle_id order by seq) - 1)::int as step, player, hand::int as hand, deck::int as deck, prizes::int as prizes from h")
def replay_steps(spark, sf_dir):
    """The acting side's hand, deck and prizes after every action, from the folded boards."""
    own = lambda name: F.when(F.col("player") == "player1", F.col(f"p1_{name}")).otherwise(F.col(f"p2_{name}"))
    return battle.boards(parsed(spark, sf_dir)).select("battle_id", "step", "player", F.size(own("hand")).alias("hand"), own("deck").alias("deck"), own("prizes").alias("prizes"))


def replay_boards(spark, sf_dir):
    """The whole boards after every action; no SQL: tested against golden logs and a plain replay."""
    return battle.boards(parsed(spark, sf_dir))


query()(replay_boards)


@query(f"""{ACTIONS}, {_STEPS}, o as (select *, row_number() over (partition by battle_id order by seq) - 1 as step, count(*) over (partition by battle_id) as n from h),
p as (select battle_id, n, min(prizes) filter (player = 'player1' and step <= least(10, n - 1)) as p1 from o group by 1, 2)
select battle_id, least(10, n - 1)::int as step, round(least(10, n - 1) / n, 6) as progress, coalesce(p1, 6)::int as p1_prizes from p
""")
def replay_seek(spark, sf_dir):
    """The state at action 10, or the last one of shorter battles."""
    rows = battle.state_at(battle.boards(parsed(spark, sf_dir)), 10)
    flags = battle.view(rows, "p1").select("battle_id", F.size(F.filter("prizes", lambda x: x)).alias("p1_prizes"))
    return rows.select("battle_id", "step", F.round("progress", 6).alias("progress")).join(flags, "battle_id")


@query(f"""{ACTIONS.replace('with e as', WITH + ', e as', 1)},
names as (select distinct unnest([card, target]) as a from actions),
hits as (select a, c."webCardId" as w, row_number() over (partition by a order by list_position(['JA_JP', 'ZH_TW', 'EN_US'], c.language), c."createdAt" desc, c.id) as n from names join cards c on contains(lower(c.name), lower(a)))
select battle_id, seq, card, h.w as card_web_id, t.w as target_web_id from actions left join hits h on h.a = card and h.n = 1 left join hits t on t.a = target and t.n = 1
""")
def battle_links(spark, sf_dir):
    """Actions with the cards that their names stand for."""
    named = cards(spark, sf_dir)
    return linking.linked(parsed(spark, sf_dir), named).select("battle_id", "seq", "card", "card_web_id", "target_web_id")
