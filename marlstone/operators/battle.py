"""Match logs: free text to typed actions, decks, and the board after each action.

``parse`` works on lines as rows: running counts over a battle's lines give turns, ids and the player whose turn it is,
a bounded frame looks ahead for listed cards, and one chain of tests types each line. The first test that holds decides;
if its pattern then fails, the line gives no action (it does not fall through to later tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.dialects import staged
from marlstone.operators.replay import BOARD, LOOKS, REPLAYED, SIDE, Replay

# Single-word names that are played as trainers.
TRAINERS = [
    "Dawn", "Hilda", "Iono", "Arven", "Artazon", "Nest Ball", "Ultra Ball", "Rare Candy", "Energy Switch", "Air Balloon", "Buddy-Buddy Poffin", "Battle Cage", "Explorer's Guidance", "Boss's Orders",
    "Janine's Secret Art", "Team Rocket's Venture Bomb", "Thick Scale", "Luminous Energy", "Munkidori", "Tynamo", "Eelektrik", "Budew", "Froslass", "Iron Bundle", "Snorunt", "Dratini", "Dragonair",
]
#: Lines that a listing of drawn cards may follow within; cards shown for n prizes follow within n + PRIZE_AHEAD, of which
#: MOST_PRIZES is the largest n (a game has six), as windows have fixed bounds.
AHEAD, PRIZE_AHEAD, MOST_PRIZES = 9, 4, 6
VERBS = "played|drew|attached|used|took|put|discarded|retreated"
PASSIVE = "was|used|attacked|took|received"


def _got(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(line, pattern, group)), F.lit(""))


def lines_of(logs: DataFrame, battle: str = "battle_id", text: str = "raw_log") -> DataFrame:
    """battle_id, seq, line of the trimmed lines that are not empty."""
    rows = logs.select(F.col(battle).alias("battle_id"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("seq", "line"))
    return rows.select("battle_id", "seq", F.trim("line").alias("line")).where("line <> ''")


def players(lines: DataFrame) -> DataFrame:
    """battle_id, player1, player2, winner, turn_count. The winner of the coin toss is player1 and who called it player2;
    without both, the first two names that act."""
    line = F.col("line")
    last = lambda pattern: F.max_by(F.regexp_extract(line, pattern, 1), F.when(line.rlike(pattern), F.col("seq")))
    facts = lines.groupBy("battle_id").agg(
        last(r"^(\w+) won the coin toss").alias("toss"),
        last(r"^(\w+) chose (?:heads|tails)").alias("chooser"),
        last(r"(\w+)\s+wins\.?").alias("winner"),
        F.ceil(F.count_if(F.contains(line, F.lit("'s Turn"))) / 2).cast("int").alias("turn_count"),
    )
    name = F.coalesce(_got(line, rf"(?i)^(\w+)\s+(?:{VERBS})", 1), _got(line, r"(?i)^(\w+)'s\s+(?:.*?)\s+(?:was|used|attacked|took|received)", 1))
    first = staged(lines, "name", name).where("name is not null").groupBy("battle_id", "name").agg(F.min("seq").alias("at"))
    # At most a few names act in a battle.
    names = first.groupBy("battle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
    known = F.coalesce((F.col("toss") != "") & (F.col("chooser") != "") & (F.col("toss") != F.col("chooser")), F.lit(False))
    pick = lambda own, i: F.when(known, own).when(F.size("names") >= 2, F.get("names", F.lit(i)))
    return facts.join(names, "battle_id", "left").select("battle_id", pick(F.col("toss"), 0).alias("player1"), pick(F.col("chooser"), 1).alias("player2"), F.nullif("winner", F.lit("")).alias("winner"), "turn_count")


def parse(logs: DataFrame, battle: str = "battle_id", text: str = "raw_log", names_with_t: bool = False) -> DataFrame:
    """battle_id, seq, action_id, turn, ts, player, details (the line), type, card, target, count, names, position, damage, move.

    Names with a lower-case t are lost where a unit is played, as in the format's own reader; ``names_with_t`` keeps them.
    """
    lines = lines_of(logs, battle, text)
    who = players(lines).select("battle_id", "player1", "player2")
    line = F.col("line")
    ordered = Window.partitionBy("battle_id").orderBy("seq")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    setup, marker = F.contains(line, F.lit("Setup")), F.contains(line, F.lit("'s Turn")) & ~F.contains(line, F.lit("Setup"))
    rows = lines.join(who, "battle_id").withColumn("part", F.sum(setup.cast("int")).over(upto))
    turns = Window.partitionBy("battle_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.regexp_extract(line, r"(\w+)'s Turn", 1)
    side = lambda n: F.when(n == F.col("player1"), "player1").when(n == F.col("player2"), "player2")
    rows = rows.withColumn("turn", F.sum(marker.cast("int")).over(turns)).withColumn("_turn_of", F.coalesce(F.last(F.when(setup, "player1").when(marker, side(owner)), ignorenulls=True).over(upto), F.lit("player1")))
    rows = rows.withColumn("next", F.collect_list("line").over(ordered.rowsBetween(1, max(AHEAD, MOST_PRIZES + PRIZE_AHEAD))))
    rows = rows.where(~setup & ~marker).withColumn("id", F.row_number().over(ordered) - 1).where(~F.startswith(line, F.lit("-")))

    actor = F.coalesce(*[side(F.regexp_extract(line, p, 1)) for p in (rf"(?i)^(\w+)\s+(?:{VERBS})", rf"(?i)^(\w+)'s\s+.*?\s+(?:{PASSIVE})")], F.col("_turn_of"))
    ahead = F.slice("next", 1, AHEAD)
    skip = F.transform(ahead, lambda x: F.startswith(x, F.lit("-")) | F.contains(x, F.lit("drawn cards")))
    # The first following line that is neither a continuation nor skipped: the listing, if it begins with a bullet.
    listing = F.get(ahead, F.coalesce(F.array_position(skip, False).cast("int"), F.lit(0)) - 1)
    listed = F.when(F.startswith(listing, F.lit("•")), F.transform(F.split(F.regexp_replace(listing, "^•", ""), ","), lambda x: F.trim(x)))
    named = F.when(~F.contains(line, F.lit("drew a card")) & ~F.contains(line, F.lit("drew card")), _got(line, r"(?i)drew\s+([A-Z][^.]+?)\s*\.", 1))
    drawn = F.coalesce(F.when(named.isNotNull(), F.array(named)), listed)
    took = F.coalesce(_got(line, r"(?i)(\d+)\s+Prize", 1).try_cast("int"), F.lit(1))
    after = F.slice("next", F.lit(1), F.least(took, F.lit(MOST_PRIZES)) + PRIZE_AHEAD)
    # Up to and with the line that ends the listing.
    ends = F.array_position(F.transform(after, lambda x: F.contains(x, F.lit("'s Turn")) | F.contains(x, F.lit("is now in the Active Spot"))), True).cast("int")
    until = F.when(ends > 0, F.slice(after, F.lit(1), ends)).otherwise(after)
    added = F.filter(until, lambda x: F.contains(x, F.lit("was added to")) & F.contains(x, F.lit("hand")))
    shown = F.array_compact(F.transform(added, lambda x: _got(x, r"(?i)([A-Z][^w]+)\s+was added", 1)))
    number = lambda p: F.coalesce(_got(line, p, 1).try_cast("int"), F.lit(1))
    letters = ".+?" if names_with_t else "[^t]+?"
    has = lambda *words: [F.contains(line, F.lit(w)) for w in words]

    def action(kind, card, target=None, count=None, names=None, position=None, damage=None, move=None, needs=None):
        none = F.lit(None)
        made = F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), card.alias("card"), (target if target is not None else none.cast("string")).alias("target"), (count if count is not None else none.cast("int")).alias("count"),
            (names if names is not None else none.cast("array<string>")).alias("names"), (position if position is not None else none.cast("string")).alias("position"), (damage if damage is not None else none.cast("int")).alias("damage"), (move if move is not None else none.cast("string")).alias("move"),
        )
        return F.when(card.isNotNull() if needs is None else needs, made)

    drew = number(r"(?i)\w+\s+drew\s+(\d+)\s*(?:a\s+)?card")
    placed = rf"played ({letters}) to the (Active Spot|Bench)"
    attached = r"attached (.+?Energy) to (.+?) (?:in the Active Spot|on the Bench)"
    attack = r"(\w+)'s (.+?) used (.+?) on (\w+)'s (.+?) for (\d+) damage"
    evolved, knocked, single = r"evolved (.+?) to (.+?)(?: in the Active Spot| on the Bench|\.|$)", r"(\w+)'s (.+?) was Knocked Out", r"played (\w+)\."
    ability, discarded = r"(\w+)'s (.+?) used (.+)$", r"discarded\s+(.+?)(?:\.|$)"
    skipped = line.rlike(r"(?i)\d+\s+cards?\s+were\s+discarded\s+from") | line.rlike(r"(?i)discarded\s+from\s+")
    tests = [
        (has("drew", "card"), action("DRAW", F.coalesce(F.get(drawn, F.lit(0)), F.when(drew == 1, "1 card").otherwise(F.concat(drew.cast("string"), F.lit(" cards")))), count=drew, names=drawn)),
        (has("took", "Prize"), action("PRIZE", F.when(took > 1, "Prize cards").otherwise("Prize card"), count=took, names=F.when(F.size(shown) > 0, shown))),
        ([line.rlike(r"played .+ to the (Active Spot|Bench)")], action("PLAY_POKEMON", _got(line, placed, 1), position=F.when(F.regexp_extract(line, placed, 2) == "Bench", "bench").otherwise("active"))),
        (has("attached", "Energy"), action("ATTACH_ENERGY", _got(line, attached, 1), target=_got(line, attached, 2))),
        (has("used", "on", "damage"), action("ATTACK", _got(line, attack, 2), target=_got(line, attack, 5), damage=_got(line, attack, 6).try_cast("int"), move=_got(line, attack, 3))),
        (has("evolved"), action("EVOLVE", _got(line, evolved, 2), target=_got(line, evolved, 1))),
        (has("was Knocked Out"), action("KNOCKOUT", _got(line, knocked, 2))),
        ([line.rlike(r"played \w+\.")], action(F.when(_got(line, single, 1).isin(TRAINERS), "PLAY_TRAINER").otherwise("PLAY_POKEMON"), _got(line, single, 1))),
        (has("retreated"), action("RETREAT", _got(line, r"retreated (.+?) to the Bench", 1))),
        ([*has("used"), ~F.contains(line, F.lit("damage"))], action("ABILITY", _got(line, ability, 2), move=_got(line, ability, 3))),
        (has("discarded"), action("DISCARD", _got(line, discarded, 1), needs=~skipped & _got(line, discarded, 1).isNotNull())),
    ]
    chain = None
    for gates, made in tests:
        gate = gates[0]
        for g in gates[1:]:
            gate = gate & g
        chain = F.when(gate, made) if chain is None else chain.when(gate, made)
    found = staged(rows, "a", chain).where("a is not null")
    # A knocked-out unit belongs to the named owner; an owner who is not player1 counts as player2.
    player = F.when(F.col("a.type") == "KNOCKOUT", F.when(F.regexp_extract(line, knocked, 1) == F.col("player1"), "player1").otherwise("player2")).otherwise(actor)
    return found.select("battle_id", "seq", F.concat(F.lit("action-"), F.col("id").cast("string")).alias("action_id"), "turn", ((F.row_number().over(ordered) - 1) * 200).alias("ts"), player.alias("player"), line.alias("details"), "a.*")


def _no_card(column: Column) -> Column:
    """Texts that stand for cards nobody saw."""
    return column.isNull() | column.isin("", "Card", "A card") | column.rlike(r"(?i)^\d+\s+cards?$") | column.rlike(r"(?i)^Prize\s+cards?$") | column.rlike(r"(?i)^from\s+.*?'s\s+")


def decks(actions: DataFrame, energy_four: bool = False) -> DataFrame:
    """battle_id, player, card, quantity: the cards each player showed; 3 for at least three different uses, 2 for two,
    else 1; basic energy 2 (4 with ``energy_four`` where it was attached)."""
    listed = actions.where(F.col("names").isNotNull()).select("battle_id", "player", F.explode("names").alias("card"), F.lit("revealed").alias("use"))
    named = actions.where("card <> 'Unknown Card'").select("battle_id", "player", "card", F.col("type").alias("use"))
    used = named.unionByName(listed).where(~_no_card(F.col("card")))
    sets = used.groupBy("battle_id", "player", "card").agg(F.countDistinct("use").alias("n"), F.max(F.col("use") == "ATTACH_ENERGY").alias("attached"))
    energy = F.contains("card", F.lit("Basic")) & F.contains("card", F.lit("Energy"))
    quantity = F.when(energy, F.when(F.col("attached") & F.lit(energy_four), 4).otherwise(2)).otherwise(F.least(F.lit(3), F.col("n")))
    return sets.select("battle_id", "player", "card", quantity.cast("int").alias("quantity"))


def deck_lists(decks: DataFrame) -> DataFrame:
    """battle_id, player, cards: each deck as a list, larger quantities first, then names as people sort them. A deck holds
    at most as many names as its battle shows."""
    entry = F.struct((-F.col("quantity")).alias("order"), F.collate("card", "UNICODE").alias("name"), "quantity", "card")
    return decks.groupBy("battle_id", "player").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["card"].alias("card"), x["quantity"].alias("quantity"))).alias("cards"))


def counters(actions: DataFrame) -> DataFrame:
    """battle_id, player, deck, prizes, hand after the last action: clamped running counts as a fold over ordered actions.

    One battle's actions are one array; a battle is bounded by its length of play.
    """
    hand_in = F.when(F.col("type").isin("DRAW", "PRIZE"), F.coalesce(F.size("names"), "count", F.lit(1))).otherwise(0)
    out = F.col("type").isin("PLAY_POKEMON", "ATTACH_ENERGY", "EVOLVE", "PLAY_TRAINER", "DISCARD").cast("int")
    step = F.struct("seq", F.when(F.col("type") == "DRAW", F.col("count")).otherwise(0).alias("drawn"), F.when(F.col("type") == "PRIZE", F.col("count")).otherwise(0).alias("prizes"), hand_in.cast("int").alias("gain"), out.alias("loss"))
    folded = actions.groupBy("battle_id", "player").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    start = F.struct(F.lit(60).alias("deck"), F.lit(6).alias("prizes"), F.lit(0).alias("hand"))
    zero = F.lit(0)
    state = F.aggregate("steps", start, lambda s, x: F.struct(F.greatest(zero, s["deck"] - x["drawn"]).alias("deck"), F.greatest(zero, s["prizes"] - x["prizes"]).alias("prizes"), F.greatest(zero, s["hand"] + x["gain"] - x["loss"]).alias("hand")))
    return folded.select("battle_id", "player", state.alias("s")).select("battle_id", "player", "s.*")


def boards(actions: DataFrame) -> DataFrame:
    """battle_id, step (from 0), n, seq, turn, player, stadium, and for each side (p1, p2) deck, prizes, hand, active, hp, damage
    (counters), bench, n_discard and discarded (what went to the pile), after every action.

    A fold per battle: one battle's actions are in one task's memory, bounded by its length of play.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        acts, replay = rows.sort_values("seq").to_dict("records"), Replay()
        return pd.DataFrame([{"battle_id": a["battle_id"], "n": len(acts), **replay.apply(a, acts[at + 1 : at + 1 + LOOKS])} for at, a in enumerate(acts)])

    kind = actions.schema["battle_id"].dataType.simpleString()
    return actions.select("battle_id", *REPLAYED).groupBy("battle_id").applyInPandas(fold, f"battle_id {kind}, n int, {BOARD}").select("battle_id", "step", "n", "seq", "turn", "player", "stadium", *[f"{p}_{c}" for p in ("p1", "p2") for c in SIDE])


def state_at(boards: DataFrame, step: int) -> DataFrame:
    """Each battle's state after its action ``step``, held within its first and last one, and how far that is along."""
    at = F.least(F.greatest(F.lit(step), F.lit(0)), F.col("n") - 1)
    return boards.where(F.col("step") == at).withColumn("progress", F.col("step") / F.col("n"))


def view(boards: DataFrame, side: str) -> DataFrame:
    """battle_id, step, slots (five places of the bench, null where free) and prizes (six flags) of one side."""
    slots = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(f"{side}_bench", i))
    return boards.select("battle_id", "step", slots.alias("slots"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i < F.col(f"{side}_prizes")).alias("prizes"))


def battles(logs: DataFrame, battle: str = "battle_id", text: str = "raw_log") -> DataFrame:
    """Logs with players, winner, turn count and title read from their text; also what a new reading replaces."""
    from marlstone.functions.scalars import versus

    found = players(lines_of(logs, battle, text)).withColumn("title", versus(F.col("player1"), F.col("player2")))
    new = ["player1", "player2", "winner", "turn_count", "title"]
    return logs.drop(*new).join(found.select(F.col("battle_id").alias(battle), *new), battle, "left")


def listed(battles: DataFrame, name: str | None = None, player1: str | None = None, player2: str | None = None, tournament=None) -> DataFrame:
    """Battles of a player on either side, of players by side (texts held in names), and of a tournament."""
    from marlstone.functions.scalars import contains_ci
    from marlstone.operators.search import all_of, any_of

    sides = {c: contains_ci(F.col(c), v) for c, v in (("player1", player1), ("player2", player2)) if v}
    either = any_of([contains_ci(F.col(c), name) for c in ("player1", "player2")]) if name else None
    return battles.where(all_of([*sides.values(), either, F.col("tournament_id") == tournament if tournament is not None else None]))


def public(battles: DataFrame, text: str = "raw_log", times: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Battles without their raw text, times in ISO form."""
    return battles.drop(text).withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for c in times if c in battles.columns})
