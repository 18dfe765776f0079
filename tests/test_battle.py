from marlstone.operators import battle

LOG = """Setup
Alice chose heads for the opening coin flip.
Bob won the coin toss.
Bob decided to go first.
Alice drew 7 cards for the opening hand.
- 7 drawn cards.
• Budew, Iono, Munkidori
Bob played Budew to the Active Spot.
Alice's Turn
Alice drew a card.
Alice attached Basic Fire Energy to Froslass in the Active Spot.
Bob's Turn
Bob's Budew used Itchy Pollen on Alice's Froslass for 10 damage.
Alice's Froslass was Knocked Out!
Bob took a Prize card.
Bob wins."""


def parsed(spark, text, **more):
    return battle.parse(spark.createDataFrame([("b", text)], "battle_id string, raw_log string"), **more)


def test_golden_log(spark):
    logs = spark.createDataFrame([("b", LOG)], "battle_id string, raw_log string")
    who = battle.players(battle.lines_of(logs)).first()
    assert (who.player1, who.player2, who.winner, who.turn_count) == ("Bob", "Alice", "Bob", 1)
    got = [(r.action_id, r.turn, r.ts, r.player, r.type, r.card, r.target, r["count"], r.damage) for r in battle.parse(logs).orderBy("seq").collect()]
    assert got == [
        ("action-3", 0, 0, "player2", "DRAW", "Budew", None, 7, None),
        ("action-6", 0, 200, "player1", "PLAY_POKEMON", "Budew", None, None, None),
        ("action-7", 1, 400, "player2", "DRAW", "1 card", None, 1, None),
        ("action-8", 1, 600, "player2", "ATTACH_ENERGY", "Basic Fire Energy", "Froslass", None, None),
        ("action-9", 2, 800, "player1", "ATTACK", "Budew", "Froslass", None, 10),
        ("action-10", 2, 1000, "player2", "KNOCKOUT", "Froslass", None, None, None),
        ("action-11", 2, 1200, "player1", "PRIZE", "Prize card", None, 1, None),
    ]


def test_decks_and_state(spark):
    actions = parsed(spark, LOG)
    decks = sorted((r.player, -r.quantity, r.card) for r in battle.decks(actions).collect())
    assert decks == [("player1", -2, "Budew"), ("player2", -2, "Basic Fire Energy"), ("player2", -2, "Budew"), ("player2", -1, "Froslass"), ("player2", -1, "Iono"), ("player2", -1, "Munkidori")]
    state = {r.player: (r.deck, r.prizes, r.hand) for r in battle.counters(actions).collect()}
    assert state == {"player1": (60, 5, 0 + 1), "player2": (52, 6, 3)}
    last = battle.boards(actions).orderBy("seq").collect()[-1]
    assert (last.p1_active, last.p2_active, last.p2_bench, last.turn) == ("Budew", None, [], 2)
    assert (last.p1_deck, last.p1_prizes, last.p1_hand, last.p2_deck, last.p2_prizes, last.p2_hand) == (60, 5, ["Prize Card"], 52, 6, ["Budew", "Iono", "Munkidori"])
    assert (last.step, last.n, last.player, last.stadium, last.p1_hp, last.p2_hp) == (6, 7, "player1", None, 100, None)
    boards = battle.boards(actions)
    assert [r.seq for r in battle.state_at(boards, 99).collect()] == [last.seq]
    assert battle.state_at(boards, -5).first().step == 0
    seen = battle.view(battle.state_at(boards, 6), "p1").first()
    assert (seen.slots, seen.prizes) == ([None] * 5, [True] * 5 + [False])
    lists = {r.player: [(c.card, c.quantity) for c in r.cards] for r in battle.deck_lists(battle.decks(actions)).collect()}
    assert lists["player2"] == [("Basic Fire Energy", 2), ("Budew", 2), ("Froslass", 1), ("Iono", 1), ("Munkidori", 1)]


def test_prizes_shown(spark):
    """Cards that are added to the hand belong to a prize up to the next turn or active unit, within n + 4 lines."""
    head = "A won the coin toss.\nB chose heads.\nA took 2 Prize cards.\n"
    shown = lambda tail: [r.names for r in parsed(spark, head + tail).where("type = 'PRIZE'").collect()]
    assert shown("Iono was added to A's hand.\nArven was added to A's hand.\nArtazon was added to A's hand.\nB's Turn\nDratini was added to B's hand.") == [["Iono", "Arven", "Artazon"]]
    assert shown("x\n" * 5 + "Iono was added to A's hand.") == [["Iono"]]
    assert shown("x\n" * 6 + "Iono was added to A's hand.") == [None]
    assert shown("Froslass is now in the Active Spot.\nIono was added to A's hand.") == [None]
    assert shown("Iono was added to the deck.") == [None]


def test_board_moves(spark):
    """Retreats, knock-outs with promotion by what follows, attachments, stadiums."""
    log = """A won the coin toss.
B chose heads.
A played Budew to the Active Spot.
A retreated Budew to the Bench.
A played Lucario to the Bench.
A played Riolu to the Bench.
A attached Basic Fire Energy to Lucario on the Bench.
A retreated Budew to the Bench.
A's Riolu used Growl.
A's Riolu was Knocked Out!
A's Lucario used Slam on B's Froslass for 30 damage.
B played Froslass to the Active Spot.
A's Lucario used Slam on B's Froslass for 30 damage.
A's Lucario was Knocked Out!
A played Artazon."""
    rows = battle.boards(parsed(spark, log, names_with_t=True)).orderBy("step").collect()
    got = [(r.p1_active, r.p1_bench) for r in rows]
    assert got[:6] == [("Budew", []), ("Budew", []), ("Budew", ["Lucario"]), ("Budew", ["Lucario", "Riolu"]), ("Budew", ["Lucario", "Riolu"]), ("Riolu", ["Lucario", "Budew"])]
    assert got[7] == ("Lucario", ["Budew"]) and rows[10].p2_damage == 3 and rows[8].p2_damage == 0
    assert rows[11].p1_discarded == ["Lucario", "Basic Fire Energy"] and got[11] == ("Budew", [])
    assert rows[12].p1_n_discard == 4 and rows[12].p1_discarded == ["Artazon"]


def test_battle_rows(spark):
    logs = spark.createDataFrame([("b", LOG, 7), ("c", "nothing", 8)], "battle_id string, raw_log string, tournament_id int")
    rows = battle.battles(logs)
    assert {r.battle_id: (r.title, r.winner) for r in rows.collect()} == {"b": ("Bob vs Alice", "Bob"), "c": ("Unknown vs Unknown", None)}
    assert [r.battle_id for r in battle.listed(rows, name="ALI").collect()] == ["b"]
    assert battle.listed(rows, player1="ali").count() == 0 and battle.listed(rows, tournament=8).count() == 1
    assert "raw_log" not in battle.public(rows).columns


def test_single_lines(spark):
    head = "A won the coin toss.\nB chose heads for the flip.\n"
    kinds = lambda line, **more: [(r.type, r.card, r.move) for r in parsed(spark, head + line, **more).collect()]
    assert kinds("A drew Dratini.") == []
    assert kinds("A played Team Rocket's Murkrow to the Active Spot.") == []
    assert kinds("A played Team Rocket's Murkrow to the Active Spot.", names_with_t=True) == [("PLAY_POKEMON", "Team Rocket's Murkrow", None)]
    assert kinds("A's Dragonair used Evolutionary Guidance.") == [("ABILITY", "Dragonair", "Evolutionary Guidance.")]
    assert kinds("A played Iono.") == [("PLAY_TRAINER", "Iono", None)]
    assert kinds("A played Pikachu.") == [("PLAY_POKEMON", "Pikachu", None)]
    assert kinds("A played Ultra Ball.") == []


def test_empty(spark):
    assert parsed(spark, None).count() == 0
    assert parsed(spark, "").count() == 0
