"""Streamed boards against those of a table."""

import random

from pyspark.sql import functions as F

from marlstone.operators import battle, replay
from marlstone.plans import replays
from marlstone.sources import files
from marlstone.streaming import events as streams


def log(rng, n):
    """A battle in which units come, attach, evolve, fight, retreat and fall, with others following on."""
    lines, names = ["Ann won the coin toss.", "Bob chose heads."], ["Budew", "Riolu", "Lucario"]
    for i in range(n):
        a, b = ("Ann", "Bob") if rng.random() < 0.5 else ("Bob", "Ann")
        x, y = rng.choice(names), rng.choice(names)
        lines.append(rng.choice([
            f"{a}'s Turn", f"{a} drew {rng.randrange(1, 4)} cards.", f"{a} took a Prize card.", f"{a} played {x} to the {rng.choice(['Bench', 'Active Spot'])}.", f"{a} attached Basic Fire Energy to {x} on the Bench.",
            f"{a}'s {x} used Slam on {b}'s {y} for {rng.randrange(1, 9)}0 damage.", f"{a}'s {x} was Knocked Out!", f"{a} retreated {x} to the Bench.", f"{a}'s {x} used Growl.", f"{a} evolved {x} to {y} on the Bench.", f"{a} played Iono.", f"{a} discarded {x}.",
        ]))
    return "\n".join(lines)


def rows(df, columns):
    return sorted(tuple(r) for r in df.select([F.col(c).cast("string") for c in columns]).na.fill("-").collect())


def test_stream_equals_table(spark):
    rng = random.Random(1)
    logs = spark.createDataFrame([(i, log(rng, n)) for i, n in enumerate([1, 2, 3, 5, 8, 30, 60, 90, 120])], "battle_id long, raw_log string")
    actions = battle.parse(logs, names_with_t=True)
    whole = battle.boards(actions).drop("n")
    streamed = replays.streamed(spark, actions)
    assert set(streamed.columns) == set(whole.columns)
    assert rows(streamed, whole.columns) == rows(whole, whole.columns)
    assert whole.where("p1_active is not null").count() > 20 and whole.where("size(p1_discarded) > 1 or size(p2_discarded) > 1").count() > 0


def test_repeated_actions_count_once(spark, tmp_path):
    """A file that comes twice changes nothing; a battle that goes on after its end begins anew."""
    logs = spark.createDataFrame([(1, log(random.Random(5), 40))], "battle_id long, raw_log string")
    actions = battle.parse(logs).select("battle_id", *replay.REPLAYED, F.timestamp_seconds("seq").alias("at"))
    folder = str(tmp_path / "in")
    late = actions.limit(1).withColumns({"battle_id": F.lit(-1).cast("long"), "at": F.lit("2000-01-01").cast("timestamp")})
    for part in (actions.where("seq < 20"), actions.where("seq < 20"), actions.where("seq >= 15"), late):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with replays.several_states(spark):
        streams.run_available(replay.stream_boards(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    whole = battle.boards(battle.parse(logs)).drop("n")
    assert rows(spark.read.parquet(str(tmp_path / "out")), whole.columns) == rows(whole, whole.columns)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    assert files.scratch(spark, "x") != files.scratch(spark, "x")


def test_compared_counts_both_ways(spark):
    """Rows that either table lacks count as often as they are missing, lists and nulls in them; equal ones don't."""
    make = lambda xs: spark.createDataFrame(xs, "k long, l array<string>")
    a = make([(1, ["x"]), (1, ["x"]), (2, None), (3, []), (None, ["y"])])
    b = make([(1, ["x"]), (2, None), (3, [None]), (None, ["y"])])
    assert tuple(replays.compared(a, b).first()) == (5, 3)
    assert tuple(replays.compared(a, a).first()) == (5, 0)
    assert tuple(replays.compared(make([]), make([])).first()) == (0, 0)


def test_a_line_is_read_once(spark):
    """The tests that type a line are not gone through again by the filter for lines that give an action."""
    from marlstone.plans import battles

    plan = battles.parsed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    name = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(name)
    spark.conf.set(name, "100000")
    try:
        assert plan.toString().count("retreated (.+?) to the Bench") <= 3  # the card as written out in one chain; six with the filter
    finally:
        spark.conf.set(name, before)
