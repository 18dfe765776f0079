"""Files moved and removed by a journal; logs read again only when they changed."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators import stored
from marlstone.sources import retention
from tests.test_battle import LOG


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if "journal" not in d)


def filled(spark, root):
    os.makedirs(f"{root}/events")
    for year in (2023, 2024, 2025):
        for n in range(6):
            with open(f"{root}/events/{year}-{n}.json", "w") as f:
                f.write(str(n))
    rows = [(f"{root}/events/{n}", n, f"{n[:4]}-0{int(n[5]) + 1}-01") for n in sorted(os.listdir(f"{root}/events"))]
    return spark.createDataFrame(rows, "path string, name string, modified string").withColumn("modified", F.to_timestamp("modified"))


def acts(index, root):
    return retention.archiving(index, 2024, f"{root}/old"), retention.removing(index.where("name < '2024'"), F.lit("2023-04-01").cast("timestamp"), 30)


def test_a_stopped_job_is_finished(spark, tmp_path):
    """Wherever a job stops, the next one ends with the tree of a job that went through."""
    want = None
    for stop in (None, 0, 1, 3, 7):
        root = str(tmp_path / f"r{stop}")
        journal = retention.Journal(spark, f"{root}/journal")
        for a in acts(filled(spark, root), root):
            journal.plan(a.coalesce(1))
        count = str(tmp_path / f"count{stop}")

        def limited(kind, path, target):
            done = os.path.getsize(count) if os.path.exists(count) else 0
            if done == stop:
                raise OSError("stopped")
            retention.perform(kind, path, target)
            with open(count, "a") as f:
                f.write("x")

        if stop is None:
            assert journal.finish() == 2
            want = tree(root)
        else:
            with pytest.raises(Exception, match="stopped"):
                journal.finish(limited)
            assert journal.open() and tree(root) != want
            journal.finish()
        assert tree(root) == want and journal.open() == [] and journal.finish() == 0
    assert sum(f.startswith("old/2024/2024-") for f in want) == 6 and sum(f.startswith("events/2023") for f in want) == 3


def test_nothing_is_written_over(spark, tmp_path):
    root = str(tmp_path / "t")
    index = filled(spark, root)
    os.makedirs(f"{root}/old/2024")
    with open(f"{root}/old/2024/2024-0.json", "w") as f:
        f.write("mine")
    journal = retention.Journal(spark, f"{root}/journal")
    journal.plan(acts(index, root)[0])
    with pytest.raises(Exception, match="FileExistsError"):
        journal.finish()
    assert open(f"{root}/old/2024/2024-0.json").read() == "mine" and os.path.exists(f"{root}/events/2024-0.json")
    retention.perform("delete", f"{root}/events/none", None)
    with pytest.raises(FileNotFoundError):
        retention.perform("move", f"{root}/events/none", f"{root}/x")


def test_only_changed_logs_are_read(spark, tmp_path):
    table = stored.battle_table(spark, str(tmp_path / "b"), "long", 4)
    logs = lambda pairs: spark.createDataFrame(pairs, "battle_id long, raw_log string")
    texts = {i: LOG if i % 2 else LOG.replace("Alice", "Carol") for i in range(8)} | {8: None, 9: ""}
    assert stored.reread(table, logs(list(texts.items())), 1) == 10
    assert stored.reread(table, logs(list(texts.items())), 1) == 0 and table.version() == 1
    texts[3] = LOG.replace("Bob wins.", "Alice wins.")
    assert stored.reread(table, logs(list(texts.items())), 1) == 1
    got = {r.battle_id: (r.title, r.winner, r.read_in) for r in table.read().collect()}
    assert got[3] == ("Bob vs Alice", "Alice", 2) and got[1] == ("Bob vs Alice", "Bob", 1) and got[2][0] == "Bob vs Carol"
    # The row of the changed log alone lies in files of the second run's bucket; another reader reads all.
    assert len(table.manifest(2)["touched"]) == 1
    assert stored.reread(table, logs(list(texts.items())), 2) == 10
    assert {r.read_in for r in table.read().collect()} == {3}
