"""Stored tables: versions, merges of touched buckets, conflicts, batches, records by id."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import stored
from marlstone.operators.records import upsert
from marlstone.sources.tables import Conflict, Folder, StoredTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table_of(spark, tmp_path, n=40, buckets=4):
    return StoredTable.create(str(tmp_path / "t"), spark.range(n).select("id", F.lit("old").alias("v")), ["id"], buckets)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = table_of(spark, tmp_path)
    before = table.manifest(0)["files"]
    stored.put_rows(table, spark.createDataFrame([(3, "new"), (99, "made")], "id long, v string"))
    after = table.manifest(1)
    assert set(after["touched"]) < set(before) and all(after["files"][b] == before[b] for b in before if b not in after["touched"])
    assert rows(table.read(0)) == rows(spark.range(40).select("id", F.lit("old")))
    assert {r.id: r.v for r in table.read().collect()} == {i: "new" if i == 3 else "old" for i in range(40)} | {99: "made"}
    assert after["counts"]["inserted"] == after["counts"]["updated"] == 1
    # What was staged for the merge is gone, and nothing but versions and data is left.
    assert sorted(Folder(spark, str(tmp_path / "t")).names()) == ["data", "versions"]
    assert len(Folder(spark, str(tmp_path / "t")).names("data")) == 2


def test_conflicts(spark, tmp_path):
    table = table_of(spark, tmp_path)
    one = lambda i, v: spark.createDataFrame([(i, v)], "id long, v string")
    bucket = {i: table.get(i).select(table.bucket_of()).first()[0] for i in range(40)}
    other = next(i for i in range(1, 40) if bucket[i] != bucket[0])
    assert stored.put_rows(table, one(0, "first")) == 1
    with pytest.raises(Conflict):
        stored.put_rows(table, one(0, "stale"), base=0)
    # Another bucket: the change is put behind the one that came first.
    assert stored.put_rows(table, one(other, "beside"), base=0) == 2
    assert {r.id: r.v for r in table.read().where("v <> 'old'").collect()} == {0: "first", other: "beside"}
    assert [r.version for r in table.history().orderBy("version").collect()] == [0, 1, 2]
    with pytest.raises(Conflict):
        table_of(spark, tmp_path)


def test_two_writers_of_one_number(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.put_new("versions/1.json", "a") and not folder.put_new("versions/1.json", "b")
    assert folder.read("versions/1.json") == "a" and folder.names("versions") == ["1.json"]


def test_refused_merges_leave_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path)
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(ValueError, match="several times"):
        stored.put_rows(table, twice)
    with pytest.raises(ValueError, match="other keys"):
        table.merge(twice.limit(1), lambda old, new: old.unionByName(spark.range(100, 140).select("id", F.lit("x").alias("v"))))
    with pytest.raises(Exception, match="division|DIVIDE"):
        table.merge(twice.limit(1), lambda old, new: old.withColumn("v", (1 / (F.col("id") - F.col("id"))).cast("string")))
    assert table.version() == 0 and len(Folder(spark, str(tmp_path / "t")).names("data")) <= 2
    assert table.read().count() == 40


def test_empty_and_null_keys(spark, tmp_path):
    table = StoredTable.create(str(tmp_path / "e"), spark.createDataFrame([], "id long, v string"), ["id"], 3)
    assert table.read().count() == 0 and table.get(1).count() == 0
    stored.put_rows(table, spark.createDataFrame([(None, "null"), (1, None)], "id long, v string"))
    stored.put_rows(table, spark.createDataFrame([(None, "again")], "id long, v string"))
    assert rows(table.read()) == rows(spark.createDataFrame([(None, "again"), (1, None)], "id long, v string"))
    assert table.get(None).first().v == "again"
    assert stored.put_rows(table, spark.createDataFrame([], "id long, v string")) == 3
    assert table.read().count() == 2


def test_lookup_reads_one_bucket(spark, tmp_path):
    table = table_of(spark, tmp_path, 200, 16)
    found = table.get(17)
    assert rows(found) == [(17, "old")]
    assert len(found.inputFiles()) == 1 < len(table.read().inputFiles())
    wanted = spark.createDataFrame([(3,), (5,), (1000,)], "id long")
    assert rows(table.lookup(wanted)) == [(3, "old"), (5, "old")]
    assert len(table.lookup(wanted).inputFiles()) <= 3


def test_old_versions_are_forgotten(spark, tmp_path):
    table = table_of(spark, tmp_path)
    for v in ("a", "b"):
        stored.put_rows(table, spark.range(40).select("id", F.lit(v).alias("v")))
    assert table.drop_before(2) > 0
    assert table.read().select("v").distinct().collect()[0].v == "b"
    with pytest.raises(Exception):
        table.read(0)
    assert stored.put_rows(table, spark.range(1).select("id", F.lit("c").alias("v"))) == 3


def test_stopped_batches_bring_nothing(spark, tmp_path, monkeypatch):
    """A run that stops before its version is in place has brought neither rows nor marks; the next one brings both."""
    table = table_of(spark, tmp_path, 0)
    data = spark.range(95).select("id", F.concat(F.lit("v"), "id").alias("v"))
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            stored.import_batches(table, data, ["id"], 10, F.col("id") == 33)
    assert table.read().count() == 0 and stored.batches(table).count() == 0
    marks = {r.batch: (r.n, r.outcome) for r in stored.import_batches(table, data, ["id"], 10, F.col("id") == 33).collect()}
    assert marks == {b: (10 if b < 9 else 5, "failed" if b == 3 else "success") for b in range(10)}
    assert {r.id for r in table.read().collect()} == set(range(95)) - set(range(30, 40))
    again = {r.batch: r.outcome for r in stored.import_batches(table, data, ["id"], 10, F.lit(None)).collect()}
    assert again == {b: "success" if b == 3 else "known" for b in range(10)}
    assert table.read().count() == 95 and stored.batches(table).where("outcome = 'success'").count() == 10


def test_last_batch_of_a_key_counts(spark, tmp_path):
    table = table_of(spark, tmp_path, 1)
    data = spark.createDataFrame([(0, "c", 3), (0, "b", 2), (0, "bad", 4)], "id long, v string, at int").select("at", "id", "v")
    table = StoredTable.create(str(tmp_path / "k"), data.limit(0), ["id"], 2)
    stored.import_batches(table, data, ["at"], 1, F.col("v") == "bad")
    assert rows(table.read().select("id", "v")) == [(0, "c")]


def test_patches_and_removals(spark, tmp_path):
    table = table_of(spark, tmp_path)
    patches = spark.createDataFrame([(1, None, ["v"]), (2, "kept", []), (500, "x", ["v"])], "id long, v string, given array<string>")
    stored.patch(table, patches)
    assert {r.id: r.v for r in table.read().where("id < 3 or id > 39").collect()} == {0: "old", 1: None, 2: "old"}
    stored.remove_rows(table, spark.createDataFrame([(1,), (700,)], "id long"))
    assert table.read().count() == 39
    with pytest.raises(KeyError):
        stored.remove_rows(table, spark.createDataFrame([(1,)], "id long"), strict=True)


def test_records(spark, tmp_path):
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    log = stored.Records.create(spark, str(tmp_path / "r"), 4)
    put = lambda pairs: spark.createDataFrame(pairs, "id string, body string")
    with pytest.raises(ValueError):
        log.put(put([("", "x")]), "raw", day(1))
    log.put(put([("a", "1"), ("b", "1")]), "raw", day(1))
    log.put(put([("a", "2")]), "raw", day(2))
    log.put(put([("a", "p")]), "processed", day(3))
    log.put(put([("a", "mine")]), "raw", day(3), F.lit("user1"))
    got = log.get("a", "raw").first()
    assert (got.body, str(got.created_at)[:10], str(got.updated_at)[:10]) == ("2", "2024-01-01", "2024-01-02")
    assert log.get("a", "processed").first().body == "p" and log.get("a", "raw", "user1").first().body == "mine"
    assert log.get("zzz", "raw").count() == 0
    log.take_back(put([("a", "")]), "raw", day(4))
    assert log.get("a", "raw").count() == 0 and log.get("a", "processed").count() == 1
    # A second life begins anew.
    log.put(put([("a", "3")]), "raw", day(5))
    assert str(log.get("a", "raw").first().created_at)[:10] == "2024-01-05"
    before = rows(log.all("raw"))
    log.compact()
    assert rows(log.all("raw")) == before and log.table.read().count() == 3
    assert rows(log.all("raw", 1)) == rows(stored.Records.last(log.table.read(1)))


def test_upsert_of_the_whole_equals_merge(spark, tmp_path):
    old = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("v"))
    new = spark.range(150, 450).select("id", F.when(F.col("id") % 2 > 0, F.lit("n")).alias("v"))
    table = StoredTable.create(str(tmp_path / "u"), old, ["id"], 8)
    stored.put_rows(table, new)
    assert rows(table.read()) == rows(upsert(old, new, ["id"]).drop("outcome"))
