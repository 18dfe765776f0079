"""Queries over stored tables: each makes one from the standard tables, changes it, and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import imports, stored
from marlstone.plans import etl
from marlstone.plans.catalog import SQL, _t, query
from marlstone.plans.battles import ACTIONS, logs
from marlstone.sources import files, retention
from marlstone.sources.tables import Conflict, Folder, StoredTable


@query("""
with v0 as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 4 <> 3),
v1 as (select o_orderkey, case when o_orderkey % 4 in (2, 3) then 'N' else o_orderstatus end as o_orderstatus, case when o_orderkey % 4 = 3 then null else o_totalprice end as o_totalprice from orders),
v2 as (select o_orderkey, o_orderstatus, case when o_orderkey % 4 = 0 then 0 else o_totalprice end as o_totalprice from v1)
select 0 as version, * from v0 union all select 1, * from v1 union all select 2, * from v2
""")
def stored_upsert(spark, sf_dir):
    """Two merges into stored orders, all three versions read back; a merge that is based on the first one is refused."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    table = StoredTable.create(files.scratch(spark, "orders"), orders.where("o_orderkey % 4 <> 3"), ["o_orderkey"], 8)
    stored.put_rows(table, orders.where("o_orderkey % 4 in (2, 3)").withColumns({"o_orderstatus": F.lit("N"), "o_totalprice": F.lit(None).cast("double")}))
    last = orders.where("o_orderkey % 4 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    stored.put_rows(table, last, {"o_orderstatus": "keep", "o_totalprice": "new"})
    try:
        stored.put_rows(table, last, base=0)
        raise AssertionError("a merge with an old version went through")
    except Conflict:
        pass
    out = table.read(0).withColumn("version", F.lit(0))
    for n in (1, 2):
        out = out.unionByName(table.read(n).withColumn("version", F.lit(n)))
    return out


@query("""
select 1 as version, 'inserted' as outcome, count(*) as n from customer where c_custkey % 3 = 2 having count(*) > 0 union all
select 1, 'updated', count(*) from customer where c_custkey % 3 = 1 having count(*) > 0 union all
select 1, 'kept', count(*) from customer where c_custkey % 3 = 0 having count(*) > 0 union all
select 2, 'updated', count(*) from customer where c_custkey = 1
""")
def stored_history(spark, sf_dir):
    """What each merge did to the buckets it touched. The second one changes one row: the rows beside it are kept, those of
    other buckets not even read, so only its update is counted here."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    table = StoredTable.create(files.scratch(spark, "customers"), rows.where("c_custkey % 3 < 2"), ["c_custkey"], 4)
    stored.put_rows(table, rows.where("c_custkey % 3 > 0"))
    stored.put_rows(table, rows.where("c_custkey = 1").withColumn("c_name", F.lit("other")))
    counts = table.history().select("version", F.explode("counts").alias("outcome", "n"))
    return counts.where("version = 1 or outcome <> 'kept'").select(F.col("version").cast("int").alias("version"), "outcome", "n")


@query(f"""select name, "skillsSignature", "primaryExpansion", "cardNumber" from ({SQL['import_primary_cards']})""")
def stored_primary_cards(spark, sf_dir):
    """Primary cards by name and signature in a stored table: known ones get the expansion and number that came last."""
    rows = imports.normalised(etl.raw(spark, sf_dir), "direct")
    old = rows.where(F.length("name") % 2 == 0).select("name", "skillsSignature", F.lit("OLD").alias("primaryExpansion"), F.lit("0").alias("cardNumber")).distinct()
    table = StoredTable.create(files.scratch(spark, "primary"), old, ["name", "skillsSignature"], 8)
    stored.put_primary_cards(table, rows.where("webCardId <> ''"))
    return table.read()


def _stored_cards(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = imports.normalised(etl.raw(spark, sf_dir), form).where("webCardId <> ''")
        old = rows.where(F.length("webCardId") % 2 == 0).select("webCardId", F.lit("Old").alias("name"), F.lit("XX").alias("language"), F.lit("old").alias("skillsSignature"), F.lit("NORMAL").alias("variantType"))
        table = StoredTable.create(files.scratch(spark, "cards"), old, ["webCardId"], 8)
        stored.put_cards(table, rows, form)
        return table.read()

    run.__doc__ = f"Cards by web id in a stored table, upserted as the '{form}' import does."
    return run


for _form, _name, _sql in (("service", "stored_cards", "import_upsert"), ("direct", "stored_cards_direct", "import_upsert_direct")):
    _f = _stored_cards(_form)
    _f.__name__ = _name
    query(f"""select "webCardId", name, language, "skillsSignature", "variantType" from ({SQL[_sql]})""")(_f)


@query(SQL["sparse_merge"])
def stored_patches(spark, sf_dir):
    """Patches change the columns they name in the stored rows, also to null; rows that are not there are not made."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey") % 4
    given = F.when(k == 0, F.array(F.lit("o_orderstatus"), F.lit("o_orderpriority"))).when(k == 1, F.array(F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_orderpriority")))
    patches = orders.where(k < 3).select("o_orderkey", given.alias("given"), F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("o_orderstatus"), F.when(k == 2, "low").alias("o_orderpriority"))
    table = StoredTable.create(files.scratch(spark, "patched"), orders, ["o_orderkey"], 8)
    strangers = patches.limit(1).withColumns({"o_orderkey": F.lit(-1).cast("long"), "given": F.array(F.lit("o_orderstatus"))})
    stored.patch(table, patches.unionByName(strangers))
    return table.read()


@query("select o_orderkey, o_orderstatus from orders where o_orderkey % 3 <> 1")
def stored_deletes(spark, sf_dir):
    """Rows removed by key; a key that is not there stops a strict removal, which leaves no version."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    table = StoredTable.create(files.scratch(spark, "deleted"), orders, ["o_orderkey"], 8)
    stored.remove_rows(table, orders.where("o_orderkey % 3 = 1"), strict=True)
    try:
        stored.remove_rows(table, spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey")), strict=True)
        raise AssertionError("a missing row was removed")
    except KeyError:
        return table.read()


_BATCHES = """
with r as (select *, (row_number() over (order by p_name, p_partkey) - 1) // 50 as batch from part),
b as (select batch, count(*) as n, bool_or(p_size = 13) as bad1, bool_or(p_size = 13 and p_partkey % 2 = 0) as bad2 from r group by 1)
"""


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[StoredTable, DataFrame, DataFrame]:
    """Parts imported in batches twice: the first run fails on all rows of a size, the second on every other one of them."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    old = part.where("p_partkey % 2 = 0").withColumn("p_size", F.lit(-1).cast(part.schema["p_size"].dataType))
    table = StoredTable.create(files.scratch(spark, "parts"), old, ["p_partkey"], 8)
    runs = [stored.import_batches(table, part, ["p_name", "p_partkey"], 50, F.expr(bad)) for bad in ("p_size = 13", "p_size = 13 and p_partkey % 2 = 0")]
    return table, *runs


@query(f"{_BATCHES} select p_partkey, p_name, case when bad2 then -1 else p_size end as p_size from r join b on r.batch = b.batch where not bad2 or p_partkey % 2 = 0")
def stored_batches(spark, sf_dir):
    """The table after both runs: all rows of good batches, and nothing of those that failed in both."""
    return _two_runs(spark, sf_dir)[0].read()


@query(f"{_BATCHES} select batch, n, case when bad1 then 'failed' else 'success' end as first_run, case when bad2 then 'failed' when bad1 then 'success' else 'known' end as second_run from b")
def stored_batch_marks(spark, sf_dir):
    """What became of each batch in either run; batches that the first one brought are not brought again."""
    _, a, b = _two_runs(spark, sf_dir)
    return a.select("batch", "n", F.col("outcome").alias("first_run")).join(b.select("batch", F.col("outcome").alias("second_run")), "batch")


_PUTS = """
with raw as (select cast(event_id as varchar) as id, 'raw' as stage, case when event_id % 3 = 0 then 'again' else props end as body, case when event_id % 3 = 0 then timestamp '2024-02-01' else timestamp '2024-01-01' end as updated_at from events where event_id % 5 <> 0),
done as (select cast(event_id as varchar) as id, 'processed' as stage, event_type as body, timestamp '2024-01-05' as updated_at from events where event_id % 2 = 0)
"""


def _event_records(spark: SparkSession, sf_dir: str) -> stored.Records:
    events = _t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "event_id", "props", "event_type")
    log = stored.Records.create(spark, files.scratch(spark, "events"), 8)
    day = lambda d: F.lit(d).cast("timestamp")
    log.put(events.withColumn("body", F.col("props")), "raw", day("2024-01-01"))
    log.put(events.where("event_id % 2 = 0").withColumn("body", F.col("event_type")), "processed", day("2024-01-05"))
    log.put(events.where("event_id % 3 = 0").withColumn("body", F.lit("again")), "raw", day("2024-02-01"))
    log.take_back(events.where("event_id % 5 = 0"), "raw", day("2024-03-01"))
    return log


@query(f"{_PUTS} select *, case stage when 'raw' then timestamp '2024-01-01' else updated_at end as created_at from (select * from raw union all select * from done)")
def stored_records(spark, sf_dir):
    """Records by id, raw and processed apart, after second puts and records taken back."""
    log = _event_records(spark, sf_dir)
    rows = log.all("raw").unionByName(log.all("processed"))
    return rows.select("id", "stage", "body", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")])


@query(f"{_PUTS} select stage, count(*) as n, count(distinct body) as bodies from (select * from raw union all select * from done) group by 1")
def stored_records_compacted(spark, sf_dir):
    """The same counts after the log was cut down to the last versions."""
    log = _event_records(spark, sf_dir)
    log.compact()
    return log.table.read().groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("body").alias("bodies"))


@query(f"""{ACTIONS}, m as (select battle_id, count(*) filter (marker) as n from f group by 1)
select battle_id, case when battle_id % 3 = 0 then 'Eve vs Bob' else 'Ann vs Bob' end as title, case when battle_id % 3 = 0 then 2 else 1 end as read_in, ceil(n / 2.0)::int as turn_count,
  (select count(*) from m where battle_id % 3 = 0) as n_again, 0::bigint as n_third from m
""")
def reread_battles(spark, sf_dir):
    """Battles of a table after every third log has changed: only these were read again, and none when nothing had changed."""
    before = logs(spark, sf_dir)
    after = before.withColumn("raw_log", F.when(F.col("battle_id") % 3 == 0, F.replace("raw_log", F.lit("Ann"), F.lit("Eve"))).otherwise(F.col("raw_log")))
    table = stored.battle_table(spark, files.scratch(spark, "battles"), before.schema["battle_id"].dataType.simpleString(), 8)
    stored.reread(table, before, 1)
    again, third = (stored.reread(table, after, 1) for _ in range(2))
    return table.read().select("battle_id", "title", "read_in", "turn_count", F.lit(again).cast("long").alias("n_again"), F.lit(third).cast("long").alias("n_third"))


@query("""
with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, date_trunc('month', min(o_orderdate)) as modified from orders group by 1)
select month, n, case when substr(month, 1, 4) = '1996' then 'archive/1996' else 'active' end as place from m where not (modified < timestamp '1995-01-01' - interval '30 days') or substr(month, 1, 4) = '1996'
""")
def archived_tree(spark, sf_dir):
    """Orders in a folder for each month: one year's are moved to the archive, old ones removed, by a job that is stopped
    half-way and finished by the next."""
    root = files.scratch(spark, "months")
    month = F.date_format("o_orderdate", "yyyy-MM")
    _t(spark, sf_dir, "orders").select(month.alias("month"), F.col("o_orderkey").cast("string").alias("value")).repartition("month").write.partitionBy("month").text(f"{root}/active")
    names = [n.split("=")[1] for n in Folder(spark, f"{root}/active").names() if n.startswith("month=")]
    index = spark.createDataFrame([(f"{root}/active/month={n}", n) for n in names], "path string, name string").withColumn("modified", F.to_timestamp("name", "yyyy-MM").cast("timestamp_ntz"))
    journal = retention.Journal(spark, f"{root}/journal")
    journal.plan(retention.archiving(index, 1996, f"{root}/archive"))
    journal.plan(retention.removing(index, F.lit("1995-01-01").cast("timestamp_ntz"), 30))

    def fails(kind: str, path: str, target: str | None) -> None:
        if path[-1] in "05":
            raise OSError("stopped")
        retention.perform(kind, path, target)

    try:
        journal.finish(fails)
    except Exception as e:
        if "stopped" not in str(e):
            raise
    journal.finish()
    lines = spark.read.option("recursiveFileLookup", True).text([f"{root}/active", f"{root}/archive"]).select(F.input_file_name().alias("file"))
    place = F.when(F.contains("file", F.lit("/archive/")), F.concat(F.lit("archive/"), F.regexp_extract("file", "/archive/([0-9]+)/", 1))).otherwise("active")
    return lines.select(F.regexp_extract("file", "([0-9]{4}-[0-9]{2})/[^/]*$", 1).alias("month"), place.alias("place")).groupBy("month", "place").agg(F.count("*").alias("n"))
