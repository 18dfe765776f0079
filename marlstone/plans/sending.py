"""Queries that send rows, or call a function on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import imports
from marlstone.plans.catalog import _t, query
from marlstone.sources import delivery, files


@query("""
with r as (select c_custkey, (row_number() over (order by c_custkey) - 1) // 100 as batch from customer)
select batch, count(*) as n, case when bool_or(c_custkey % 1000 = 7) then 'ValueError: refused' end as first_error, case when bool_or(c_custkey % 1000 = 7) then 2 else 1 end as first_tries, not bool_or(c_custkey % 1000 = 7) as known, 1 as received from r group by 1
""")
def sent_batches(spark, sf_dir):
    """Customers sent in batches of 100, twice. The service refuses some of them at first; the second run sends these only,
    and every batch has arrived once in the end."""
    path = files.scratch(spark, "sending")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")

    def service(strict: bool):
        def take(batch: list[dict], key: str) -> None:
            import uuid

            if strict and any(r["c_custkey"] % 1000 == 7 for r in batch):
                raise ValueError("refused")
            delivery.put_file(f"{path}/received/{key}/{uuid.uuid4().hex}.txt", str(len(batch)))

        return take

    first = delivery.send_batches(rows, ["c_custkey"], 100, service(True), path, tries=2, pause=0)
    second = delivery.send_batches(rows, ["c_custkey"], 100, service(False), path, tries=2, pause=0)
    arrived = spark.read.option("recursiveFileLookup", True).text(f"{path}/received").select(F.regexp_extract(F.input_file_name(), "/received/([^/]+)/", 1).alias("key"))
    counts = arrived.groupBy("key").agg(F.count("*").cast("int").alias("received"))
    seen = first.select("key", "batch", "n", F.col("error").alias("first_error"), F.col("tries").alias("first_tries")).join(second.select("key", "known"), "key")
    return seen.join(counts, "key", "left").drop("key")


@query("""
select conv_id, turn, case when role = 'user' then 'ValueError: user' end as error, case when role <> 'user' then length(text) end as size from conversations
""")
def called_at_once(spark, sf_dir):
    """A function called on every row, three calls at a time, with results in the order of the rows; errors become rows."""

    def size(row: dict) -> dict:
        if row["role"] == "user":
            raise ValueError("user")
        return {"size": len(row["text"])}

    rows = imports.attempted(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), size, "size double", at_once=3)
    return rows.select("conv_id", "turn", "error", F.col("size").cast("long").alias("size"))
