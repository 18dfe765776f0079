"""Imports into stored tables: upserts, patches and batches that count as a whole or not at all; records by id in stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import imports
from marlstone.operators.records import latest, upsert
from marlstone.sources.tables import Folder, StoredTable


def put_primary_cards(table: StoredTable, cards: DataFrame, base: int | None = None) -> int:
    """Primary cards by (name, signature): new ones are inserted, known ones get the expansion and number that came last."""
    keys = ["name", "skillsSignature"]
    last = latest(cards, keys, [F.desc("webCardId")]).select(*keys, "primary_code", "cardNumber", "webCardId")
    return table.merge(last, imports.primary_cards, base)


def put_cards(table: StoredTable, cards: DataFrame, form: str = "service", base: int | None = None) -> int:
    """Cards by web id, under the rules of ``imports.card_upsert``."""
    return table.merge(latest(cards, ["webCardId"], [F.desc("name")]), lambda old, new: imports.card_upsert(old, new, form), base)


def put_rows(table: StoredTable, rows: DataFrame, policy: dict[str, str] | None = None, base: int | None = None) -> int:
    """Rows by key, column by column as ``records.upsert`` says."""
    keys = table.manifest(base)["keys"]
    return table.merge(rows, lambda old, new: upsert(old, new, keys, policy), base)


def patch(table: StoredTable, patches: DataFrame, given: str = "given", base: int | None = None) -> int:
    """Rows that are there get the values of the columns that a patch names, also null ones; others are not made."""
    key = table.manifest(base)["keys"][0]
    return table.merge(patches, lambda old, new: imports.sparse_update(old, new, key, given), base)


def remove_rows(table: StoredTable, keys: DataFrame, strict: bool = False, base: int | None = None) -> int:
    """A version without the rows of these keys. With ``strict`` a key that is not there stops the job, and no version is
    made."""
    names = table.manifest(base)["keys"]

    def without(old: DataFrame, gone: DataFrame) -> DataFrame:
        if strict and not gone.join(old, names, "left_anti").isEmpty():
            raise KeyError("there is no row with some of these keys")
        return old.join(gone, names, "left_anti")

    return table.merge(keys.select(names).distinct(), without, base)


# -- batches


def batches(table: StoredTable) -> DataFrame:
    """batch, n, digest, outcome, run of every batch that was ever imported."""
    folders = table.manifest()["ledger"]
    schema = "batch long, n long, digest string, outcome string, run string"
    return table.spark.read.schema(schema).parquet(*[f"{table.folder.path}/{f}" for f in folders]) if folders else table.spark.createDataFrame([], schema)


def import_batches(table: StoredTable, rows: DataFrame, order: list[str], size: int, failing: Column, policy: dict[str, str] | None = None) -> DataFrame:
    """batch, n, digest, outcome of rows imported in batches of ``size`` in this order, each as a whole: of a batch with a
    failing row nothing gets into the table.

    Rows are staged with their batch, the batches' marks beside them; one version brings the rows of all good batches and
    the marks, so neither is there without the other, wherever the job stops. Batches that an earlier run brought, known by
    their digest, are marked 'known' and not brought again. Of a key in several batches the last row counts.
    """
    keys, run = table.manifest()["keys"], uuid.uuid4().hex
    staged, marks = (f"{table.folder.path}/batches/{run}/{x}" for x in ("rows", "marks"))
    imports.in_batches(rows, order, size, failing).write.parquet(staged)
    placed = table.spark.read.parquet(staged)
    content = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    found = placed.groupBy("batch").agg(F.count("*").alias("n"), F.concat_ws("-", F.count("*"), content, F.max(F.xxhash64(*rows.columns))).alias("digest"), F.first("outcome").alias("outcome"))
    known = batches(table).where("outcome = 'success'").select("digest").distinct().withColumn("_known", F.lit(True))
    outcome = F.when((F.col("outcome") == "success") & F.col("_known"), "known").otherwise(F.col("outcome"))
    found.join(known, "digest", "left").select("batch", "n", "digest", outcome.alias("outcome"), F.lit(run).alias("run")).write.parquet(marks)
    marked = table.spark.read.parquet(marks)
    good = placed.drop("outcome").join(marked.where("outcome = 'success'").select("batch"), "batch", "left_semi")
    last = latest(good, keys, [F.col(c).desc() for c in order]).select(rows.columns)
    table.merge(last, lambda old, new: upsert(old, new.select(old.columns), keys, policy), ledger=(f"batches/{run}/marks",))
    table.folder.remove(f"batches/{run}/rows")
    return marked.drop("run")


# -- records by id


class Records:
    """Texts by id in stages ('raw', 'processed', ...) and, if need be, kinds: an append-only log of what was put.

    ``put`` adds versions, ``get`` finds the last one by reading the id's bucket alone, ``take_back`` adds a mark that an
    id is gone, ``compact`` leaves the last versions only.
    """

    COLUMNS = "id string, kind string, stage string, body string, created_at timestamp, updated_at timestamp, put long, gone boolean"

    def __init__(self, table: StoredTable):
        self.table = table

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int = 16) -> Records:
        return cls(StoredTable.create(path, spark.createDataFrame([], cls.COLUMNS), ["id"], buckets))

    def put(self, rows: DataFrame, stage: str, now: Column, kind: Column | None = None) -> int:
        """Bodies (``id``, ``body``) of a stage, one for each id and kind; ids are required. ``created_at`` stays that of the
        first put."""
        if not rows.where(F.col("id").isNull() | (F.col("id") == "")).isEmpty():
            raise ValueError("id is missing")
        number = self.table.version() + 1
        new = rows.select(F.col("id").cast("string").alias("id"), (F.lit("") if kind is None else kind).alias("kind"), F.lit(stage).alias("stage"), F.col("body").cast("string").alias("body"), now.cast("timestamp").alias("updated_at"))
        before = self.last(self.table.lookup(new), True).where(~F.col("gone")).select("id", "kind", "stage", F.col("created_at").alias("_created"))
        met = new.join(before, ["id", "kind", "stage"], "left").withColumn("created_at", F.coalesce("_created", "updated_at"))
        return self.table.append(met.withColumn("put", F.lit(number).cast("long")).withColumn("gone", F.lit(False)))

    def take_back(self, ids: DataFrame, stage: str, now: Column) -> int:
        number = self.table.version() + 1
        held = self.last(self.table.lookup(ids)).where(F.col("stage") == stage)
        return self.table.append(held.withColumn("updated_at", now.cast("timestamp")).withColumn("put", F.lit(number).cast("long")).withColumn("gone", F.lit(True)))

    @staticmethod
    def last(rows: DataFrame, with_gone: bool = False) -> DataFrame:
        """The last version of each id, kind and stage, without those that are gone."""
        newest = F.max_by(F.struct("body", "created_at", "updated_at", "put", "gone"), "put").alias("v")
        out = rows.groupBy("id", "kind", "stage").agg(newest).select("id", "kind", "stage", "v.*")
        return out if with_gone else out.where(~F.col("gone"))

    def get(self, id_: str, stage: str, kind: str = "") -> DataFrame:
        return self.last(self.table.get(id_)).where((F.col("stage") == stage) & (F.col("kind") == kind))

    def all(self, stage: str, version: int | None = None) -> DataFrame:
        return self.last(self.table.read(version).where(F.col("stage") == stage))

    def compact(self) -> int:
        """A version whose files hold the last versions only."""
        rows = self.table.read()
        return self.table.merge(rows.select("id").distinct(), lambda old, _: self.last(old))


# -- battles read from logs


BATTLES = "battle_id {0}, player1 string, player2 string, winner string, turn_count int, title string, text_hash string, reader int, read_in int"


def battle_table(spark: SparkSession, path: str, id_type: str = "string", buckets: int = 16) -> StoredTable:
    """An empty table of what was read from logs: with the hash of the text, the reader's version, and the run."""
    return StoredTable.create(path, spark.createDataFrame([], BATTLES.format(id_type)), ["battle_id"], buckets)


def reread(table: StoredTable, logs: DataFrame, reader: int, text: str = "raw_log") -> int:
    """Read the logs that are new, have another text than before, or were read by another version of the reader; the number
    of these. All other logs are compared by hash and not read, and their rows stay as they are."""
    from marlstone.operators import battle

    hashed = logs.select("battle_id", text, F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_hash"))
    known = table.read().select("battle_id", "text_hash", F.col("reader").alias("_reader"))
    todo = hashed.join(known.where(F.col("_reader") == reader), ["battle_id", "text_hash"], "left_anti")
    staged = f"{table.folder.path}/changed/{uuid.uuid4().hex}"
    todo.write.parquet(staged)
    changed = table.spark.read.schema(hashed.schema).parquet(staged)
    number = changed.count()
    if number:
        run = table.version() + 1
        rows = battle.battles(changed, text=text).withColumns({"reader": F.lit(reader), "read_in": F.lit(run)})
        columns = [f["name"] for f in table.manifest()["schema"]["fields"]]
        put_rows(table, rows.select(columns), dict.fromkeys(columns, "new"))
    Folder(table.spark, staged).remove()
    return number
