"""Places that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import SLICE_BYTES

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than one in SHARE of all rows is hot; there are at most SHARE such keys.
SHARE = 1000
#: One in SAMPLE documents is read ahead to find hot keys.
SAMPLE = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one; a cluster, whose
    executors could not read that, an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Spark drops the shuffle files of each query in it when the query ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def small_batches(spark: SparkSession, most: int = SLICE_BYTES) -> None:
    """Rows reach Python in batches of about ``most`` bytes from now on, unless the session has a bound of its own. Spark's
    64 MB lie several times in an executor: in the vectors, in the stream, and in the worker."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(most))


def written(df: DataFrame, name: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and outlives lost executors. Results of
    earlier calls in ``done``, which nothing needs any more, are removed."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    with without_shuffle_files(spark):
        df.write.parquet(path)
    forget(*done)
    out = spark.read.schema(schema).parquet(path)
    out._written_to = path
    return out


def bucketed(df: DataFrame, name: str, keys: list[str], number: int, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder in buckets and read again: joins of such frames on ``keys`` need no shuffle.

    Only the catalogue knows how files are dealt to buckets, so the table is entered there; the frame that is read keeps
    that, and the entry is dropped at once (its files stay). Rows that come in ``number`` partitions by ``keys`` make one
    file a bucket."""
    spark = df.sparkSession
    table, path = f"marlstone_{uuid.uuid4().hex}", new_path(spark, name)
    with without_shuffle_files(spark):
        df.write.bucketBy(number, *keys).option("path", path).saveAsTable(table)
    forget(*done)
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    out._written_to = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove what ``written`` wrote for these frames."""
    for frame in frames:
        if path := getattr(frame, "_written_to", None):
            remove(frame.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names made of these that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with a table that has one row for each key and, in ``n``, the number of rows with it.

    Hot keys, of which there are at most ``SHARE``, are joined where the rows lie; only the others are shuffled.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * SHARE > F.lit(max(total, SHARE * SHARE)))
    named = [c for c in table.columns if c not in keys]
    met = rows.join(F.broadcast(hot.select(*keys, F.struct(*named).alias("_hot"))), keys, "left")
    near = met.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in named])
    far = met.where("_hot is null").select(rows.columns).join(table.where(F.col(n) * SHARE <= F.lit(max(total, SHARE * SHARE))), keys, how)
    return near.unionByName(far.select(*rows.columns, *named))
