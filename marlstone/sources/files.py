"""Readers and writers of record files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``; on one machine, where it is unset, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tasks for each core that list folders, and that read small files.
LISTERS, READERS = 4, 32


@contextmanager
def many_folders(spark: SparkSession) -> Iterator[None]:
    """Folders that a reader made here finds are listed by a few tasks for each core, each of which lists many. By Spark's
    setting there are as many tasks as folders, up to 10,000, which take longer to start than folders to list."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_files(rows: DataFrame) -> DataFrame:
    """Rows of small files, each read by itself, in a number of tasks that does not grow with that of the files."""
    return rows.coalesce(READERS * rows.sparkSession.sparkContext.defaultParallelism)


def json_arrays(spark: SparkSession, path: str, schema, pattern: str = "*.json") -> DataFrame:
    """Records of files that hold a JSON array each, with ``_file`` and their place ``_index`` in it. A file that holds
    something else is one row with its text in ``_bad``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    is_array = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("ARRAY<")), F.lit(False))
    rows = files.select(F.col("_metadata.file_path").alias("_file"), F.when(~is_array, F.col("value")).alias("_bad"), F.when(is_array, F.from_json("value", ArrayType(schema))).alias("_rows"))
    out = rows.select("_file", "_bad", F.posexplode_outer("_rows").alias("_index", "_row"))
    return out.where(F.col("_row").isNotNull() | F.col("_bad").isNotNull()).select("_row.*", "_file", "_index", "_bad")


def regional_arrays(spark: SparkSession, path: str, schema, patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records with their region; files that were skipped): each region is a folder with a pattern of its files."""
    parts = [json_arrays(spark, f"{path}/{region}", schema, pattern).withColumn("_region", F.lit(region)) for region, pattern in patterns.items()]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.where("_bad is null").drop("_bad"), rows.where("_bad is not null").select("_region", "_file")


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def last_file_wins(df: DataFrame, key: str) -> DataFrame:
    """Of the rows of a key the last one of the file last by name."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_index")))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def html_cache(spark: SparkSession, path: str, name_first: bool = False, pattern: str = "*.html") -> DataFrame:
    """id, html, path of cached pages: the id is in the first 2,000 characters (/detail/ID/), else the file's name; with
    ``name_first`` the other way round."""
    with many_folders(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    pages = found.select(F.col("content").cast("string").alias("value"), "_metadata")  # as the text reader, but for what that sets up for each file
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.html$", 1)
    inside = F.regexp_extract(F.substring("value", 1, 2000), r"/detail/(\d+)/", 1)
    ways = [F.nullif(inside, F.lit("")), F.nullif(name, F.lit(""))]
    return small_files(pages.select(F.coalesce(*(ways[::-1] if name_first else ways)).alias("id"), F.col("value").alias("html"), F.col("_metadata.file_path").alias("path")))


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """path, name, ext, length, modified of the files below a folder, without their content."""
    with many_folders(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = small_files(found.select("path", "length", F.col("modificationTime").alias("modified")))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "modified")


def expired(index: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return index.where(F.col("modified") < now - F.make_interval(days=F.lit(days)))


def resolved(rows: DataFrame, key: str, ladders: list[tuple[DataFrame, str, str]], fallbacks: list[str]) -> DataFrame:
    """``path`` of each row: the first file index that has its key, else the first fallback column, else ''; and found."""
    for i, (index, on, path) in enumerate(ladders):
        rows = rows.join(index.groupBy(F.col(on).alias(key)).agg(F.min(path).alias(f"_p{i}")), key, "left")
    held = F.coalesce(*[f"_p{i}" for i in range(len(ladders))])
    out = rows.withColumn("found", held.isNotNull()).withColumn("path", F.coalesce(held, *[F.nullif(F.col(c), F.lit("")) for c in fallbacks], F.lit("")))
    return out.drop(*[f"_p{i}" for i in range(len(ladders))])


def write_by(df: DataFrame, path: str, by: list[str], default: str = "unknown") -> None:
    """JSON files in a folder for each value; missing values go to the default's folder, and only folders written to are replaced."""
    for c in by:
        df = df.withColumn(c, F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)))
    df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def read_by(spark: SparkSession, path: str, schema, **where: str) -> DataFrame:
    """What ``write_by`` wrote, of the folders asked for only."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in where.items()], F.lit(True)))


def stamped(df: DataFrame, required: list[str], now: Column) -> DataFrame:
    """Rows with created_at (kept if there) and updated_at; a row without a required value stops the job."""
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    created = F.coalesce(F.col("created_at"), now) if "created_at" in df.columns else now
    return df.withColumn("created_at", created).withColumn("updated_at", now)


def price_histories(prices: DataFrame, card: str, entry: list[str]) -> DataFrame:
    """card and its prices in order; the first of ``entry`` is the time. One card's history is bounded by its dates."""
    return prices.groupBy(card).agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("history"))


def of_year(index: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(files to archive, files that stay) of an index: those whose name begins with the year."""
    old = F.startswith("name", F.lit(f"{year}-"))
    return index.where(old), index.where(~old)


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def cached_first(ids: DataFrame, flat: DataFrame, indexed: DataFrame, cached_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, html of pages in the flat folder, else in the index, else null; the ids still to be fetched, none if only the
    cache counts)."""
    one = lambda df, name: df.groupBy("id").agg(F.min_by("html", "path").alias(name))
    rows = ids.join(one(flat, "_flat"), "id", "left").join(one(indexed, "_indexed"), "id", "left").select("id", F.coalesce("_flat", "_indexed").alias("html"))
    return rows, rows.where(F.col("html").isNull() & F.lit(not cached_only)).select("id")


def file_counts(index: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """kind, n, bytes of files below a folder with an extension; a kind without files counts 0."""
    flags = [F.when(F.contains("path", F.lit(f"/{folder}/")) & (F.col("ext") == ext), F.lit(kind)) for kind, (folder, ext) in kinds.items()]
    found = index.select(F.explode(F.array_compact(F.array(*flags))).alias("kind"), "length").groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    every = index.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(found, "kind", "left").na.fill(0, ["n", "bytes"])


def cache_structure(index: DataFrame, root: str) -> DataFrame:
    """One row: folders below the root, and files that lie in it directly."""
    below = F.split(F.regexp_replace("path", f"^.*{re.escape(root.rstrip('/'))}/", ""), "/")
    rows = index.select(F.when(F.size(below) > 1, below[0]).alias("folder"))
    return rows.agg(F.countDistinct("folder").alias("n_folders"), F.count_if(F.col("folder").isNull()).alias("n_flat"))


def loaded(rows: DataFrame, size: int, send: Callable[[list[dict]], None]) -> DataFrame:
    """batch, n, error of rows sent in batches of ``size`` from where they lie; a batch that fails does not stop others."""
    import pandas as pd

    def run(parts):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def out(some):
            nonlocal number
            number += 1
            try:
                send(some)
                return {"batch": number, "n": len(some), "error": None}
            except Exception as e:  # noqa: BLE001 - the error is the result
                return {"batch": number, "n": len(some), "error": str(e)}

        for part in parts:
            held += part.to_dict("records")
            done = [out(held[at : at + size]) for at in range(0, len(held) - size + 1, size)]
            held = held[len(done) * size :]
            yield pd.DataFrame(done, columns=["batch", "n", "error"])
        yield pd.DataFrame([out(held)] if held else [], columns=["batch", "n", "error"])

    return rows.mapInPandas(run, "batch long, n long, error string")


def clean_rows(df: DataFrame, json_lists: list[str], arrays: list[str], names: list[str]) -> DataFrame:
    """Unparsable or missing JSON lists become '[]', missing arrays empty, missing names empty text."""
    for c in json_lists:
        df = df.withColumn(c, F.when(F.startswith(F.schema_of_variant(F.try_parse_json(F.col(c))), F.lit("ARRAY<")), F.col(c)).otherwise("[]"))
    for c in arrays:
        df = df.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    for c in names:
        df = df.withColumn(c, F.coalesce(c, F.lit("")))
    return df
