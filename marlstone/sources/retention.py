"""Files archived and removed by a journal, so that a job that stops half-way is finished by the next one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.delivery import _place
from marlstone.sources.tables import Folder

_ACTS = "kind string, path string, target string"


def archiving(index: DataFrame, year: int, archive: str) -> DataFrame:
    """Acts (kind, path, target) that move what has a name beginning with the year to a folder of that year."""
    target = F.concat(F.lit(f"{archive.rstrip('/')}/{year}/"), "name")
    return index.where(F.startswith("name", F.lit(f"{year}-"))).select(F.lit("move").alias("kind"), "path", target.alias("target"))


def removing(index: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Acts that delete what was last changed more than ``days`` days ago."""
    return index.where(F.col("modified") < now - F.make_interval(days=F.lit(days))).select(F.lit("delete").alias("kind"), "path", F.lit(None).cast("string").alias("target"))


def perform(kind: str, path: str, target: str | None) -> None:
    """One act, from a task; what was done before is left alone."""
    from pyarrow import fs

    where, source = _place(path)
    there = lambda at: where.get_file_info(at).type != fs.FileType.NotFound
    if not there(source):
        if kind == "move" and not there(_place(target)[1]):
            raise FileNotFoundError(path)
        return
    if kind == "move":
        at = _place(target)[1]
        if there(at):
            raise FileExistsError(target)
        where.create_dir(at.rsplit("/", 1)[0], recursive=True)
        where.move(source, at)
    elif where.get_file_info(source).type == fs.FileType.Directory:
        where.delete_dir(source)
    else:
        where.delete_file(source)


class Journal:
    """Plans of acts in a folder of their own. A plan that is written counts as a whole, and stays until all its acts are
    done; acts can be repeated. Tasks share the acts out and reach the files themselves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def plan(self, acts: DataFrame) -> str:
        name = uuid.uuid4().hex
        acts.select("kind", "path", "target").write.parquet(f"{self.folder.path}/acts/{name}")
        self.folder.put_new(f"open/{name}", "")
        return name

    def open(self) -> list[str]:
        return sorted(self.folder.names("open"))

    def finish(self, act: Callable[[str, str, str | None], None] = perform) -> int:
        """Do what all open plans still ask for; the number of plans that are done. The first failure stops the job, and
        leaves its plan open."""

        def run(rows: Iterator) -> None:
            for r in rows:
                act(r["kind"], r["path"], r["target"])

        done = 0
        for name in self.open():
            self.spark.read.schema(_ACTS).parquet(f"{self.folder.path}/acts/{name}").foreachPartition(run)
            self.folder.remove(f"open/{name}")
            self.folder.remove(f"acts/{name}")
            done += 1
        return done
