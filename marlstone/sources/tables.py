"""Stored tables: rows in buckets by key, whose versions are lists of files.

A version is a small JSON list of the folders of each bucket, bounded by the number of buckets and what was appended to
them since they were last rewritten. A change is staged beside the data and takes effect when its list is put in place
under the next number, which only one writer can do; what a stopped job left behind is never read. A merge reads and
rewrites the buckets that its changes fall into; all others keep their files, and both versions share them. Whoever worked
on an older version than the last one is refused if the same buckets have changed since, and put behind it if others have.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The folder name of a bucket; no column of a stored table may have it.
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since the version that a change is based on."""


class Folder:
    """Files of a folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._at(name))] if fs.exists(self._at(name)) else []

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Put a whole file in place, unless there is one: then nothing happens and the answer is no."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self._fs().create(self._at(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(self._at(draft), self._at(name), how)
        except Exception as e:
            self.remove(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        fs, target = self._fs(), self._at(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._at(name), target):
            raise OSError(f"{name} could not be moved to {to}")

    def remove(self, name: str = "") -> bool:
        return self._fs().delete(self._at(name), True)


class StoredTable:
    """A table with one row for each value of ``keys`` (as ``merge`` leaves it), or of several (as ``append`` may)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @classmethod
    def create(cls, path: str, rows: DataFrame, keys: list[str], buckets: int = 16) -> StoredTable:
        """A new table whose version 0 holds ``rows``. Buckets should be so many that one fits a task with ease."""
        table = cls(rows.sparkSession, path)
        if BUCKET in rows.columns:
            raise ValueError(f"there is a column {BUCKET} already")
        first = {"version": 0, "keys": keys, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": {}, "touched": [], "counts": {}, "ledger": []}
        name, folders = table._stage(rows, keys, buckets)
        first["files"], first["touched"] = {b: [f] for b, f in folders.items()}, sorted(folders)
        if not table.folder.put_new("versions/0.json", json.dumps(first)):
            table.folder.remove(name)
            raise Conflict(f"there is a table at {path} already")
        return table

    # -- versions

    def version(self) -> int:
        """The last version's number."""
        return max(int(n.split(".")[0]) for n in self.folder.names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.folder.read(f"versions/{self.version() if version is None else version}.json"))

    def history(self) -> DataFrame:
        """version, base, touched (buckets), counts of every version that is kept."""
        found = [self.manifest(int(n.split(".")[0])) for n in self.folder.names("versions") if n.endswith(".json")]
        return self.spark.createDataFrame([(m["version"], m.get("base"), len(m["touched"]), m["counts"]) for m in found], "version long, base long, touched long, counts map<string,long>")

    # -- reading

    def _frame(self, manifest: dict, folders: Iterable[str]) -> DataFrame:
        schema, paths = StructType.fromJson(manifest["schema"]), [f"{self.folder.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._frame(m, [f for folders in m["files"].values() for f in folders])

    def bucket_of(self, keys: list[Column] | None = None, manifest: dict | None = None) -> Column:
        m = manifest or self.manifest()
        return _bucket(keys or [F.col(k) for k in m["keys"]], m["buckets"])

    def lookup(self, wanted: DataFrame, version: int | None = None) -> DataFrame:
        """Rows with the keys of ``wanted``, of whose buckets alone files are read."""
        m = self.manifest(version)
        # At most as many rows as there are buckets.
        hit = [str(r[0]) for r in wanted.select(_bucket([F.col(k) for k in m["keys"]], m["buckets"])).distinct().collect()]
        rows = self._frame(m, [f for b in hit for f in m["files"].get(b, [])])
        return rows.join(wanted.select(m["keys"]).distinct(), m["keys"], "left_semi")

    def get(self, *key, version: int | None = None) -> DataFrame:
        """The rows of one key, from its bucket; a key that is not there gives none."""
        m = self.manifest(version)
        types = StructType.fromJson(m["schema"])
        same = [F.col(k).eqNullSafe(F.lit(v).cast(types[k].dataType)) for k, v in zip(m["keys"], key, strict=True)]
        bucket = self.spark.range(1).select(_bucket([F.lit(v).cast(types[k].dataType) for k, v in zip(m["keys"], key, strict=True)], m["buckets"])).first()[0]
        rows = self._frame(m, m["files"].get(str(bucket), []))
        for c in same:
            rows = rows.where(c)
        return rows

    # -- writing

    def _stage(self, rows: DataFrame, keys: list[str], buckets: int) -> tuple[str, dict[str, str]]:
        """(folder, folder of each bucket that got rows)."""
        name = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, _bucket([F.col(k) for k in keys], buckets)).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.folder.path}/{name}")
        return name, {n.split("=")[1]: f"{name}/{n}" for n in self.folder.names(name) if n.startswith(f"{BUCKET}=")}

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], base: int | None = None, ledger: tuple[str, ...] = ()) -> int:
        """A new version in which ``how(rows of the touched buckets, changes)`` stands for these rows; its number.

        ``changes`` hold the keys and one row for each; they are computed once. What ``how`` gives as ``outcome`` is counted
        in the version's list and is no column of the table.
        """
        m = self.manifest(base)
        keys = m["keys"]
        name, parts = self._stage(changes, keys, m["buckets"])
        try:
            staged = self.spark.read.schema(changes.schema).parquet(*[f"{self.folder.path}/{f}" for f in parts.values()]) if parts else changes.limit(0)
            if not staged.groupBy(*keys).count().where("count > 1").isEmpty():
                raise ValueError("changes hold a key several times")
            rows = how(self._frame(m, [f for b in parts for f in m["files"].get(b, [])]), staged)
            columns = [f["name"] for f in m["schema"]["fields"]]
            counted = "outcome" in rows.columns and "outcome" not in columns
            made, folders = self._stage(rows.select(*columns, *(["outcome"] if counted else [])), keys, m["buckets"])
        finally:
            self.folder.remove(name)
        try:
            counts = {}
            if counted and folders:
                found = self.spark.read.schema("outcome string").parquet(*[f"{self.folder.path}/{f}" for f in folders.values()])
                counts = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
            if set(folders) - set(parts):
                raise ValueError("a merge may not move rows to other keys")
            return self._commit(m, {b: [folders[b]] if b in folders else [] for b in parts}, counts, ledger, replace=True)
        except Exception:
            self.folder.remove(made)
            raise

    def append(self, rows: DataFrame) -> int:
        """A new version with rows added to their buckets; nothing is read or rewritten, so writers never conflict."""
        m = self.manifest()
        _, folders = self._stage(rows.select([f["name"] for f in m["schema"]["fields"]]), m["keys"], m["buckets"])
        return self._commit(m, {b: [f] for b, f in folders.items()}, {}, (), replace=False)

    def _commit(self, base: dict, files: dict[str, list[str]], counts: dict, ledger: tuple[str, ...], replace: bool) -> int:
        while True:
            last = self.manifest()
            for number in range(base["version"] + 1, last["version"] + 1) if replace else ():
                if set(self.manifest(number)["touched"]) & set(files):
                    raise Conflict(f"version {number} changed the same buckets since version {base['version']}")
            now = dict(last["files"])
            for b, folders in files.items():
                now[b] = folders if replace else [*now.get(b, []), *folders]
            new = last | {"version": last["version"] + 1, "base": base["version"], "files": {b: f for b, f in now.items() if f}, "touched": sorted(files), "counts": counts, "ledger": [*last["ledger"], *ledger]}
            if self.folder.put_new(f"versions/{new['version']}.json", json.dumps(new)):
                return new["version"]

    def drop_before(self, version: int) -> int:
        """Forget versions below a number, and remove what only they hold; the number of folders that went."""
        kept, old = [], []
        for n in (n for n in self.folder.names("versions") if n.endswith(".json")):
            (kept if int(n.split(".")[0]) >= version else old).append(self.manifest(int(n.split(".")[0])))
        held = lambda ms: {f for m in ms for folders in m["files"].values() for f in folders}
        for m in old:
            self.folder.remove(f"versions/{m['version']}.json")
        gone = held(old) - held(kept)
        for f in gone:
            self.folder.remove(f)
        return len(gone)


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
