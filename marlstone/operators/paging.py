"""Deep pages: a stored order with the number of rows in each of its ranges, so that any page reads only where it lies."""

from __future__ import annotations

import bisect
import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.search import DEFAULT_ROWS, MOST_ROWS
from marlstone.sources.tables import Folder

_RANGE, _PLACE = "_range", "_place"
#: The low bits of the ids that Spark deals out, which count the rows of a partition.
_BITS = 33


class PageIndex:
    """Rows in an order, in ranges of about ``rows_a_range``; what is kept beside them is one number for each range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self._known = json.loads(self.folder.read("ranges.json"))
        self._ends = list(accumulate(self._known["counts"]))

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], path: str, rows_a_range: int = 1 << 20) -> PageIndex:
        """Rows are dealt to ranges by samples, sorted within them and written with their place. ``order`` should end with a
        unique key, as pages of ties would depend on the run otherwise."""
        if {_RANGE, _PLACE} & set(df.columns):
            raise ValueError(f"there is a column {_RANGE} or {_PLACE} already")
        ranges = max(1, -(-df.count() // rows_a_range))
        dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        placed = dealt.withColumn(_PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _BITS) - 1))).withColumn(_RANGE, F.spark_partition_id())
        placed.write.partitionBy(_RANGE).parquet(f"{path}/rows")
        folder, spark = Folder(df.sparkSession, path), df.sparkSession
        counts = [0] * ranges
        if any(n.startswith(_RANGE) for n in folder.names("rows")):
            for r in spark.read.parquet(f"{path}/rows").groupBy(_RANGE).agg(F.max(_PLACE).alias("last")).collect():
                counts[r[_RANGE]] = r["last"] + 1
        folder.put_new("ranges.json", json.dumps({"schema": json.loads(df.schema.json()), "counts": counts}))
        return cls(spark, path)

    @property
    def total(self) -> int:
        return self._ends[-1] if self._ends else 0

    def rows(self, skip: int, take: int) -> DataFrame:
        """The rows from place ``skip`` on, ``take`` at most and in order, however deep: of the ranges they lie in, read by
        their places there."""
        schema = StructType.fromJson(self._known["schema"])
        begin, end = max(0, skip), min(self.total, max(0, skip) + max(0, take))
        first, last = bisect.bisect_right(self._ends, begin), bisect.bisect_left(self._ends, end)
        if begin >= end:
            return self.spark.createDataFrame([], schema)
        before = lambda r: self._ends[r - 1] if r else 0
        within = [(F.col(_RANGE) == r) & (F.col(_PLACE) >= begin - before(r)) & (F.col(_PLACE) < end - before(r)) for r in range(first, last + 1)]
        paths = [f"{self.folder.path}/rows/{_RANGE}={r}" for r in range(first, last + 1) if self._known["counts"][r]]
        wide = StructType.fromJson(self._known["schema"]).add(_PLACE, "long").add(_RANGE, "integer")
        found = self.spark.read.option("basePath", f"{self.folder.path}/rows").schema(wide).parquet(*paths)
        condition = within[0]
        for w in within[1:]:
            condition = condition | w
        return found.where(condition).orderBy(_RANGE, _PLACE).select(*schema.names)

    def page(self, skip: int = 0, take: int = DEFAULT_ROWS) -> DataFrame:
        """One page; ``take`` is at most 100."""
        return self.rows(skip, min(take, MOST_ROWS))

    def last_page(self, size: int = DEFAULT_ROWS) -> DataFrame:
        return self.rows((self.total - 1) // size * size, size)

    def envelope(self, skip: int = 0, take: int = DEFAULT_ROWS) -> dict:
        """total, skip, take, has_more; the ``take`` that was asked for counts, not the cap on it."""
        return {"total": self.total, "skip": skip, "take": take, "has_more": skip + take < self.total}

    def pages(self, size: int = DEFAULT_ROWS) -> int:
        return -(-self.total // size)
