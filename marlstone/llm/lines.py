"""Line dedup with a deletion-neighbourhood join.

Two lines are near copies if one word is inserted, deleted or replaced between them (a word edit distance of at most 1).
Every line stands for itself and for its variants with one word left out, as hashed keys. Equal keys join: a line that
equals another's variant differs by a deletion, two variants that left out the same place differ by a replacement. Pairs
are verified on their words. A line goes if an earlier line (smaller doc_id, then line number) is its copy or near copy;
that is judged on the input, not on what is left.

Variants are only made for lines that may have a partner: one edit leaves the first or the second half of a line as it
was, so a line takes part if it shares such a half with a different line. Copies of a line are one row from the start.

Lines without a word are kept; lines of fewer than ``least_near`` words (``LEAST_NEAR``, if not given) go only as exact
copies: one word of three or four is no small difference. With 1, all lines with a word go as near copies.
Words are runs of characters other than white space, A-Z folded, so white space and case don't tell lines apart.

Defined results: null text counts as empty and stays as one empty line; kept lines stay as they are, joined by line
feeds; rows with one doc_id share their lines' places, so none is the other's copy; rows without an id stay as they are,
with no line removed; other columns pass through, whatever their names (n_lines, n_removed are replaced); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import Runs, hot_keys, list_array, mixed, packed, repeated_keys, sliced, text_column, unpacked, word_hashes, words_of
from marlstone.llm.shared import SAMPLE, joined_by_key, unused, written

LEAST_NEAR = 5


class _Lines:
    """Lines of the rows of a slice that have words: row, number, and the words' sums for run hashes."""

    def __init__(self, texts: list[str]):
        split = [t.split("\n") for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        self.texts = [x for s in split for x in s]
        words = words_of(pa.array(self.texts, pa.string()), lower=True)
        hashes = word_hashes(words)
        size = np.diff(words.rows)
        self.at = np.flatnonzero(size)
        self.row = np.repeat(np.arange(len(texts)), counts)[self.at]
        self.number = (np.arange(len(self.texts)) - np.repeat(np.cumsum(counts) - counts, counts))[self.at]
        self.begin, self.size = words.rows[:-1][self.at], size[self.at]
        self.runs = Runs(hashes)

    def halves(self, least_near: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the halves of each line that can have near copies, cut as if it had its length or one word more."""
        if not len(self.at):
            return np.zeros(0, np.uint64), self.size
        out = []
        for total in (self.size, self.size + 1):
            for side, half in ((1, total // 2), (2, total - total // 2)):
                begin = self.begin if side == 1 else self.begin + self.size - half
                out.append(mixed(self.runs.of(begin, half) ^ mixed(total.astype(np.uint64) * np.uint64(4) + np.uint64(side))))
        keys = np.stack(out, axis=1)
        counts = np.where(self.size >= least_near, 4, 0)
        return keys[self.size >= least_near].ravel(), counts

    def variants(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of line i and of its variants, and the place left out (-1: none)."""
        b, n = int(self.begin[i]), int(self.size[i])
        s = self.runs.sums[0]
        p = np.arange(b, b + n)
        with np.errstate(over="ignore"):
            less = (s[p] - s[b]) + (s[b + n] - s[p + 1]) * np.uint64(pow(Runs.FACTOR, -1, 1 << 64))
            keys = mixed(np.concatenate([[s[b + n] - s[b]], less]) * self.runs.down[b] + np.concatenate([[n], np.full(n, n - 1)]).astype(np.uint64))
        return keys, np.arange(-1, n)


def _lines(docs: DataFrame, least_near: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            lines, ids = _Lines(text_column(batch, "text").to_pylist()), np.asarray(batch.column(0), dtype=np.int64)
            keys, counts = lines.halves(least_near)
            h = [lines.runs.of(lines.begin, lines.size, k).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lines.row]), pa.array(lines.number), pa.array(h[0]), pa.array(h[1]), list_array(keys.view(np.int64), counts, pa.int64())], names=["doc_id", "line", "h1", "h2", "halves"])

    return docs.mapInArrow(run, "doc_id long, line long, h1 long, h2 long, halves array<long>")


def _variants(rows: DataFrame) -> DataFrame:
    """key, place, doc_id, line of the variants of the chosen lines, and, with a null key, their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "place", "doc_id", "line", "words"]
        for whole in batches:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                texts = unpacked(batch.column(2)).to_pylist()
                lines, ids = _Lines(texts), batch.column(0).to_pylist()
                wanted = [set(x) for x in batch.column(1).to_pylist()]
                keys, places, docs, numbers, words = [], [], [], [], []
                for i, (row, number) in enumerate(zip(lines.row.tolist(), lines.number.tolist(), strict=True)):
                    if number in wanted[row]:
                        k, p = lines.variants(i)
                        keys.append(k), places.append(p), docs.append(np.full(len(k), ids[row])), numbers.append(np.full(len(k), number))
                        words.append((ids[row], number, lines.texts[lines.at[i]]))
                if keys:
                    key = np.concatenate(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(numbers)), pa.nulls(len(key), pa.string())], names=names)
                    d, n, w = zip(*words, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.int32()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.string())], names=names)

    return rows.mapInArrow(run, "key long, place int, doc_id long, line long, words string")


def _joined(variants: DataFrame) -> DataFrame:
    """(doc_id, line, by_doc, by_line): lines with an earlier line that shares a key in the sense above. The variants come
    in key order and are never gathered: a key's state is the line itself, the earliest variant, and the earliest variant
    of the place at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place = full = first = of_place = None
        for batch in batches:
            out = []
            for k, p, d, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = (d, n)
                if k != key:
                    if full and first and first < full:
                        out.append((*full, *first))
                    key, place, full, first, of_place = k, None, None, None, None
                if p < 0:
                    full = min(full or at, at)
                    continue
                if p != place:
                    place, of_place = p, at
                first = min(first or at, at)
                earlier = min(of_place, full or of_place)
                if earlier < at:
                    out.append((*at, *earlier))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["doc_id", "line", "by_doc", "by_line"])
        if full and first and first < full:
            yield pa.RecordBatch.from_pydict({"doc_id": [full[0]], "line": [full[1]], "by_doc": [first[0]], "by_line": [first[1]]})

    ordered = variants.select("key", "place", "doc_id", "line").repartition("key").sortWithinPartitions("key", "place", "doc_id", "line")
    return ordered.mapInArrow(run, "doc_id long, line long, by_doc long, by_line long")


def near(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def removed_lines(docs: DataFrame, least_near: int = LEAST_NEAR) -> DataFrame:
    """doc_id, line (from 0) of the lines that go, of ``docs`` (doc_id, text)."""
    lines = written(_lines(docs, least_near), "lines")
    pos = F.struct("doc_id", "line")
    firsts = written(lines.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), F.count("*").alias("n"), F.min("halves").alias("halves")), "firsts")
    copies = joined_by_key(lines.drop("halves"), firsts.where("n > 1").select("h1", "h2", "pos", "n"), ["h1", "h2"], "n").where(pos != F.col("pos")).select("doc_id", "line")
    halves = firsts.select(F.explode("halves").alias("half"), "pos.doc_id", "pos.line")
    some = firsts.where(F.pmod("h1", F.lit(SAMPLE)) == 0).select(F.explode("halves").alias("half"))
    chosen = repeated_keys(halves, hot_keys(some, "half")).select("doc_id", "line").distinct()
    of_doc = chosen.groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    variants = written(_variants(of_doc.join(packed(docs), "doc_id").select("doc_id", "lines", "packed")), "variants")
    pairs = _joined(variants.where("key is not null")).distinct()
    texts = variants.where("key is null").select("doc_id", "line", "words").distinct()
    both = pairs.join(texts.toDF("by_doc", "by_line", "by_words"), ["by_doc", "by_line"]).join(texts, ["doc_id", "line"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([_words(t) for t in batch.column(k).to_pylist()] for k in (2, 3))
            keep = pa.array([near(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "line"]).filter(keep)

    found = both.select("doc_id", "line", "words", "by_words").mapInArrow(verify, "doc_id long, line long")
    return written(copies.unionByName(found).distinct(), "removed", (lines, firsts, variants))


def _words(text: str) -> list[str]:
    words = words_of(pa.array([text], pa.string()), lower=True)
    raw = words.raw.tobytes()
    return [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_near: int = LEAST_NEAR) -> DataFrame:
    """``df`` with the lines that go taken out of ``text``, n_lines (of the input) and n_removed."""
    from pyspark.sql.types import StructType

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    base = df.drop("n_lines", "n_removed")
    key, press, gone = unused(base, "doc_key", "packed", "gone")
    lists = removed_lines(docs, least_near).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("line").alias(gone))
    rows = packed(base.withColumn(key, F.col(doc_id).cast("long")), text, press).join(lists, key, "left")
    fields = base.schema.fields
    schema = StructType([*fields, *StructType.fromDDL("n_lines long, n_removed long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                texts, lines, removed = [], [], []
                at = batch.schema.get_field_index
                for value, out in zip(unpacked(batch.column(at(press))).to_pylist(), batch.column(at(gone)).to_pylist(), strict=True):
                    own, out = value.split("\n"), set(out or ())
                    lines.append(len(own)), removed.append(len(out))
                    texts.append("\n".join(x for i, x in enumerate(own) if i not in out) if out else value)
                columns = [pa.array(texts, pa.string()) if f.name == text else batch.column(at(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, of removed lines, and the digest of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
