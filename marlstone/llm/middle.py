"""Fill-in-the-middle documents from an index of distinct texts.

Copies of one text have the same code point boundaries, so these are listed once for each distinct text. Packed texts are
shuffled by hash, sorted, and grouped where their bytes are equal (equal hashes alone group nothing); each group gives one
entry of the index, the packed text with the Elias-Fano list of the byte offsets at which its code points begin, and a
row for each document. The entries are joined back to the documents, whose seeded cuts are two selects in the list.

Texts that hold at least one in ``SHARE`` rows are dealt to several tasks and have an entry in each; there are at most
``SHARE`` of them and about as many entries more. No group is held: a task keeps the text it is at.

Defined results: null text counts as empty; a null id is seeded as an empty one; rows of one id are cut alike, each a row
of its own; the empty text and texts that hold a marker stay plain; other columns, whatever their names, are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import sliced, text_column
from marlstone.llm.shared import SHARE, bucketed

# What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of output that a task holds before it hands them on.
OUT_BYTES = 4 << 20
#: How hard texts are packed: they are moved once and stored once.
LEVEL = 9
#: Bytes of text that a bucket is to hold.
BUCKET_BYTES = 256 << 20


class EliasFano:
    """An ascending list: the low bits of each value side by side, the high parts in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(values[-1]) // n).bit_length() - 1 if n and values[-1] >= n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        high = np.zeros((int(values[-1]) >> low_bits) + n if n else 0, dtype=bool)
        high[(values >> low_bits) + np.arange(n)] = True
        return cls(n, low_bits, np.packbits(bits.astype(bool).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits = np.frombuffer(data, "<i8", 2).tolist()
        cut = (n * low_bits + 7) // 8
        rest = np.frombuffer(data, np.uint8, offset=16)
        return cls(n, low_bits, rest[:cut], rest[cut:])

    def select(self, i: int) -> int:
        """The value at place i: the place of the i-th one in the high bits, less i, before its low bits."""
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        at = int(np.searchsorted(ones, i, side="right"))
        within = np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[i - (int(ones[at - 1]) if at else 0)]
        begin = i * self.low_bits
        window = int.from_bytes(self.low[begin // 8 : (begin + self.low_bits + 7) // 8].tobytes(), "little")
        return ((8 * at + int(within) - i) << self.low_bits) | (window >> begin % 8) & ((1 << self.low_bits) - 1)


def boundaries(text: bytes) -> EliasFano:
    """The byte offsets at which the code points of UTF-8 begin, and its end."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano.of(np.append(starts, len(text)).astype(np.int64))


def _packed(rows: DataFrame) -> DataFrame:
    """doc_id, key, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in sliced(batches, "text"):
            texts = pa.array([press.compress(t.encode()) for t in text_column(batch, "text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "key", "packed"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, packed binary")


def text_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, entries), both read from one written table: members are doc_id, key, text_id of every row; entries are
    key, text_id, n code points, special (a marker is in it), offsets (Elias-Fano) and packed (both zstd) of every distinct text.
    Both are in buckets by key, the hash that texts were shuffled by, so they are joined where they lie."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    total, size = (x or 0 for x in counts.agg(F.sum("n"), F.sum("size")).first())
    part = max(total // SHARE, SHARE)
    # At most SHARE rows: hashes of texts that hold more than one in SHARE of all rows.
    hot = counts.where(F.col("n") > part).select("h", F.ceil(F.col("n") / part).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(hot), "h", "left")
    salted = salted.withColumn("key", F.when(F.col("salts").isNull(), F.col("h")).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("doc_id"), "salts"))))
    schema = pa.schema([("key", pa.int64()), ("text_id", pa.int64()), ("entry", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("special", pa.bool_()), ("offsets", pa.binary()), ("packed", pa.binary())])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        expand, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=LEVEL)
        text_id, before, out, size = TaskContext.get().partitionId() << 36, None, [], 0
        for batch in batches:
            for doc, key, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, packed) != before:
                    plain = expand.decompress(packed)
                    text_id, before, listed = text_id + 1, (key, packed), boundaries(plain)
                    special = any(m.encode() in plain for m in (PREFIX, SUFFIX, MIDDLE))
                    offsets = press.compress(listed.to_bytes())
                    out.append((key, text_id, True, None, listed.n - 1, special, offsets, packed))
                    size += len(packed) + len(offsets)
                out.append((key, text_id, False, doc, None, None, None, None))
                if size > OUT_BYTES or len(out) > 10000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    number = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    dealt = _packed(salted).repartition(number, "key").sortWithinPartitions("key", "packed")
    table = bucketed(dealt.mapInArrow(group, "key long, text_id long, entry boolean, doc_id long, n long, special boolean, offsets binary, packed binary"), "texts", ["key"], number)
    return table.where("not entry").select("doc_id", "key", "text_id"), table.where("entry").select("key", "text_id", "n", "special", "offsets", "packed")


def seeds(doc_id: Column, seed: str) -> list[Column]:
    """The first four groups of eight hex digits of the sha256 of ``seed:id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", kept_plain: int = 10, suffix_first: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row. About ``kept_plain`` of a hundred texts stay as
    they are; of the others about ``suffix_first`` of a hundred have their suffix first (form spm, else psm)."""
    members, entries = text_index(docs, doc_id, text)
    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    # Joined on the key alone, by which the buckets are; of texts with one key, the condition finds the right one.
    same = F.col("text_id").between(F.col("entry_id"), F.col("entry_id"))
    rows = members.select("doc_id", "key", "text_id", h1.alias("h1"), h2.alias("h2"), (h3 % 100 >= 100 - kept_plain).alias("stays"), (h4 % 100 < suffix_first).alias("swaps")).join(entries.withColumnsRenamed({"text_id": "entry_id", "key": "entry_key"}), (F.col("key") == F.col("entry_key")) & same)
    form = F.when((F.col("n") == 0) | F.col("special") | F.col("stays"), "plain").when(F.col("swaps"), "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    asked = rows.select("doc_id", "n", form.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), "offsets", "packed")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand, out, size = zstandard.ZstdDecompressor(), [], 0
        p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
        for batch in batches:
            for at in range(batch.num_rows):
                doc, n, kind, lo, hi, offsets, packed = (c[at].as_py() for c in batch.columns)
                plain = expand.decompress(packed)
                if kind == "plain":
                    out.append((doc, n, kind, None, None, plain.decode()))
                else:
                    listed = EliasFano.from_bytes(expand.decompress(offsets))
                    i, j = listed.select(lo), listed.select(hi)
                    before, within, after = plain[:i], plain[i:j], plain[j:]
                    made = (s, after, p, before, m, within) if kind == "spm" else (p, before, s, after, m, within)
                    out.append((doc, n, kind, lo, hi - lo, b"".join(made).decode()))
                size += len(plain)
                if size > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return asked.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a marker and none can begin in one, so each is found where it
    stands first."""
    p, s, m = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = F.substring(output, m + 3, F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), rest, between(s, m))).when(form == "spm", F.concat(between(p, m), rest, between(s, p))).otherwise(output)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by the digest of its id, with digests of the output and of what it is restored to."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as x, length(coalesce(text, '')) as n from documents
), h as (
  select *, cast('0x' || substr(x, 1, 8) as bigint) as h1, cast('0x' || substr(x, 9, 8) as bigint) as h2, cast('0x' || substr(x, 17, 8) as bigint) as h3, cast('0x' || substr(x, 25, 8) as bigint) as h4 from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h
), o as (
  select *, case form when 'psm' then '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
    when 'spm' then '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) else t end as output from f
)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then lo end as bigint) as prefix_chars, cast(case when form <> 'plain' then hi - lo end as bigint) as middle_chars,
  sha256(output) as output_sha256, sha256(t) as restored_sha256 from o
"""
