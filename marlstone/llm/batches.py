"""Arrow batch helpers shared by the corpus operators: bounded slices, word offsets and word hashes.

All helpers are stateless and work on one Arrow batch inside a task; Spark partitions the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A batch is cut so that a slice holds about this many bytes of text (one row at least).
SLICE_BYTES = 2 << 20

# The bytes that end a word, 0x20 and 0x09 to 0x0D.
DELIMITERS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(DELIMITERS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as a null-free Arrow string array (null becomes the empty text)."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.string())
    return pc.fill_null(column, "")


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``most`` bytes of the text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64)
        upto = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a null-free string array and the offset of each row in them."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    """Words of the rows of a slice: byte ranges, and for row i the words ``rows[i]:rows[i + 1]``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row; a word never crosses rows. ``lower`` folds A-Z only."""
    raw, offs = string_bytes(column)
    if lower:
        raw = _LOWER[raw]
    inside = _IS_WORD[raw]
    before = np.empty(len(raw) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    before[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(raw) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = inside
    after[offs] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, offs))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * _CHUNK)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same in every task; work arrays stay near ``_CHUNK`` bytes."""
    out = np.empty(len(words), dtype=np.uint64)
    at = 0
    while at < len(words):
        base = words.starts[at]
        end = max(at + 1, int(np.searchsorted(words.ends, base + _CHUNK, side="right")))
        part = words.raw[base : words.ends[end - 1]]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = words.starts[at:end] - base, words.ends[at:end] - base
        out[at:end] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes (rows are not told apart here)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:count].copy()
    for j in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[j : j + count]
    return mixed(out)


def gram_valid(rows: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where a run of n words that starts here ends in the same row."""
    count = total - n + 1
    if count <= 0:
        return np.zeros(0, dtype=bool)
    row_end = np.repeat(rows[1:], np.diff(rows))
    return np.arange(count) + n <= row_end[:count]


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


class Runs:
    """Hashes of runs of words: the same words have the same hash wherever they stand."""

    FACTOR = 0x9FB21C651E98DF25

    def __init__(self, hashes: np.ndarray, salts: tuple[int, ...] = (1, 2)):
        n = len(hashes)
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, self.FACTOR, np.uint64)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(self.FACTOR, -1, 1 << 64), np.uint64)]))
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + np.uint64(s)) * up[:n])]) for s in salts]

    def of(self, begin: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
        return mixed((self.sums[which][begin + size] - self.sums[which][begin]) * self.down[begin] + size.astype(np.uint64))


def packed(df: DataFrame, text: str = "text", column: str = "packed") -> DataFrame:
    """``df`` with its text column compressed into ``column``, so that texts move as little as they can."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = [f for f in df.schema.fields if f.name != text]
    if column in (f.name for f in kept):
        raise ValueError(f"there is a column {column} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, text):
            texts = pa.array([press.compress(t.encode()) for t in text_column(batch, text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), texts], names=[*(f.name for f in kept), column])

    return df.mapInArrow(run, StructType([*kept, StructField(column, BinaryType())]))


def unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    return pa.array([expand.decompress(x).decode() for x in column.to_pylist()], pa.string())


def hot_keys(sample: DataFrame, key: str, least: int = 8, most: int = 4096) -> np.ndarray:
    """The most frequent keys of a sample, in order: a hint where to deal rows, of bounded size; results don't hang on it."""
    rows = sample.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(most).collect()
    return np.sort(np.array([r[key] for r in rows], dtype=np.int64))


def repeated_keys(rows: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """The rows of ``rows`` (columns of type long, the first one the key) whose key comes several times.

    A partition is read in key order with one row held back, so the rows of a key are never gathered. Rows of the keys in
    ``hot`` all pass, and are dealt to all partitions.
    """
    names = rows.columns
    hot = np.zeros(0, np.int64) if hot is None else hot
    salt = F.when(F.col(names[0]).isin(hot.tolist()), F.pmod(F.xxhash64(*names[1:]), F.lit(9973))).otherwise(0) if len(hot) else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row so far, and whether its key was met before it
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c, dtype=np.int64) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
            same = columns[0][1:] == columns[0][:-1]
            with_last = np.concatenate([[before], same])
            kept = with_last[:-1] | same
            if len(hot):
                kept |= np.isin(columns[0][:-1], hot)
            out = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in columns], names=names)
            held, before = [c[-1] for c in columns], bool(with_last[-1])
        if before or held is not None and len(hot) and np.isin(held[0], hot):
            yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held], names=names)

    dealt = rows.repartition(names[0], salt) if len(hot) else rows.repartition(names[0])
    return dealt.sortWithinPartitions(*names).mapInArrow(run, ", ".join(f"{n} long" for n in names))
