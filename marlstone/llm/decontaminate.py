"""Benchmark decontamination with spaced seeds.

A seed is the hash of the words under the ones of a mask; zeros ignore their position, so a substituted word there does
not matter. Seeds of the test items and of the training documents are joined; each hit fixes a diagonal (document
position minus item position), on which the words around the hit are compared one by one. An item is in a document where
some window of ``WINDOW`` words (the whole item, if shorter) has at least ``percent`` equal words on one diagonal.

The masks hit every window of ``WINDOW`` words with at most two substitutions (tested). A shorter item also has masks of
its own length, each without one set of words that may be substituted in it, where no mask hits what is left. Documents give a row only where
a seed may be one of the items: a Bloom filter of the test seeds, built by grouping and of a size set by their number,
is held against theirs first.

Words are runs of characters other than white space, A-Z folded, punctuation kept. Defined results: null or empty texts
and items without words match nothing; repeated rows
give their matches once; ids must not be null; a tie between overlaps goes to the first place in the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.batches import list_array, mixed, sliced, text_column, word_hashes, words_of
from marlstone.llm.shared import written

WINDOW = 13
#: The seeds' masks.
MASKS = ("11111", "1101011", "110010101", "1010010011")
SPAN = max(map(len, MASKS))
AROUND = WINDOW + SPAN
#: Seeds and words of the items up to which they go to every task (32 MB each) instead of being shuffled.
SENT = 1 << 21
#: Bits of the filter for each test seed, and the most bits it may have (16 MB).
BITS_PER_SEED, MOST_BITS = 256, 1 << 27


def masked(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The seed of each place at which the mask fits (rows are not told apart here)."""
    count = len(hashes) - len(mask) + 1
    out = np.full(max(0, count), number + 1, dtype=np.uint64)
    for j, bit in enumerate(mask if count > 0 else ""):
        if bit == "1":
            out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + count]
    return mixed(out)


@cache
def short_masks(n: int, percent: int) -> tuple[str, ...]:
    """Of items of n words, fewer than WINDOW: the masks of full length that find what MASKS don't, one for each set of
    as many substituted words as ``percent`` allows."""
    out = []
    # Without any word equal, nothing is left to find an item by.
    for bad in combinations(range(n), min(n - 1, n * (100 - percent) // 100)):
        if not any(all(at + j not in bad for j, bit in enumerate(m) if bit == "1") for m in MASKS for at in range(n - len(m) + 1)):
            out.append("".join("0" if j in bad else "1" for j in range(n)))
    return tuple(out)


def seeds_of(hashes: np.ndarray, rows: np.ndarray, short: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, seeds) of each mask, and of those in ``short``."""
    row_end = np.repeat(rows[1:], np.diff(rows))
    masks = [*((m, i) for i, m in enumerate(MASKS)), *((m, 100 + int(f"1{m}", 2)) for m in short)]
    for mask, number in masks:
        found = masked(hashes, mask, number)
        at = np.flatnonzero(np.arange(len(found)) + len(mask) <= row_end[: len(found)])
        yield at, found[at]


def _item_rows(items: DataFrame, percent: int) -> DataFrame:
    """item_id, words array<long>, places array<int>, seeds array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = words_of(text_column(batch, "text"), lower=True)
            hashes, sizes = word_hashes(words), np.diff(words.rows)
            places, seeds = [], []
            for i, size in enumerate(sizes.tolist()):
                own = hashes[words.rows[i] : words.rows[i + 1]]
                found = list(seeds_of(own, np.array([0, size]), short_masks(size, percent) if 0 < size < WINDOW else ()))
                places.append(np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64))
                seeds.append(np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64))
            counts = np.array([len(x) for x in places], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(hashes.view(np.int64), sizes, pa.int64()), list_array(np.concatenate(places).astype(np.int32), counts, pa.int32()), list_array(np.concatenate(seeds).view(np.int64), counts, pa.int64())],
                names=["item_id", "words", "places", "seeds"],
            )

    return items.mapInArrow(run, "item_id long, words array<long>, places array<int>, seeds array<long>")


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seeds & np.uint64(bits - 1)).astype(np.int64), ((seeds >> np.uint64(34)) & np.uint64(bits - 1)).astype(np.int64)


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter as bytes; what reaches the driver is at most its size."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(20, (BITS_PER_SEED * max(n, 1) - 1).bit_length()))
    both = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("seed", 34).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    found = seeds.select(both).select(F.shiftright("bit", 3).alias("place"), F.expr("shiftleft(1, cast(bit & 7 as int))").alias("mask"))
    rows = found.groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(bits >> 3, dtype=np.uint8)
    out[rows["place"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.uint8)
    return out


def _segments(docs: DataFrame, table, short: tuple[str, ...]) -> DataFrame:
    """doc_id, start, words array<long>, places array<int>, seeds array<long>: stretches of a document with the words
    around seeds that pass the filter; places count from start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = table.value
        for batch in sliced(batches, "text"):
            words = words_of(text_column(batch, "text"), lower=True)
            hashes, ids = word_hashes(words), np.asarray(batch.column(0), dtype=np.int64)
            places, seeds = [], []
            for at, found in seeds_of(hashes, words.rows, short):
                a, b = _probes(found, len(bloom) * 8)
                may = np.flatnonzero(bloom[a >> 3] >> (a & 7).astype(np.uint8) & 1)
                b = b[may]
                may = may[(bloom[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)]
                places.append(at[may])
                seeds.append(found[may])
            place, seed = np.concatenate(places), np.concatenate(seeds)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, seed = place[order], seed[order]
            row = np.searchsorted(words.rows, place, side="right") - 1
            new = np.flatnonzero(np.concatenate([[True], (place[1:] - place[:-1] > 2 * AROUND) | (row[1:] != row[:-1])]))
            last = np.append(new[1:], len(place)) - 1
            begin = np.maximum(place[new] - AROUND, words.rows[row[new]])
            end = np.minimum(place[last] + AROUND, words.rows[row[new] + 1])
            sizes, counts = end - begin, last - new + 1
            flat = hashes[np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row[new]]), pa.array(begin - words.rows[row[new]]), list_array(flat.view(np.int64), sizes, pa.int64()), list_array((place - np.repeat(begin, counts)).astype(np.int32), counts, pa.int32()), list_array(seed.view(np.int64), counts, pa.int64())],
                names=["doc_id", "start", "words", "places", "seeds"],
            )

    return docs.mapInArrow(run, "doc_id long, start long, words array<long>, places array<int>, seeds array<long>")


def overlaps(text: np.ndarray, item: np.ndarray, shift: int, percent: int) -> tuple[int, int, int] | None:
    """(begin, end, equal words) in ``text`` of all windows on the diagonal with enough equal words, from first to last."""
    low, high = max(0, shift), min(len(text), len(item) + shift)
    size = min(WINDOW, len(item))
    if high - low < size or not size:
        return None
    equal = (text[low:high] == item[low - shift : high - shift]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(100 * (sums[size:] - sums[:-size]) >= percent * size)
    if not len(good):
        return None
    begin, end = int(good[0]), int(good[-1]) + size
    return low + begin, low + end, int(sums[end] - sums[begin])


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, begin, end (word places in the document), n_equal, n_item: the longest overlap of each pair."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    items = written(_item_rows(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null"), percent), "items")
    seeds = items.select("item_id", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select("item_id", F.col("s.places").alias("q"), F.col("s.seeds").alias("seed"))
    sizes = items.where((F.size("words") < WINDOW) & (F.size("words") > 0)).select(F.size("words").alias("n")).distinct().collect()
    short = tuple(m for n in sorted(r["n"] for r in sizes) for m in short_masks(n, percent))
    n_seeds, n_words = seeds.count(), items.agg(F.sum(F.size("words"))).first()[0] or 0
    table = spark.sparkContext.broadcast(_filter(seeds, n_seeds))
    # A phrase of an item that very many documents hold, or an item they hold, gathers no rows in one task then.
    sent = lambda df, n: F.broadcast(df) if n <= SENT else df
    segments = written(_segments(docs, table, short), "segments")
    hits = segments.select("doc_id", "start", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select("doc_id", "start", F.col("s.places").alias("p"), F.col("s.seeds").alias("seed"))
    diagonals = hits.join(sent(seeds, n_seeds), "seed").select("doc_id", "start", "item_id", (F.col("p") - F.col("q")).alias("shift")).distinct()
    rows = diagonals.join(segments.select("doc_id", "start", "words"), ["doc_id", "start"]).join(sent(items.select("item_id", F.col("words").alias("item")), n_words), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "item_id", "shift", "words", "item")]
            for i, (doc, start, item, shift) in enumerate(zip(*(c.to_pylist() for c in columns[:4]), strict=True)):
                b = columns[5][i].values.to_numpy(zero_copy_only=False)
                if found := overlaps(columns[4][i].values.to_numpy(zero_copy_only=False), b, shift, percent):
                    out.append((doc, item, start + found[0], start + found[1], found[2], len(b)))
            names = ["doc_id", "item_id", "begin", "end", "n_equal", "n_item"]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(6)], names=names)

    found = rows.mapInArrow(verify, "doc_id long, item_id long, begin long, end long, n_equal long, n_item long")
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc(F.col("end") - F.col("begin")), "begin")
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items: one row for each document and item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
