"""Substring dedup with compressed FM-indexes.

Word windows that repeat anywhere in the corpus are found, and of each the earliest place (document id, then word). The
index of a shard is a Burrows-Wheeler transform of its passages in a wavelet matrix of packed bits; matching statistics
come from backward search, one word at a time for all passages at once: extend to the left by rank queries, and once a
match has the threshold's length, report its interval and shorten it on the right by one word.

An index holds no suffix array and no ranks: beside the wavelet matrix it has two packed bit vectors, where suffixes
start to differ within ``window - 1`` and within ``window`` words, and one place for each group of equal windows (the
earliest one).

Passages are routed so that a shard sees all places of its windows: each window of ``window`` words has an anchor, the
gram of ``GRAM`` words (a window, if shorter) with the least hash in it, and a run of windows with one anchor is a passage. Equal windows have
equal anchors, so only passages whose anchor comes several times go on, each distinct one once, to the shard of the anchor.
Grams that a sample of the documents holds often are anchors only of windows that have no other: what stands around a
common passage is then dealt by its own words, and the passage itself is one distinct passage, however often it comes.

A word is removed if a window that covers it also starts earlier; windows are judged on the input.

Words are runs of characters other than white space, unchanged. Defined results: null or empty texts and texts shorter
than a window lose nothing; rows with one doc_id share their places, so none repeats the other; overlapping repeats in
one document count; ids must not be null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import Runs, Words, gram_hashes, hot_keys, packed, repeated_keys, sliced, text_column, unpacked, word_hashes, words_of
from marlstone.llm.shared import SAMPLE, joined_by_key, written

GRAM = 6
#: Words of the passages that one index holds, about; an anchor's passages stay together.
SHARD_WORDS = 200_000
#: Passages a task remembers to have sent with their words.
REMEMBERED = 200_000


def anchored(words: Words, hashes: np.ndarray, window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each run of windows with one anchor; places count over all rows.
    Grams in ``hot`` (ascending) come after all others."""
    count = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none
    grams = gram_hashes(hashes, min(GRAM, window))
    if len(hot):
        grams = (grams >> np.uint64(1)) | (np.isin(grams.view(np.int64), hot).astype(np.uint64) << np.uint64(63))
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window - min(GRAM, window) + 1).argmin(axis=1) + np.arange(count)
    row_end = np.repeat(words.rows[1:], np.diff(words.rows))
    valid = np.flatnonzero(np.arange(count) + window <= row_end[:count])
    if not len(valid):
        return none, none, none
    a = anchor[valid]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (np.diff(valid) > 1)]))
    return valid[first], np.diff(np.append(first, len(valid))), a[first]


def _hot_grams(docs: DataFrame, window: int) -> np.ndarray:
    """Grams that come often in one in ``SAMPLE`` documents: only where passages are sent hangs on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = words_of(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(word_hashes(words), min(GRAM, window)).view(np.int64))], names=["gram"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    return hot_keys(some.mapInArrow(run, "gram long"), "gram")


def _anchors(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = words_of(text_column(batch, "text"))
            hashes = word_hashes(words)
            _, _, anchor = anchored(words, hashes, window, hot)
            row = np.searchsorted(words.rows, anchor, side="right") - 1
            keys = gram_hashes(hashes, min(GRAM, window))[anchor].view(np.int64) if len(anchor) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.asarray(batch.column(0), dtype=np.int64)[row]), pa.array(anchor - words.rows[row])], names=["key", "doc_id", "place"])

    return docs.mapInArrow(run, "key long, doc_id long, place long")


def _passages(rows: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """key, h1, h2, doc_id, start, n_windows, words of ``rows`` (doc_id, places, packed); words is null for a passage that
    the task has sent before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in (whole.slice(at, 128) for at in range(0, whole.num_rows, 128)):
                words = words_of(unpacked(batch.column(2)))
                hashes = word_hashes(words)
                begin, size, anchor = anchored(words, hashes, window, hot)
                row = np.searchsorted(words.rows, anchor, side="right") - 1
                lists = batch.column(1)
                wanted = np.repeat(words.rows[:-1], np.asarray(lists.value_lengths(), dtype=np.int64)) + np.asarray(lists.flatten(), dtype=np.int64)
                pick = np.flatnonzero(np.isin(anchor, wanted))
                begin, size, anchor, row = begin[pick], size[pick], anchor[pick], row[pick]
                runs = Runs(hashes)
                length = size + window - 1
                h1, h2 = (runs.of(begin, length, k).view(np.int64) for k in (0, 1))
                raw, texts = words.raw.tobytes(), []
                for k, a, b in zip(zip(h1.tolist(), h2.tolist(), strict=True), words.starts[begin].tolist(), words.ends[begin + length - 1].tolist(), strict=True):
                    texts.append(None if k in sent else raw[a:b].decode())
                    sent.add(k)
                if len(sent) > REMEMBERED:
                    sent.clear()
                keys = gram_hashes(hashes, min(GRAM, window))[anchor].view(np.int64) if len(anchor) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(h1), pa.array(h2), pa.array(np.asarray(batch.column(0), dtype=np.int64)[row]), pa.array(begin - words.rows[row]), pa.array(size), pa.array(texts, pa.string())],
                    names=["key", "h1", "h2", "doc_id", "start", "n_windows", "words"],
                )

    return rows.mapInArrow(run, "key long, h1 long, h2 long, doc_id long, start long, n_windows long, words string")


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, left = [], symbols
        self.depth = max(1, int(sigma - 1).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            bit = (left >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), len(left) - int(bit.sum())))
            left = np.concatenate([left[~bit], left[bit]])
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._down(symbol, i) - self.origin[symbol]


class FMIndex:
    """A compressed index of a text of symbols from 0 (a separator) to sigma - 1 for matches of up to ``window`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, window: int):
        n = self.n = len(text)
        # Suffixes are sorted by prefix doubling; the ranks and the suffix array live only until the index is made.
        rank, known, ranks = text.astype(np.int64), 1, {}
        while known < window + 1:
            ranks[known] = rank
            rank = np.unique(rank * (n + sigma) + np.concatenate([rank[known:], rank[:known]]), return_inverse=True)[1].astype(np.int64)
            known *= 2
        ranks[known] = rank
        suffixes = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(text[suffixes - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)

        def differs(depth: int) -> np.ndarray:
            """Whether each row starts a group of suffixes with the same first ``depth`` symbols."""
            most = max(k for k in ranks if k <= depth)
            a, b = ranks[most][suffixes], ranks[most][(suffixes + depth - most) % n]
            return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])

        shorter, equal = differs(window - 1), differs(window)
        self.edges = np.append(np.flatnonzero(shorter), n).astype(np.int32)
        self.shorter, self.equal = Bits(shorter), Bits(equal)
        self.earliest = np.minimum.reduceat(suffixes, np.flatnonzero(equal)).astype(np.int32)

    @property
    def nbytes(self) -> int:
        vectors = [bits for _, bits, _ in self.bwt.levels] + [self.shorter, self.equal]
        return sum(v.words.nbytes + v.before.nbytes for v in vectors) + self.first.nbytes + self.bwt.origin.nbytes + self.edges.nbytes + self.earliest.nbytes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + match."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(low)], self.first[symbol] + both[len(low) :]

    def shortened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches of ``window`` symbols cut to ``window - 1``."""
        return self.edges[self.shorter.rank(low + 1) - 1].astype(np.int64), self.edges[self.shorter.rank(high)].astype(np.int64)

    def place(self, low: np.ndarray) -> np.ndarray:
        """The earliest place of the window whose interval begins at ``low``."""
        return self.earliest[self.equal.rank(low + 1) - 1].astype(np.int64)


def earliest(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every passage (in order): passage and word of its earliest place among the passages; and the
    number of windows of each passage. Passages come in the order of their places."""
    words = words_of(texts)
    sizes = np.diff(words.rows)
    symbols = np.unique(word_hashes(words), return_inverse=True)[1] + 1
    n_passages = len(sizes)
    begin = words.rows[:-1] + np.arange(n_passages)  # a separator ends each passage
    text = np.zeros(len(symbols) + n_passages, dtype=np.int64)
    text[np.arange(len(symbols)) + np.repeat(np.arange(n_passages), sizes)] = symbols
    index = FMIndex(text, int(symbols.max(initial=0)) + 1, window)
    n_windows = np.maximum(sizes - window + 1, 0)
    out, base = np.zeros(int(n_windows.sum()), dtype=np.int64), np.cumsum(n_windows) - n_windows
    live = np.flatnonzero(n_windows > 0)
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), index.n, dtype=np.int64)
    # Matching statistics of all passages at once, from their last words on: no match is ever shorter than what was read
    # or window - 1 words, as every passage is in the index.
    for step in range(int(sizes.max(initial=0))):
        keep = sizes[live] > step
        live, low, high = live[keep], low[keep], high[keep]
        low, high = index.extend(text[begin[live] + sizes[live] - 1 - step], low, high)
        if step >= window - 1:
            out[base[live] + sizes[live] - 1 - step] = index.place(low)
            low, high = index.shortened(low, high)
    passage = np.searchsorted(begin, out, side="right") - 1
    return passage, out - begin[passage], n_windows


def _earliest_places(distinct: DataFrame, window: int) -> DataFrame:
    """key, h1, h2, n, docs, places: the earliest place of each window of each distinct passage, of which there are n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0

        def shard(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            keys, h1, h2, doc, start, n_rows = (table.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 7))
            order = np.lexsort((start, doc))
            texts = table.column(5).combine_chunks().take(pa.array(order))
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            keys, h1, h2, doc, start, n_rows = (x[order] for x in (keys, h1, h2, doc, start, n_rows))
            passage, place, n = earliest(texts, window)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            for at in range(0, len(n), 5000):
                end = min(len(n), at + 5000)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).slice(at, end - at) for x in (doc[passage], start[passage] + place)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at:end]) for x in (keys, h1, h2, n_rows)), *lists], names=["key", "h1", "h2", "n", "docs", "places"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(6), dtype=np.int64) + window
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            upto, at = np.cumsum(sizes), 0
            if held and held[-1].column(0)[-1].as_py() != keys[0] and words >= SHARD_WORDS:
                yield from shard(held)
                held, words = [], 0
            for c in cut.tolist():
                size = int(upto[c - 1] - (upto[at - 1] if at else 0))
                if words + size >= SHARD_WORDS:
                    yield from shard([*held, batch.slice(at, c - at)])
                    held, words, at = [], 0, c
            held.append(batch.slice(at))
            words += int(upto[-1] - (upto[at - 1] if at else 0))
        if held:
            yield from shard(held)

    ordered = distinct.select("key", "h1", "h2", "first.doc_id", "first.start", "words", "n_windows", "n").repartition("key").sortWithinPartitions("key", "doc_id", "start")
    return ordered.mapInArrow(run, "key long, h1 long, h2 long, n long, docs array<long>, places array<long>")


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, spans (begin, end): stretches of words covered by windows that start earlier too, of ``docs`` (doc_id,
    text); at most one for each passage of the document, in no order, and they may overlap."""
    hot = _hot_grams(docs, window)
    shared = written(repeated_keys(_anchors(docs, window, hot), hot), "anchors")
    places = shared.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    passages = written(_passages(places.join(packed(docs), "doc_id").select("doc_id", "places", "packed"), window, hot), "passages", (shared,))
    by = ["key", "h1", "h2"]
    distinct = passages.groupBy(*by).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("words", ignorenulls=True).alias("words"), F.first("n_windows").alias("n_windows"), F.count("*").alias("n"))
    found = written(_earliest_places(distinct, window), "earliest")
    rows = joined_by_key(passages.drop("words"), found, by, "n").select("doc_id", "start", "docs", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = (np.asarray(batch.column(i), dtype=np.int64) for i in (0, 1))
            n = np.asarray(batch.column(2).value_lengths(), dtype=np.int64)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[row]
            gone = np.flatnonzero((np.asarray(batch.column(2).flatten()) != doc[row]) | (np.asarray(batch.column(3).flatten()) != place))
            row, place = row[gone], place[gone]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (np.diff(place) > 1)])) if len(row) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(row)) - 1 if len(row) else first
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(place[first]), pa.array(place[last] + window)], names=["doc_id", "begin", "end"])

    spans = rows.mapInArrow(run, "doc_id long, begin long, end long").groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return written(spans, "spans", (passages, found))


def dedup_substrings(df: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans array<struct<begin, end>> (words, apart and in order), kept (the other words,
    joined by one space)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    rows = packed(docs).join(repeats(docs, window), "doc_id", "left").select("doc_id", "packed", "spans")
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                texts, spans = unpacked(batch.column(1)), batch.column(2).to_pylist()
                words = words_of(texts)
                kept, removed, merged = [], [], []
                raw = words.raw.tobytes()
                for i, own in enumerate(spans):
                    a, b = int(words.rows[i]), int(words.rows[i + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    for s in own or ():
                        gone[s["begin"]] += 1
                        gone[s["end"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    left = np.flatnonzero(~gone) + a
                    kept.append(b" ".join(raw[x:y] for x, y in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)).decode())
                    removed.append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    merged.append([{"begin": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.rows)), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, kept string")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 20-word windows."""
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
places as (select doc_id, i, md5(string_agg(x, ' ') over f) as h, count(*) over f as n from words window f as (partition by doc_id order by i rows between current row and 19 following)),
windows as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from places where n = 20),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as i from windows where n > 1),
kept as (select doc_id, count(*) as n_words, count(g.i) as n_removed, string_agg(x, ' ' order by i) filter (g.i is null) as k from words left join gone g using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept using (doc_id)
"""
