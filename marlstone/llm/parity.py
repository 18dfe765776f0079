"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Each shingle flips one bit of a sketch, so the Hamming distance of
two sketches is at most the symmetric difference of the sets. In a band of set sizes, sets that reach the similarity
differ in at most D shingles; the sketch is cut into more than D blocks, so some block is equal (pigeonhole). The sketch
of the pigeonhole join has a bit for every 64-bit place, so it is never written out: a block is the range of places that a
shingle's hash falls to, and is keyed by the XOR of the shingles in it, each stretched to 64 random bits. Documents that
share a block of a band are candidates; a second sketch with real bits bounds their distance from below, and those
left are verified on their whole sets.

Common shingles (lines and passages that many documents hold) would make blocks equal that say nothing, so the
fingerprint of a block covers its other shingles, and a block with fewer than ``FEW`` of these is small and goes unused.
No link is lost: ``SPARE`` blocks beyond D + 1 are dealt, so linked documents have more than that many blocks with the
same shingles. Either one of them is not small, or both documents have more small blocks than spare ones; then both use
those with one other shingle less as well, with all shingles in the fingerprint, and so on. Where all of the same blocks
are without a shingle, both documents have more such blocks than spare ones; these say nothing, so both are dealt out
again by another hash, and use them in the last of ``DEALINGS`` only. Which shingles count as common is found by counting
in each task and adding up; it decides speed, never results.

Only components are wanted, so a group of documents with a common block is not paired out: everyone is compared with
the document that shares most blocks with others (of near copies, the one that they were made of), then, where several
components are left in a group, with the first one that is apart from that, and only documents that are still apart are
compared with each other, by whole sketches first: those of a large group in cells that give
only the pairs that pass. A whole sketch has a bit for each hash place; longer ones are folded to the shorter's size.

Defined results: null or empty text, or text without words, has the empty set and no link; a text of fewer words than a
shingle is one shingle; rows with the same id are one document with the union of their keys; ids must not be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import gram_hashes, gram_valid, hot_keys, mixed, packed, repeated_keys, sliced, text_column, unpacked, word_hashes, words_of
from marlstone.llm.components import components
from marlstone.llm.shared import SAMPLE, forget, written

#: Ratio of the ends of a size band; blocks beyond those that differences can touch; shingles of a small block.
BAND, SPARE, FEW = 1.3, 0.12, 2
#: Ways in which shingles are dealt to blocks.
DEALINGS = 4
#: Star rounds before documents that are still apart are compared with each other.
STARS = 2
#: Bits of a whole sketch, which has BITS_EACH or more for each shingle up to the largest size: so wide, its distances are
#: nearly the differences of the sets. Documents of a group that is paired by a join, and of a chunk of a larger one.
BITS_EACH, LEAST, MOST_BITS = 16, 8, 1 << 18
SMALL, CHUNK = 12, 1024
#: A class of copies with at least one in HOT of all rows is hot.
HOT = 1000
#: A shingle in about one of COMMON documents or more is common; shingles a task counts at a time.
COMMON, BUFFER = 2000, 1_000_000


def bands(percent: int, most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(least size, largest size, D) of the bands; D is the largest difference between linked sets of which the smaller
    one is in the band. A document also takes part in a band if it is at most 100 / percent times its largest size."""
    out, low = [], 1
    while low < most:
        high = max(low, int(low * BAND))
        out.append((low, high, (100 - percent) * (100 * high // percent) // 100))
        low = high + 1
    return out


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, flat, and the end of each row."""
    words = words_of(column, lower=True)
    hashes = word_hashes(words)
    grams = gram_hashes(hashes, n)
    keep = gram_valid(words.rows, n, len(hashes))
    sizes = np.diff(words.rows)
    row = words.row_of()
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    extra = np.array([gram_hashes(hashes[words.rows[r] : words.rows[r + 1]], int(sizes[r]))[0] for r in short], dtype=np.uint64) + np.uint64(1)
    flat, owner = np.concatenate([grams[keep], extra]), np.concatenate([row[: len(grams)][keep], short])
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[first], owner[first]
    return flat, np.cumsum(np.bincount(owner, minlength=len(column)))


def block_keys(flat: np.ndarray, ends: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed (band, block, fingerprint) keys of each set, flat, and their number; ``common``: shingles, ascending."""
    sizes = np.diff(np.concatenate([[0], ends]))
    row = np.repeat(np.arange(len(ends)), sizes)
    places, bit = [mixed(flat + np.uint64(0x51 + 0x10001 * d)) for d in range(DEALINGS)], mixed(flat ^ np.uint64(0xA5A5A5A5))
    rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat if len(common) else np.ones(len(flat), bool)
    keys, owners = [], []
    for number, (low, high, most) in enumerate(bands(percent, int(sizes.max(initial=0)) + 1)):
        part = np.flatnonzero((sizes >= low) & (sizes <= 100 * high // percent))
        spare = int(np.ceil(SPARE * most))
        blocks = most + 1 + spare
        for dealing, place in enumerate(places):
            if not len(part):
                break
            inside = np.zeros(len(ends), dtype=bool)
            inside[part] = True
            at = np.flatnonzero(inside[row])
            cell = row[at] * blocks + (place[at] % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            at, cell = at[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            whole = np.bitwise_xor.reduceat(bit[at], first)
            sparse = np.bitwise_xor.reduceat(np.where(rare[at], bit[at], np.uint64(0)), first)
            counts, cell = np.add.reduceat(rare[at].astype(np.int64), first), cell[first]
            owner, block = cell // blocks, (cell % blocks).astype(np.uint64)
            salt = np.uint64((number << 40) + (dealing << 34))
            big = counts >= FEW
            keys.append(mixed(sparse[big] + mixed(block[big] + salt + np.uint64(1))))
            owners.append(owner[big])
            none = blocks - np.bincount(owner, minlength=len(ends))
            for few in range(FEW - 1, -1, -1):
                # Blocks of so few rare shingles are used where those of more may all be different.
                short = np.bincount(owner[counts <= few], minlength=len(ends)) + none > spare
                tiny = (counts == few) & short[owner]
                keys.append(mixed(whole[tiny] + mixed(block[tiny] + salt + np.uint64(1 << 32))))
                owners.append(owner[tiny])
            part = part[none[part] > spare]
        # Documents that have too many blocks without a shingle, however they are dealt.
        empty = [(r, b) for r in part.tolist() for b in np.setdiff1d(np.arange(blocks), block[owner == r].astype(np.int64)).tolist()]
        if empty:
            r, b = np.array(empty).T
            keys.append(mixed(mixed(b.astype(np.uint64) + salt + np.uint64(1 << 32))))
            owners.append(r)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], np.bincount(owner, minlength=len(ends))


class _Frequent:
    """Shingles that keep coming up in a task: counted over buffers, of which those met several times are kept."""

    def __init__(self):
        self.buffer, self.size, self.docs, self.found = [], 0, 0, []

    def add(self, flat: np.ndarray, docs: int) -> None:
        self.buffer.append(flat)
        self.size, self.docs = self.size + len(flat), self.docs + docs
        if self.size > BUFFER:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            keys, counts = np.unique(np.concatenate(self.buffer), return_counts=True)
            self.found.append((keys[counts > 2], counts[counts > 2]))
            self.buffer, self.size = [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.found]), return_inverse=True) if self.found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in self.found]) if self.found else None, minlength=len(keys)).astype(np.int64)
        kept = counts * COMMON >= self.docs
        return keys[kept], counts[kept]


def sets(docs: DataFrame, shingle: int, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint of the set (f1, f2) of ``docs`` (doc_id, text); then, if they are to be
    counted, with a null doc_id, shingles (f1) that are frequent in a task and their number there (n_shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, frequent = ["doc_id", "n_shingles", "f1", "f2"], _Frequent()
        for batch in sliced(batches, "text"):
            flat, ends = shingle_sets(text_column(batch, "text"), shingle)
            if counted:
                frequent.add(flat, len(ends))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat + np.uint64(salt)), dtype=np.uint64)]) for salt in (3, 5)]
            begins = np.concatenate([[0], ends[:-1]])
            prints = [(x[ends] - x[begins]).view(np.int64) for x in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - begins, pa.int64()), *map(pa.array, prints)], names=names)
        keys, counts = frequent.result()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(counts), pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64())], names=names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


class Parity:
    """How candidates are found and bounded: here by blocks of parity sketches, and their Hamming distance."""

    #: Whether keys need the common shingles.
    counted = True

    def __init__(self, percent: int, bits_each: int = BITS_EACH):
        self.percent, self.bits_each = percent, bits_each

    def keys(self, flat: np.ndarray, ends: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return block_keys(flat, ends, self.percent, common)

    def sketches(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """A bit for each place that an odd number of shingles hash to."""
        place, out, begin = mixed(flat ^ np.uint64(0x5BD1E995)), [], 0
        for end in ends.tolist():
            bits = min(MOST_BITS, self.bits_each << max(LEAST, (end - begin).bit_length()))
            out.append(np.packbits((np.bincount((place[begin:end] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes())
            begin = end
        return out

    def pairs(self, n: list[int], m: list[int], left: list[bytes], right: list[bytes]) -> list[bool]:
        """Whether sets of these sizes and sketches may be linked."""
        keep = []
        for n_x, n_y, x, y in zip(n, m, left, right, strict=True):
            if len(x) != len(y):
                short = min(len(x), len(y))
                x, y = (folded(np.frombuffer(z, np.uint8)[None], short).tobytes() for z in (x, y))
            keep.append((int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count() <= allowed(n_x, n_y, self.percent))
        return keep

    def stacked(self, sketches: list[bytes]) -> np.ndarray:
        """Sketches as rows of one length."""
        short = min(map(len, sketches))
        return np.concatenate([folded(np.frombuffer(x, np.uint8)[None], short) for x in sketches]).view(np.uint64)

    def one_to_many(self, n: int, m: np.ndarray, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.bitwise_count(many ^ one).sum(axis=1) <= allowed(m, n, self.percent)


def block_rows(docs: DataFrame, shingle: int, method: Parity, hot: dict[tuple[int, int, int], int], common) -> DataFrame:
    """(key, doc_id) of every used block; of the sets in ``hot`` only the named document gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            flat, ends = shingle_sets(text_column(batch, "text"), shingle)
            ids = np.asarray(batch.column(0), dtype=np.int64)
            keys, counts = method.keys(flat, ends, common.value)
            if hot:
                begins = np.concatenate([[0], ends[:-1]])
                known = {n for n, _, _ in hot}
                drop = np.zeros(len(ids), dtype=bool)
                for i in np.flatnonzero(np.isin(ends - begins, list(known))).tolist():
                    part = flat[begins[i] : ends[i]]
                    prints = [int(mixed(part + np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (3, 5)]
                    drop[i] = hot.get((len(part), *prints), ids[i]) != ids[i]
                keys = keys[~np.repeat(drop, counts)]
                counts = np.where(drop, 0, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids, counts))], names=["key", "doc_id"])

    return docs.mapInArrow(run, "key long, doc_id long")


def sketched_texts(texts: DataFrame, shingle: int, method: Parity) -> DataFrame:
    """doc_id, size, sketch of ``texts`` (doc_id, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                flat, ends = shingle_sets(unpacked(batch.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(method.sketches(flat, ends), pa.binary())], names=["doc_id", "size", "sketch"])

    return texts.mapInArrow(run, "doc_id long, size long, sketch binary")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches cut to a shorter size: parities of places that become one are added."""
    while sketch.shape[1] > size:
        sketch = sketch[:, : sketch.shape[1] // 2] ^ sketch[:, sketch.shape[1] // 2 :]
    return sketch


def allowed(size_a, size_b, percent: int):
    """The largest difference of linked sets of these sizes."""
    return (100 - percent) * (size_a + size_b) // (100 + percent)


def _alike(pairs: DataFrame, sketched: DataFrame, percent: int, method: Parity) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity."""
    rows = pairs.join(sketched.toDF("a", "size_a", "sketch_a"), "a").join(sketched.toDF("b", "size_b", "sketch_b"), "b")
    rows = rows.where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = method.pairs(*(batch.column(i).to_pylist() for i in range(2, 6)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _within_groups(rest: DataFrame, sketched: DataFrame, percent: int, method: Parity) -> DataFrame:
    """(a, b): documents of different labels that share a key, as far as sizes and sketches allow the similarity.

    Groups of up to ``SMALL`` documents are paired by a join. The documents of a larger group are dealt to chunks of about
    ``CHUNK``; a cell holds two chunks, compares their sketches, and gives only the pairs that may be linked.
    """
    sized = rest.join(rest.groupBy("key").agg(F.count("*").alias("n")), "key")
    few = sized.where(F.col("n") <= SMALL).select("key", "doc_id", "label")
    joined = few.alias("x").join(few.alias("y"), "key").where("x.doc_id < y.doc_id and x.label <> y.label").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), chunks).cast("int")
    dealt = sized.where(F.col("n") > SMALL).select("key", "doc_id", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label").join(sketched, "doc_id")
    columns = ["key", "i", "j", "own", "doc_id", "label", "size", "sketch"]

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        own, doc, label, size = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4, 5, 6))
        bits = method.stacked([r[7] for r in rows])
        # Most rows may be of one component already: these are compared with the others only.
        names, which, counts = np.unique(label, return_inverse=True, return_counts=True)
        order = np.argsort(which != counts.argmax(), kind="stable")
        own, doc, label, size, bits = own[order], doc[order], label[order], size[order], bits[order]
        cross, out, most = rows[0][1] != rows[0][2], [], int(counts.max())
        for x in range(most, len(rows)):
            for y in (slice(0, most), slice(x + 1, None)):
                good = method.one_to_many(size[x], size[y], bits[x], bits[y]) & (label[y] != label[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))
                if cross:
                    good &= own[y] != own[x]
                out += [(min(doc[x], d), max(doc[x], d)) for d in doc[y][good].tolist() if d != doc[x]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and r[:3] != rows[0][:3]:
                    out += compare(rows)
                    rows = []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = compare(rows) if rows else []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = cells.select(columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")
    return _alike(joined, sketched, percent, method).unionByName(found).distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; ``texts`` as from ``packed``."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept = None, None
        for batch in sliced(batches, "text_b", 1 << 19):
            flat, ends = shingle_sets(unpacked(batch.column(3)), shingle)
            a, b, linked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            begin = 0
            for i, end in enumerate(ends.tolist()):
                if a[i] != kept_id:
                    kept_id = a[i]
                    kept = shingle_sets(unpacked(batch.column(2).slice(i, 1)), shingle)[0]
                common = len(kept) + end - begin - len(np.union1d(kept, flat[begin:end])) if end > begin and len(kept) else 0
                linked.append(common > 0 and 100 * common >= percent * (len(kept) + end - begin - common))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b")


def linked_components(docs: DataFrame, shingle: int, percent: int, doc_id: str = "doc_id", text: str = "text", method: Parity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; documents link at a Jaccard similarity of ``percent`` or more.
    Candidates are found by ``method``, parity sketches if there is no other.

    Documents with one set are a class, for which its smallest document stands. A class of at least one in ``HOT`` rows
    (there are at most ``HOT`` such classes) is known before blocks are dealt out, and only its document gives any.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    method = method or Parity(percent)
    found = written(sets(docs, shingle, method.counted), "sets")
    known = found.where("doc_id is not null")
    classes = known.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    total = known.count()
    hot = {(r["n_shingles"], r["f1"], r["f2"]): r["first"] for r in classes.where(F.col("n") * HOT >= max(total, 2 * HOT)).collect()}
    # Each document has few shingles beside a table of this size: at most COMMON times the mean set size.
    often = found.where("doc_id is null").groupBy("f1").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(20, total // (2 * COMMON))).select("f1")
    common = docs.sparkSession.sparkContext.broadcast(np.sort(often.toPandas()["f1"].to_numpy(dtype=np.int64).view(np.uint64)))
    copies = written(known.join(classes.where("n > 1").drop("n"), ["n_shingles", "f1", "f2"]).where("doc_id <> first").select("doc_id", "first").distinct(), "copies")
    first = F.coalesce("first", "doc_id")
    some = block_rows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), shingle, method, hot, common)
    met = written(repeated_keys(block_rows(docs, shingle, method, hot, common), hot_keys(some, "key")), "met")
    grouped = written(met.join(copies, "doc_id", "left").select("key", first.alias("doc_id")).distinct(), "grouped", (met,))
    shared = written(_scored(grouped), "shared", (grouped,))
    sizes = known.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    texts = written(packed(docs).join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    sketched = written(sketched_texts(texts, shingle, method), "bits")

    links = labels = None
    for star in range(1, STARS + 1):
        pairs = _with_centres(shared, labels)
        found = verified(_alike(pairs, sketched, percent, method), texts, shingle, percent)
        links = written(found if links is None else links.unionByName(found), "found", (links,) if links is not None else ())
        labels = written(components(links, rounds=1 if star < STARS else None), "labels", (labels,) if labels is not None else ())
    # What is left in a group with several components: documents of different components.
    rest = written(_apart(shared, labels).select("key", "doc_id", "label"), "rest")
    pairs = written(_within_groups(rest, sketched, percent, method), "pairs")
    if not pairs.isEmpty():
        links = written(links.unionByName(verified(pairs, texts, shingle, percent)), "found", (links, labels))
        labels = components(links)
    forget(shared, texts, sketched, rest, pairs)
    named = sizes.join(copies, "doc_id", "left").withColumn("node", first)
    return named.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def _scored(grouped: DataFrame) -> DataFrame:
    """key, doc_id, score: the score of a document counts those it shares keys with, key by key. Near copies of a document
    share more keys with it than with each other, so it has the highest score of its groups."""
    sized = grouped.join(grouped.groupBy("key").agg(F.count("*").alias("n")), "key")
    return sized.select("key", "doc_id").join(sized.groupBy("doc_id").agg(F.sum("n").alias("score")), "doc_id").select("key", "doc_id", "score")


def _with_centres(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(a, b): each document with the one of the highest score in its group; once there are labels, in groups of several
    components, those of another component with the highest of those that are apart from that one."""
    highest = lambda what: F.max_by(what, F.struct("score", -F.col("doc_id")))
    if labels is None:
        met = shared.join(shared.groupBy("key").agg(highest("doc_id").alias("end")), "key").where("doc_id <> end")
    else:
        now = _apart(shared, labels)
        far = now.join(now.groupBy("key").agg(highest("label").alias("centre")), "key").where("label <> centre")
        ends = far.groupBy("key").agg(highest(F.struct("doc_id", "label")).alias("e")).select("key", F.col("e.doc_id").alias("end"), F.col("e.label").alias("end_label"))
        met = now.join(ends, "key").where("label <> end_label")
    return met.select(F.least("end", "doc_id").alias("a"), F.greatest("end", "doc_id").alias("b")).distinct()


def _apart(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the groups whose documents are in several components, with the label of each."""
    named = shared.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    several = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
    return named.join(several, "key", "left_semi")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[p:p + 3], ' ')) as g from (select doc_id, w, unnest(generate_series(1, len(w) - 3)) as p from d where len(w) >= 4)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 3
),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, node) as (select doc_id, doc_id from d union select r.doc_id, l.b from reach r join links l on r.node = l.a)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(node) as component_id from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
