"""Product codes of vectors by Lloyd's algorithm with heaps.

Vectors are cut into parts of equal length, and each part position has a codebook of its own. A part keeps a lower bound on
how much nearer its entry is than any other (the slack). Each entry of each block of vectors has a heap of its parts, keyed
by slack; when entries move, the cumulative drift of an entry grows by its own movement and the largest one of the others,
and only parts whose key the drift has reached are popped and compared with all entries again. The others provably keep
their entry. A heap is an ascending array: what is to be popped is its front, found by bisection, and what is put in is
merged into it.

Vectors are cut into blocks once and written to buckets; each round joins them, bucket by bucket and without a shuffle, with
the heaps of the round before, writes the heaps anew and adds up what entries lost and won. The driver holds codebooks,
sums and drifts only, whose size is that of the codebooks. A lost executor costs its tasks: every round reads written tables.

All arithmetic is exact: whole numbers in doubles where they fit 52 bits, else whole numbers of any size, block by block;
bounds are rounded to the safe side, and a part at equal distance of two entries is compared in every round.

Defined results: vectors that are null or hold null or non-finite components are left out, those without components are
not; shorter vectors count as followed by zeros, up to the longest length and to a multiple of the parts; null ids are kept
and come last where codebooks start; of repeated ids each row is one, ordered by its vector; fewer vectors than entries make fewer entries; errors beyond 64 bits
count as the largest such number; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from marlstone.llm.shared import bucketed, joined_by_key, written

#: Vectors of a block at most; bytes of vectors that a bucket is to hold.
BLOCK, BUCKET_BYTES = 8192, 64 << 20
_HIGH = (1 << 63) - 1
#: What square roots and sums in doubles may be off by, as a share.
_OFF = 1e-12


def most_of(width: int) -> int:
    """The largest component of which squared distances of this many components are exact in doubles."""
    return math.isqrt((1 << 50) // max(1, width))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), of any size."""
    ratios = (v.as_integer_ratio() for v in x.ravel().tolist())
    return np.array([n * scale // d for n, d in ratios], dtype=object).reshape(x.shape)


def root(x) -> float:
    try:
        return math.sqrt(x)
    except OverflowError:
        return math.inf


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries: exact, in doubles where both allow it, else in whole numbers of any size."""
    if x.dtype != object and book.size and np.abs(book).max() <= most_of(x.shape[1]):
        book = book.astype(np.float64)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    x, book = (np.array([[int(v) for v in row] for row in a.tolist()], dtype=object).reshape(a.shape) for a in (x, book))
    return ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(book)), dtype=object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower index), and how much nearer it is at least."""
    d = distances(x, book)
    own = np.argmin(d, axis=1) if len(d) else np.zeros(0, np.int64)
    at = np.arange(len(d))
    best = d[at, own].copy()
    d[at, own] = math.inf
    second = d.min(axis=1) if len(d) else best
    if d.dtype == object:
        best, second = (np.array([root(v) for v in c.tolist()]) for c in (best, second))
    else:
        best, second = np.sqrt(best), np.sqrt(second)
    with np.errstate(invalid="ignore"):
        slack = second * (1 - _OFF) - best * (1 + _OFF)
    return own, np.where(np.isnan(slack), -math.inf, slack)


def below(x: np.ndarray) -> np.ndarray:
    """As floats of four bytes, none larger than before."""
    with np.errstate(over="ignore"):
        y = x.astype("<f4")
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype("<f4")


class Heaps:
    """Of one block: for each part position the rows in heaps by entry; ``sizes`` says where one heap ends."""

    def __init__(self, rows: list[np.ndarray], keys: list[np.ndarray], sizes: np.ndarray):
        self.rows, self.keys, self.sizes = rows, keys, sizes

    @classmethod
    def empty(cls, parts: int, entries: int) -> Heaps:
        return cls([np.zeros(0, "<u2")] * parts, [np.zeros(0, "<f4")] * parts, np.zeros((parts, entries), "<i4"))

    @classmethod
    def of(cls, n: int, rows: bytes, keys: bytes, sizes: bytes, parts: int) -> Heaps:
        return cls(list(np.frombuffer(rows, "<u2").reshape(parts, n)), list(np.frombuffer(keys, "<f4").reshape(parts, n)), np.frombuffer(sizes, "<i4").reshape(parts, -1).copy())

    def pop(self, part: int, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose key the drift of their entry has reached, and their entries; they leave the heaps."""
        ends = np.cumsum(self.sizes[part])
        keys, cuts = self.keys[part], []
        for begin, end, d in zip((ends - self.sizes[part]).tolist(), ends.tolist(), drift.tolist(), strict=True):
            cuts.append((begin, begin + int(np.searchsorted(keys[begin:end], d, side="right")), end))
        out = np.concatenate([self.rows[part][a:b] for a, b, _ in cuts]).astype(np.int64)
        old = np.repeat(np.arange(len(cuts)), [b - a for a, b, _ in cuts])
        if len(out):
            self.rows[part], self.keys[part] = (np.concatenate([x[part][b:c] for _, b, c in cuts]) for x in (self.rows, self.keys))
            self.sizes[part] = [c - b for _, b, c in cuts]
        return out, old

    def push(self, part: int, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        if not len(rows):
            return
        order = np.lexsort((keys, entries))
        rows, entries, keys = rows[order], entries[order], keys[order]
        ends = np.cumsum(self.sizes[part])
        first = np.searchsorted(entries, np.arange(len(ends) + 1))
        places = np.empty(len(rows), dtype=np.int64)
        for e, (end, size) in enumerate(zip(ends.tolist(), self.sizes[part].tolist(), strict=True)):
            mine = slice(first[e], first[e + 1])
            places[mine] = end - size + np.searchsorted(self.keys[part][end - size : end], keys[mine])
        self.rows[part] = np.insert(self.rows[part], places, rows.astype("<u2"))
        self.keys[part] = np.insert(self.keys[part], places, keys)
        self.sizes[part] += np.diff(first).astype("<i4")

    def codes(self, part: int) -> np.ndarray:
        out = np.empty(len(self.rows[part]), dtype=np.uint8)
        out[self.rows[part]] = np.repeat(np.arange(self.sizes.shape[1]), self.sizes[part])
        return out


def _limbs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, limb, value) of numbers of any size in digits to the base 2 ** 32, zeros left out; their sum is the number."""
    place, limb, value = [], [], []
    for at, v in enumerate(values.tolist()):
        v, k = int(v), 0
        sign, v = (-1 if v < 0 else 1), abs(v)
        while v:
            if v & 0xFFFFFFFF:
                place.append(at)
                limb.append(k)
                value.append(sign * (v & 0xFFFFFFFF))
            v, k = v >> 32, k + 1
    return np.array(place, np.int32), np.array(limb, np.int32), np.array(value, np.int64)


def settle(values: np.ndarray, heaps: Heaps | None, books: np.ndarray, drifts: np.ndarray) -> tuple[Heaps, np.ndarray, int]:
    """One round of a block (rows, parts, width): its heaps, what each entry has won (sums, then the count; flat), and the
    number of parts that were compared."""
    n, parts, width = values.shape
    entries = books.shape[1]
    first = heaps is None
    heaps = Heaps.empty(parts, entries) if first else heaps
    won = np.zeros((parts, entries, width + 1), dtype=object)
    compared = 0
    for p in range(parts):
        rows, old = (np.arange(n), None) if first else heaps.pop(p, drifts[p])
        compared += len(rows)
        x = values[rows, p]
        new, slack = nearest(x, books[p])
        with np.errstate(invalid="ignore"):
            keys = slack + drifts[p][new]
        heaps.push(p, rows, new, below(np.where(np.isnan(keys), -math.inf, keys)))
        moved = np.arange(len(rows)) if first else np.flatnonzero(new != old)
        if len(moved):
            change = (new[moved, None] == np.arange(entries)).astype(np.int64)
            if not first:
                change -= (old[moved, None] == np.arange(entries)).astype(np.int64)
            sums = change.T.astype(values.dtype) @ x[moved]
            won[p, :, :width] += sums if values.dtype == object else sums.astype(np.int64)
            won[p, :, width] += change.sum(axis=0)
    return heaps, won.ravel(), compared


def _vector_blocks(rows: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """block, wide, n, ids, labels, matrix of ``rows`` (id, label, v): whole numbers of four bytes, or, of vectors with
    larger ones (wide), doubles before scaling."""
    kind = rows.schema["label"].dataType
    schema = StructType([StructField("block", LongType()), StructField("wide", BooleanType()), StructField("n", IntegerType()), StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(kind)), StructField("matrix", BinaryType())])
    limit, dim = most_of(width), parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, {False: [], True: []}

        def out(wide: bool) -> pa.RecordBatch:
            nonlocal number
            ids, labels, parts_of = zip(*held[wide], strict=True)
            held[wide], number = [], number + 1
            ids, labels, matrix = pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(parts_of)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([wide]), pa.array([len(ids)], pa.int32()), *lists, pa.array([matrix.tobytes()], pa.binary())], names=["block", "wide", "n", "ids", "labels", "matrix"])

        for batch in batches:
            vectors = batch.column(2)
            sizes, flat = np.asarray(vectors.value_lengths(), dtype=np.int64), np.asarray(vectors.flatten(), dtype="<f8")
            own = np.zeros((batch.num_rows, dim), dtype="<f8")
            at = np.repeat(np.arange(batch.num_rows), sizes)
            own[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            with np.errstate(over="ignore"):
                whole = np.floor(own * scale)
            large = (np.abs(whole) > limit).any(axis=1)
            for wide, which, values in ((False, ~large, whole), (True, large, own)):
                pick = np.flatnonzero(which)
                for cut in range(0, len(pick), BLOCK):
                    part = pick[cut : cut + BLOCK]
                    if sum(len(h[0]) for h in held[wide]) + len(part) > BLOCK:
                        yield out(wide)
                    held[wide].append((batch.column(0).take(pa.array(part)), batch.column(1).take(pa.array(part)), values[part] if wide else values[part].astype("<i4")))
        for wide in (False, True):
            if held[wide]:
                yield out(wide)

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def _numbers(matrix: bytes, wide: bool, n: int, parts: int, width: int, scale: int) -> np.ndarray:
    values = whole_numbers(np.frombuffer(matrix, "<f8"), scale) if wide else np.frombuffer(matrix, "<i4").astype(np.float64)
    return values.reshape(n, parts, width)


class Coded:
    """``rows`` (vec_id, label, code, error), the final ``books`` (parts, entries, width), and how many parts each round
    ``compared`` with all entries."""

    def __init__(self, rows: DataFrame, books: np.ndarray, compared: list[int]):
        self.rows, self.books, self.compared = rows, books, compared

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.books.ravel().tolist()).encode()).hexdigest()


def heap_lloyd(df: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> Coded:
    """Codes of all vectors after ``rounds`` rounds of Lloyd's algorithm from the ``entries`` vectors of the smallest ids."""
    spark = df.sparkSession
    x = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.when(fine, x).alias("v")).where("v is not null")
    longest, total = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width = max(1, -(-(longest or 0) // parts))
    starts = [list(r["v"]) for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    padded = np.array([v + [0.0] * (parts * width - len(v)) for v in starts] or np.zeros((0, parts * width)), dtype=np.float64)
    books = whole_numbers(padded, scale).reshape(len(starts), parts, width).transpose(1, 0, 2)
    if not starts:
        schema = StructType([StructField("vec_id", LongType()), StructField("label", rows.schema["label"].dataType), StructField("code", StructType.fromDDL("c string")["c"].dataType), StructField("error", LongType())])
        return Coded(spark.createDataFrame([], schema), books, [])
    k = len(starts)
    number = max(spark.sparkContext.defaultParallelism, -(-total * parts * width * 4 // BUCKET_BYTES))
    vectors = bucketed(_vector_blocks(rows, parts, width, scale).repartition(number, "block"), "vectors", ["block"], number)
    schema = "block long, rows binary, keys binary, sizes binary, compared long, won array<struct<place: int, limb: int, value: long>>"

    def one_round(books: np.ndarray, drifts: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    values = _numbers(row["matrix"], row["wide"], row["n"], parts, width, scale)
                    heaps = Heaps.of(row["n"], row["rows"], row["keys"], row["sizes"], parts) if "rows" in row else None
                    heaps, won, compared = settle(values, heaps, books, drifts)
                    place, limb, value = _limbs(won)
                    changes = pa.StructArray.from_arrays([pa.array(place), pa.array(limb), pa.array(value)], names=["place", "limb", "value"])
                    made = [np.concatenate(heaps.rows).tobytes(), np.concatenate(heaps.keys).tobytes(), heaps.sizes.tobytes()]
                    columns = [pa.array([row["block"]]), *(pa.array([b], pa.binary()) for b in made), pa.array([compared]), pa.ListArray.from_arrays(pa.array([0, len(place)], pa.int32()), changes)]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "rows", "keys", "sizes", "compared", "won"])

        return run

    met = vectors.select("block", "wide", "n", "matrix")
    drifts, state, compared = np.zeros((parts, k)), None, []
    totals = np.zeros((parts, k, width + 1), dtype=object)
    for _ in range(rounds):
        joined = met if state is None else met.join(state.select("block", "rows", "keys", "sizes"), "block")
        state = bucketed(joined.mapInArrow(one_round(books, drifts), schema), "heaps", ["block"], number, (state,) if state else ())
        compared.append(state.agg(F.sum("compared")).first()[0] or 0)
        # A row for each number of the codebooks and its digits, whatever the number of vectors.
        for r in state.select(F.explode("won").alias("w")).groupBy("w.place", "w.limb").agg(F.sum("w.value").alias("v")).collect():
            totals.reshape(-1)[r["place"]] += int(r["v"]) << (32 * r["limb"])
        books, drifts = _moved(books, totals, drifts)
    out = _final(vectors, state, books, drifts, parts, width, scale, rows.schema["label"].dataType)
    compared.append(out.agg(F.sum("_compared")).first()[0] or 0)
    return Coded(out.drop("_compared"), books, compared)


def _moved(books: np.ndarray, totals: np.ndarray, drifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries at the floored means of their parts, and the drifts that this adds up to."""
    sums, counts = totals[:, :, :-1], totals[:, :, -1]
    new = np.where(counts[:, :, None] > 0, sums // np.where(counts > 0, counts, 1)[:, :, None], books)
    far = np.array([[root(int(d)) * (1 + _OFF) for d in row] for row in ((new - books) ** 2).sum(axis=2).tolist()]).reshape(drifts.shape)
    most = np.array([[max((v for j, v in enumerate(row) if j != i), default=0.0) for i in range(len(row))] for row in far.tolist()]).reshape(drifts.shape)
    return new, (drifts + far + most) * (1 + _OFF)


def _final(vectors: DataFrame, state: DataFrame | None, books: np.ndarray, drifts: np.ndarray, parts: int, width: int, scale: int, kind) -> DataFrame:
    """vec_id, label, code, error, and in the first row of each block the number of parts that were compared."""
    schema = StructType([StructField("vec_id", LongType()), StructField("label", kind), *StructType.fromDDL("code string, error long, _compared long").fields])
    joined = vectors if state is None else vectors.join(state.select("block", "rows", "keys", "sizes"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for at in range(batch.num_rows):
                row = {c: batch.column(i)[at].as_py() for i, c in enumerate(names) if c not in ("ids", "labels")}
                values = _numbers(row["matrix"], row["wide"], row["n"], parts, width, scale)
                heaps, _, compared = settle(values, Heaps.of(row["n"], row["rows"], row["keys"], row["sizes"], parts) if "rows" in row else None, books, drifts)
                codes = np.stack([heaps.codes(p) for p in range(parts)], axis=1)
                error = np.zeros(row["n"], dtype=object)
                for p in range(parts):
                    if values.dtype != object and np.abs(books[p]).max() <= most_of(width):
                        error += ((values[:, p] - books[p].astype(np.float64)[codes[:, p]]) ** 2).sum(axis=1).astype(np.int64)
                    else:
                        own = np.array([[int(v) for v in r] for r in values[:, p].tolist()], dtype=object)
                        error += ((own - books[p][codes[:, p]]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                ids, labels = (batch.column(names.index(c)) for c in ("ids", "labels"))
                columns = [ids[at].values, labels[at].values, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array([min(int(v), _HIGH) for v in error.tolist()], pa.int64()), pa.array([compared] + [0] * (row["n"] - 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "_compared"])

    return written(joined.mapInArrow(run, schema), "codes", (vectors, state) if state else (vectors,))


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the error of all rows of their label, nulls together. Labels are added up before they are joined, and
    hot ones joined in place."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = coded.withColumn("_label", key)
    most = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(_HIGH).cast("decimal(20,0)")).cast("long")
    totals = keyed.groupBy("_label").agg(most.alias("label_error"), F.count("*").alias("_n"))
    return joined_by_key(keyed, totals, ["_label"], "_n").drop("_label", "_n")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: eight parts, codebooks of sixteen entries, six rounds."""
    coded = heap_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(coded.rows).select("vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain Lloyd in SQL: every round compares all parts with all entries."""
    far = "cast(list_sum(list_transform(list_zip(x.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    out = [
        f"v as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"x as materialized (select r, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] as e from v, (select unnest(range({parts})) as p))",
        f"b0 as materialized (select p, r - 1 as c, e from x where r <= {entries})",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} as materialized (select x.r, x.p, arg_min(b.c, ({far}, b.c)) as c, min({far}) as d from x join b{n} b on b.p = x.p group by x.r, x.p)")
        if n < rounds:
            mean = "select a.p, a.c, j, cast(floor(sum(x.e[j]) / count(*)) as bigint) as m from (select *, unnest(range(1, len(e) + 1)) as j from x) x join a{0} a on a.r = x.r and a.p = x.p group by all".format(n)
            out.append(f"b{n + 1} as materialized (select b.p, b.c, coalesce(m.e, b.e) as e from b{n} b left join (select p, c, list(m order by j) as e from ({mean}) group by p, c) m on m.p = b.p and m.c = b.c)")
    last = f"select r, string_agg(printf('%02x', c), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by r"
    digest = f"select sha256(string_agg(array_to_string(e, ','), ',' order by p, c)) as h from b{rounds}"
    return f"with {', '.join(out)}, l as ({last}) select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from l join v on v.r = l.r, ({digest})"


ORACLE = oracle()
