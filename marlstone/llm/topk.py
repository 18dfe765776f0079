"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum over two slices of the dimensions. Phase 1 gathers local lists: every vector block knows the first
slice's partial scores, bounds each score from above (the rest by Cauchy and Schwarz) and resolves the k entries of the
largest bounds; the k-th largest of all these exact scores is a cutoff that no answer is below. Phase 2 sends every query
its cutoff and has the blocks collect all entries whose bound reaches it. Phase 3 resolves the remaining slice of the
collected entries where the vectors lie and keeps the k best of each block, which a ranked window merges. Only the first
slice is ever multiplied out for all pairs.

Vectors and queries travel in blocks that meet on a pair of group numbers; there are at most ``COPIES`` groups of query
blocks and ``100 * COPIES`` of vector blocks, so each block is copied a bounded number of times, and no task holds all.

Components so large that sums might not fit 63 bits go into blocks of their own, which are scored in whole numbers of
any size.

Defined results: vectors that are null or hold null or non-finite components, and null ids, take no part; only vectors of
one length score with each other; rows with the query's id are its own; a query id that is repeated asks once, with its
smallest vector; rows with one id are answers of their own; ties go to the smaller id; a score beyond 64 bits counts as
the largest or smallest such number; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import written

#: Rows of a vector block and of a query block; queries scored at a time; copies of a vector block, at most.
VECTORS, QUERIES, AT_ONCE, COPIES = 4096, 2048, 128, 16
#: The share of collected entries from which a slice is multiplied out instead of entry by entry.
DENSE = 0.05
#: Of a query with fewer than k entries: no score is smaller.
NO_CUTOFF = -(1 << 63)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def sound(embedding: str):
    """The components in double, or null if the vector takes no part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0), x)


def most_of(dim: int) -> int:
    """The largest component of which inner products of this length, and what they are bounded by, fit 52 bits."""
    return math.isqrt((1 << 52) // dim)


def wide_integers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    out = []
    for x in row.tolist():
        n, d = x.as_integer_ratio()
        out.append(n * scale // d)
    return out


def _blocks(rows: DataFrame, most: int, scale: int, name: str) -> DataFrame:
    """block, dim, wide, ids binary, matrix binary of (id, v): rows of whole numbers up to ``most_of`` in two or four bytes
    each, those with larger ones (wide) as doubles before scaling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[tuple[int, bool], list] = {}
        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("matrix", pa.binary())])

        def out(key):
            nonlocal number
            ids, parts = zip(*held.pop(key), strict=True)
            number += 1
            matrix = np.concatenate(parts)
            if not key[1] and np.abs(matrix).max() < 1 << 15:
                matrix = matrix.astype("<i2")
            return pa.RecordBatch.from_pydict({"block": [number], "dim": [key[0]], "wide": [key[1]], "ids": [np.concatenate(ids).tobytes()], "matrix": [matrix.tobytes()]}, schema=schema)

        for batch in batches:
            ids, sizes = np.asarray(batch.column(0), dtype="<i8"), np.asarray(batch.column(1).value_lengths(), dtype=np.int64)
            flat, ends = np.asarray(batch.column(1).flatten(), dtype="<f8"), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                own = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                with np.errstate(over="ignore"):
                    whole = np.floor(own * scale)
                large = (np.abs(whole) > most_of(dim)).any(axis=1)
                for wide, which, values in ((False, ~large, whole), (True, large, own)):
                    pick = np.flatnonzero(which)
                    for cut in range(0, len(pick), most):
                        part = pick[cut : cut + most]
                        held.setdefault((dim, wide), []).append((ids[at[part]], values[part] if wide else values[part].astype("<i4")))
                        if sum(len(x[0]) for x in held[dim, wide]) >= most:
                            yield out((dim, wide))
        for key in list(held):
            yield out(key)

    return written(rows.mapInArrow(run, "block long, dim int, wide boolean, ids binary, matrix binary"), name)


class _Pair:
    """Some queries against a vector block: partial scores, bounds, and exact scores of chosen entries."""

    def __init__(self, q: np.ndarray, v: np.ndarray):
        self.q, self.v, self.half = q, v, (q.shape[1] + 1) // 2
        self.part = q[:, : self.half] @ v[:, : self.half].T  # whole numbers below 2 ** 52, so exact
        # Norms are rounded up, so the bound is none too small.
        norm = lambda x: np.ceil(np.sqrt((x[:, self.half :] ** 2).sum(axis=1)) * (1 + 1e-12))
        self.bound = self.part + norm(q)[:, None] * norm(v)[None, :]

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(i) > DENSE * self.part.size:
            rest = (self.q[:, self.half :] @ self.v[:, self.half :].T)[i, j]
        else:
            rest = np.concatenate([np.einsum("ij,ij->i", self.q[i[a : a + 65536], self.half :], self.v[j[a : a + 65536], self.half :]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        return (self.part[i, j] + rest).astype(np.int64)


def _wide_scores(q: np.ndarray, v: np.ndarray, q_wide: bool, v_wide: bool, scale: int) -> np.ndarray:
    """All scores of some queries and vectors in whole numbers of any size, then held to 64 bits."""
    whole = lambda x, wide: np.array([wide_integers(r, scale) if wide else list(map(int, r.tolist())) for r in x], dtype=object)
    return np.clip(whole(q, q_wide) @ whole(v, v_wide).T, _LOW, _HIGH).astype(np.int64)


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    """The rows of a block in double."""
    return np.frombuffer(raw, {2: "<i2", 4: "<i4", 8: "<f8"}[len(raw) // (n * dim)]).reshape(n, dim).astype("<f8", copy=False)


def _met(vectors: DataFrame, queries: DataFrame, k: int, scale: int, phase: int) -> DataFrame:
    """The scores of a phase: vector blocks and query blocks of one length meet on a pair of group numbers. Either side of
    a pair is sent to the worker once, so it holds these blocks, and no pairs of them."""
    n_vectors, n_queries = (max(1, min(most, df.count())) for df, most in ((vectors, 100 * COPIES), (queries, COPIES)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(n_vectors)).cast("int")).withColumn("q_group", all_of(n_queries))
    q = queries.withColumn("q_group", F.pmod(F.xxhash64("q_block"), F.lit(n_queries)).cast("int")).withColumn("group", all_of(n_vectors))
    sides = (x.groupBy("group", "q_group", "dim") for x in (v, q))
    scores = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = left.to_pylist()
        pairs = (block | asked for asked in right.to_pylist() for block in blocks)
        return pa.Table.from_batches(_scored(pairs, k, scale, phase), schema=scores)

    return next(sides).cogroup(next(sides)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(score: np.ndarray, i: np.ndarray, ids: np.ndarray, k: int, n: int) -> np.ndarray:
    """Places of the k best entries of each query i (of n): larger scores, then smaller ids."""
    order = np.lexsort((ids, -score.astype(np.float64), i)) if len(score) == 0 or np.abs(score).max() < 1 << 53 else np.lexsort((ids, ~score, i))
    first = np.searchsorted(i[order], np.arange(n))
    return order[np.arange(len(order)) - first[i[order]] < k]


def _scored(pairs: Iterator[dict], k: int, scale: int, phase: int) -> Iterator[pa.RecordBatch]:
    """query_id, vec_id, score of phase 1 (the entries with the k largest bounds of each pair of blocks) or of phases 2
    and 3 (the k best of those that reach the cutoff)."""
    for row in pairs:
        dim, wide = row["dim"], row["wide"] or row["q_wide"]
        v_ids, all_ids = (np.frombuffer(row[c], "<i8") for c in ("ids", "q_ids"))
        v, all_q = _matrix(row["matrix"], len(v_ids), dim), _matrix(row["q_matrix"], len(all_ids), dim)
        cutoffs = dict(zip(row["cut_ids"], row["cutoffs"], strict=True)) if row.get("cut_ids") else {}
        for begin in range(0, len(all_ids), AT_ONCE):
            q_ids, q = all_ids[begin : begin + AT_ONCE], all_q[begin : begin + AT_ONCE]
            cut = np.array([cutoffs.get(i, NO_CUTOFF) for i in q_ids.tolist()], dtype=np.int64)
            own = q_ids[:, None] == v_ids[None, :]
            if wide:
                i, j = np.nonzero(~own)
                score = _wide_scores(q, v, row["q_wide"], row["wide"], scale)[i, j]
            else:
                pair = _Pair(q, v)
                if phase == 1:
                    bound = np.where(own, -np.inf, pair.bound)
                    top = np.argpartition(-bound, k, axis=1)[:, :k] if bound.shape[1] > k else np.tile(np.arange(bound.shape[1]), (len(q), 1))
                    i, j = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                    i, j = i[~own[i, j]], j[~own[i, j]]
                else:
                    i, j = np.nonzero((pair.bound >= cut[:, None].astype(np.float64)) & ~own)
                score = pair.exact(i, j)
            enough = score >= cut[i]
            i, j, score = i[enough], j[enough], score[enough]
            kept = _best(score, i, v_ids[j], k, len(q_ids))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i[kept]]), pa.array(v_ids[j[kept]]), pa.array(score[kept])], names=["query_id", "vec_id", "score"])


def top_k(df: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row for which ``is_query`` holds."""
    rows = df.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), sound(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    vectors = _blocks(rows.select("id", "v"), VECTORS, scale, "vectors")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    queries = _blocks(asked, QUERIES, scale, "queries").toDF("q_block", "dim", "q_wide", "q_ids", "q_matrix")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = _met(vectors, queries, k, scale, 1)
    cutoffs = local.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("score").alias("cutoff"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], names=["q_block", "query_id"])

    of_block = queries.select("q_block", "q_ids").mapInArrow(listed, "q_block long, query_id long").join(cutoffs, "query_id")
    sent = of_block.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("c")).select("q_block", F.col("c.query_id").alias("cut_ids"), F.col("c.cutoff").alias("cutoffs"))
    with_cutoff = written(queries.join(sent, "q_block", "left"), "cutoffs")
    found = written(_met(vectors, with_cutoff, k, scale, 2), "scores", (vectors, queries, with_cutoff))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer inner products of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""
