"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed character n-grams (log-odds of an
n-gram between the languages with a one and those with a zero) gives a margin; the prediction is the language whose
codeword has the least logistic loss, each bit weighted by how well it separates the training counts. A prediction whose
loss is close to the next one's is flagged ambiguous.

The classifier is fitted on a bounded sample of labelled rows: about ``PER_LANGUAGE`` for each language, those with the
smallest hashes; only counts by language and n-gram bucket reach the driver. Prediction reads whole texts.

A letter is a character of the Unicode category L; digits and signs that stand for numbers are none.

Defined results: null text, or text without a letter, is ``und`` with score 0; rows without a label don't train; without
any training row every text is ``und``; a tie goes to the language first in order; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import mixed, sliced, text_column

#: Rows of each language that the classifier is fitted on, about.
PER_LANGUAGE = 600
#: Hash buckets of n-grams; lengths of n-grams, a word's ends included.
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3, 4)
#: Words a task remembers before it forgets them all.
REMEMBERED = 300_000
#: A prediction is ambiguous if its score is below this.
SURE = 0.6
_WORD = regex.compile(r"\p{L}+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, flat, and the number of n-grams of each word."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    last = np.repeat(np.cumsum(size), size)  # the end of the word of each place
    word = np.repeat(np.arange(len(words)), size)
    salted = mixed(points + np.uint64(7))
    rolled = np.zeros(len(points), dtype=np.uint64)
    buckets, owners = [], []
    for n in range(1, max(LENGTHS) + 1):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x9FB21C651E98DF25) + salted[n - 1 :]
        if n in LENGTHS and len(rolled):
            whole = np.arange(len(rolled)) + n <= last[: len(rolled)]
            if n == 1:
                whole &= points != 32
            buckets.append((mixed(rolled[whole] + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
            owners.append(word[: len(rolled)][whole])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate(buckets)[order] if owners else owner
    return flat, np.bincount(owner, minlength=len(words))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all bit patterns that differ for n up to 7, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1, *bits] for bits in product((1, -1), repeat=n - 1)][1:]).T.astype(float)
    rng, best = np.random.default_rng(11), None
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), size=(n, int(np.ceil(10 * np.log2(n)))))
        near = (code @ code.T - np.eye(n) * code.shape[1]).max()
        if (np.abs(code.sum(0)) < n).all() and (best is None or near < best[0]):
            best = near, code
    return best[1]


class Codes:
    """The fitted classifiers: ``weights`` (bucket by bit), ``code`` (language by bit), ``trust`` (of each bit)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, bits), dtype=np.float32)
        self.trust = np.ones(bits)
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # each language counts alike
        for b in range(bits if len(languages) > 1 else 0):
            one, zero = share[self.code[:, b] > 0].mean(0), share[self.code[:, b] < 0].mean(0)
            self.weights[:, b] = np.log(one) - np.log(zero)
            self.trust[b] = 0.5 * ((one - zero) * self.weights[:, b]).sum()
        self.trust /= self.trust.mean()

    def decide(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row, from summed weights and the number of n-grams."""
        if not self.languages:
            return np.full(len(sums), -1), np.zeros(len(sums))
        margins = sums / np.sqrt(np.maximum(n, 1))[:, None]
        loss = np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(1) for row in self.code], axis=1)
        chosen = loss.argmin(1)
        odds = np.exp(-(loss - loss.min(1, keepdims=True)))
        return np.where(n > 0, chosen, -1), np.where(n > 0, odds.max(1) / odds.sum(1), 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Codes:
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    # One row for each language reaches the driver; the sample keeps the texts whose hash is small enough.
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Codes([], np.zeros((0, BUCKETS)))
    limit = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1 << 20, (per_language << 20) // n + 1))])
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < limit[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text"):
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat, _ = grams(_WORD.findall(value.lower()))
                counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                counts[name] += np.bincount(flat, minlength=BUCKETS)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    # At most BUCKETS rows for each language.
    sums = some.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals)
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(dtype=int), sums["bucket"].to_numpy(dtype=int)] = sums["n"].to_numpy()
    return Codes(languages, counts)


class _WordScores:
    def __init__(self, codes: Codes):
        self.codes = codes
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, self.codes.code.shape[1] + 1 if len(self.codes.languages) else 1), dtype=np.float32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.clear()
        words, sizes = [], []
        for t in texts:
            found = _WORD.findall(t.lower())
            words += found
            sizes.append(len(found))
        place = self.place
        if new := list(dict.fromkeys(w for w in words if w not in place)):
            flat, counts = grams(new)
            ends = np.cumsum(counts)
            rows = np.add.reduceat(self.codes.weights[flat], ends - counts) if self.codes.languages else np.zeros((len(new), 0))
            self.scores = np.concatenate([self.scores, np.column_stack([rows, counts]).astype(np.float32)])
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        out = np.zeros((len(texts), self.scores.shape[1]))
        full = np.flatnonzero(np.diff(upto))
        if len(full):
            out[full] = np.add.reduceat(self.scores[at].astype(np.float64), upto[full])
        return out[:, :-1], out[:, -1]


def identify(df: DataFrame, codes: Codes, text: str = "text") -> DataFrame:
    """``df`` with lang_pred string, score double and ambiguous boolean; columns of these names are replaced."""
    from pyspark.sql.types import StructType

    base = df.drop("lang_pred", "score", "ambiguous")
    schema = StructType(base.schema.fields + StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _WordScores(codes)
        names = np.array([*codes.languages, "und"], dtype=object)
        for batch in sliced(batches, text):
            chosen, sure = codes.decide(*scores.of(text_column(batch, text).to_pylist()))
            added = [pa.array(names[chosen], pa.string()), pa.array(sure, pa.float64()), pa.array(sure < SURE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return base.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for documents that must not train: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    codes = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), codes).drop("text")
