"""The corpus pipeline: raw documents in, token ids of clean documents out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to
the shared folder and reads again as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined results: documents with a null or empty text, or without a letter, go in the first stage (they have no language);
rows without an id go in the near-copy stage; rows of one id are one document to the near-copy stage and stay or go
together; ties go to the smaller id; extra columns pass through up to the last stage; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, langid, lines, parity, pieces
from marlstone.llm.shared import small_batches, written


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The session keeps the bound of batches, as a stage's result is computed when it is written."""

    @wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain: those without a letter and ambiguous ones go. A missing label is filled in."""
    codes = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify(docs, codes).where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those that lose all their words go."""
    done = lines.dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more)."""
    # Narrow sketches: here many pairs of long documents are bounded, and each takes its sketches along.
    groups = parity.linked_components(docs, 5, 80, method=parity.Parity(80, 4))
    firsts = groups.where("doc_id = component_id").select("doc_id")
    return docs.join(firsts, "doc_id", "left_semi").select(docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    import public_tokenizers

    done = pieces.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]
#: Language classifiers and tokenizers are not SQL; every stage and the whole are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, (docs,))
    return docs
