"""The stages of the pipeline against plain versions."""

import random

import pytest

import corpus_pipeline
from marlstone.llm import queries
from tests.llm import brute
from tests.llm.test_pairs import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    texts = {i: t for i, t in corpus(31, 30).items() if t}
    return texts, spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], SCHEMA)


def test_near_copies(spark, docs):
    texts, df = docs
    got = corpus_pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == {i for i, (_, c) in brute.jaccard(texts, 5, 80).items() if i == c}


def test_line_dedup(spark, docs):
    texts, df = docs
    got = corpus_pipeline.line_dedup(spark, df, "")
    kept = brute.line_dedup(texts)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {i: t for i, t in kept.items() if t == texts[i] or brute.words(t)}


def fixture():
    """Texts in two languages with copies, near copies, common lines, passages of items, junk, and texts of nothing."""
    rng = random.Random(77)
    words = {"en": "the of and to in that it was for on with as his they be at one have this from".split(), "de": "der die und das ist nicht ein eine mit sich des auf für von dem den im zu auch als".split()}
    items = {i: " ".join(f"{rng.choice(words['en'])}{rng.randrange(50)}" for _ in range(n)) for i, n in enumerate((6, 13, 40))}
    docs, labels = {}, {}
    for i in range(90):
        lang = rng.choice(["en", "de"])
        text = "\n".join(" ".join(rng.choice(words[lang]) + rng.choice(["", "", "x", "y"]) for _ in range(rng.choice([4, 15, 30]))) for _ in range(rng.choice([1, 3, 5])))
        kind = rng.random()
        if kind < 0.2 and docs:
            text = docs[rng.choice(sorted(docs))] or text
            if kind < 0.1:
                text = text.replace(" ", " extra ", 1)
        elif kind < 0.3:
            text += "\nthis line stands on very many of the pages"
        elif kind < 0.4:
            text += "\n" + rng.choice(list(items.values())).upper().replace(" ", "  ", 1)
        docs[i], labels[i] = text, rng.choice([lang, lang, None])
    docs |= {100: None, 101: "", 102: "12 ½ !?", 103: " \n "}
    labels |= {i: "en" for i in range(100, 104)}
    return docs, labels, items


def test_language(spark):
    docs, labels, _ = fixture()
    df = spark.createDataFrame([(i, t, labels[i], "web", len(t or "")) for i, t in docs.items()], SCHEMA)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, df, "").collect()}
    want = brute.languages(docs, labels)
    assert got == {i: labels[i] or x for i, x in want.items() if x}


def test_decontamination(spark, tmp_path):
    docs, labels, items = fixture()
    df = spark.createDataFrame([(i, t, labels[i], "web", len(t or "")) for i, t in docs.items()], SCHEMA)
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect()}
    assert got == set(docs) - {i for i, _ in brute.contaminated(docs, items)} and len(got) < len(docs)


def test_run(spark, tmp_path):
    """The whole pipeline against its stages' plain versions, one after the other."""
    import sentencepiece

    docs, labels, items = fixture()
    spark.createDataFrame([(i, t, labels[i], "web", len(t or "")) for i, t in docs.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    lang = {i: labels[i] or x for i, x in brute.languages(docs, labels).items() if x}
    texts = {i: docs[i] for i in lang}
    kept = {i: t for i, t in brute.line_dedup(texts).items() if t == texts[i] or brute.words(t)}
    kept = {i: kept[i] for i, (_, c) in brute.jaccard(kept, 5, 80).items() if i == c}
    bad = {i for i, _ in brute.contaminated(kept, items)}
    kept = {i: t for i, t in kept.items() if i not in bad}
    assert bad and len(kept) < len(texts) - len(bad)
    known = sentencepiece.SentencePieceProcessor(model_file=pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    assert {i: (r.lang, r.source, r.n_chars, r.n_tokens, list(r.ids)) for i, r in got.items()} == {i: (lang[i], "web", len(t), len(known.encode(t)), known.encode(t)) for i, t in kept.items()}


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_jaccard_join"])
def test_as_sql(spark, name):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{folder}/{file}')")
    want = con.execute(queries.ORACLE_SQL[name]).fetch_df()
    got = queries.QUERIES[name](spark, folder).select(*want.columns).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_batches_are_bounded(spark):
    """Texts reach Python in small batches, so that an executor never holds many times ten thousand of them."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('x', 5000) as text")
    own = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(own)
        corpus_pipeline.line_dedup(spark, spark.createDataFrame([], SCHEMA), "")
        seen = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(seen) == 4000 and max(seen) * 5000 < 3 << 20
        spark.conf.set(own, "1m")
        corpus_pipeline.line_dedup(spark, spark.createDataFrame([], SCHEMA), "")
        assert spark.conf.get(own) == "1m"
    finally:
        spark.conf.unset(own)
