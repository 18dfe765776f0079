"""Fill-in-the-middle documents against a plain version."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import middle

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def plain(doc_id, text, seed="1"):
    t, x = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b, c = t[:lo], t[lo:hi], t[hi:]
    return (doc_id, n, "spm", lo, hi - lo, f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (doc_id, n, "psm", lo, hi - lo, f"<P>{a}<S>{c}<M>{b}")


def test_elias_fano():
    rng = np.random.default_rng(1)
    for spread in (1, 2, 3, 9, 1000, 1 << 40):
        for n in (1, 2, 63, 64, 65, 500):
            values = np.sort(rng.integers(0, n * spread, n))
            listed = middle.EliasFano.from_bytes(middle.EliasFano.of(values).to_bytes())
            assert [listed.select(i) for i in range(n)] == values.tolist()


def test_boundaries():
    text = "aé漢😀́ z" * 9
    listed = middle.boundaries(text.encode())
    assert [listed.select(i) for i in range(listed.n)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert len(middle.boundaries(b"a" * 80000).to_bytes()) <= 80000 // 4 + 20
    assert middle.boundaries(b"").n == 1


def rows_of(docs):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("ab é漢😀<>PSM\n\t") for _ in range(n))
    texts = [None, "", "x", "<P>", "ends with <", "S> begins", "<S", "<M>inside", " ", "́", make(50000)] + [make(rng.randrange(1, 80)) for _ in range(60)]
    return [(i, texts[rng.randrange(len(texts))], i) for i in range(docs)] + [(None, "no id", 1), (None, None, 1), (5, "again", 1), (5, "again", 1)]


@pytest.mark.parametrize("share", [1000, 4])
def test_against_plain(spark, monkeypatch, share):
    """Copies, repeated and null ids, markers and what looks like them; with a small ``SHARE`` most texts are hot."""
    monkeypatch.setattr(middle, "SHARE", share)
    rows = rows_of(300) + [(1000 + i, "a third of all rows", i) for i in range(150)]
    got = middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, n long"))
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is not None, x or 0) if i != 2 and i != 5 else (True, x) for i, x in enumerate(r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((plain(i, t) for i, t, _ in rows), key=key)
    back = got.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.t) for r in back.collect())) == sorted((i is None, i or 0, t or "") for i, t, _ in rows)


def test_entries_once(spark):
    """Each distinct text has one entry; texts are told apart by their bytes, not by their hash."""
    rows = rows_of(200)
    members, entries = middle.text_index(spark.createDataFrame(rows, "doc_id long, text string, x long"))
    assert entries.count() == len({t or "" for _, t, _ in rows})
    assert members.join(entries, "text_id").count() == len(rows)


def test_seed_and_shares(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "id long, body string")
    forms = {r.form for r in middle.fill_in_middle(df, "7", 0, 100, "id", "body").collect()}
    assert forms == {"spm"}
    assert {r.form for r in middle.fill_in_middle(df, "7", 100, 50, "id", "body").collect()} == {"plain"}
    assert [tuple(r) for r in middle.fill_in_middle(df, "7", 10, 20, "id", "body").orderBy("doc_id").collect()] == [plain(i, f"text number {i}", "7") for i in range(200)]


def test_empty_table(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
