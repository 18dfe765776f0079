"""Operators on single texts, vectors, pages and URLs against libraries and plain versions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import idstore, langid, mainpage, pieces, topk, urllist
from marlstone.llm.shared import new_path
from tests.llm import brute

tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "Hello  world", "\ttabs\nand spaces ", "naïve café 漢字かな \U0001f600‍", "▁▁x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ﬁ ① Å", "x" * 3000, "0123 4567.89 <s> </s> <unk>", "á ë\x00\x7f"]


def docs(spark):
    rng = random.Random(4)
    letters = "abcdefghijklm nopqrstuvwxyz  .,\n" + "éßжщ漢字\U0001f680"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.choice([5, 60, 900]))) for _ in range(40)]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")


def test_pieces_as_the_library(spark):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, df = docs(spark)
    want = {i: known.encode(t or "") for i, t in enumerate(texts)}
    rows = pieces.round_trip(df, path).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want
    assert {r.doc_id: r.decoded for r in rows} == {i: known.decode(ids) for i, ids in want.items()}
    assert {r.doc_id: list(r.ids) for r in pieces.encode(df, path).collect()} == want
    assert pieces.round_trip(df.where("false"), path).count() == 0


def test_id_store(spark):
    import tokenizers as library

    path = tokenizers.path("byte_bpe_50k.json")
    known = library.Tokenizer.from_file(path)
    texts, df = docs(spark)
    folder = new_path(spark, "store")
    idstore.write_store(idstore.tokenize(df, path), folder)
    start = 0
    for r in idstore.read_store(spark, folder).orderBy("doc_id").collect():
        ids = [*known.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_ids, list(np.frombuffer(r.ids, "<u4"))) == (start, len(ids), ids)
        start += len(ids)
    assert r.doc_id == len(texts) - 1
    assert idstore.damaged(spark, folder).count() == 0


def test_id_query(spark):
    got = idstore.op10_query(spark, SMALL).orderBy("doc_id").collect()
    assert got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in got) and got[0].ids_crc32 != zlib.crc32(b"")


def test_language(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.op8_query(spark, SMALL).join(rows.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und' and held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.9 * n
    assert {r.held_out for r in found.collect()} == {True}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in langid.op8_query(spark, SMALL).collect())


def test_language_of_nothing(spark):
    some = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "text", None)], "doc_id long, text string, lang string")
    codes = langid.fit(some)
    ask = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !?", "c"), (4, "the the the", "d"), (5, "und der die", "e"), (6, "½ ² ① Ⅷ", "f")], "doc_id long, text string, score string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(ask, codes).collect()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "und"}
    none = langid.fit(some.where("false"))
    assert {r.lang_pred for r in langid.identify(ask, none).collect()} == {"und"}


def test_codewords_differ():
    for n in range(2, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, rng.random()]) for _ in range(6)], "x") for i in range(150)]
    rows += [(200, None, "x"), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (301, [math.nan] * 6, "x"), (302, [math.inf] * 6, "x"), (400, [1.0] * 3, "x"), (None, [1.0] * 6, "x"), (401, [2.0] * 3, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    sound = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q, a in sound.items():
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound.items() if i != q and len(a) == len(b))[:7]
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == {q: x for q, x in want.items() if x}
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0


def test_top_k_repeated_candidates(spark):
    """Rows with one id don't add up to a bound; each is an answer of its own."""
    vectors = [(0, (1.0, 1.0))] + [(i, (100.0, 100.0)) for i in range(1, 9)] + [(9, (0.0, 100.0))] + [(i, (0.0, 10.0)) for i in range(10, 30)] + [(30, (110.0, -50.0))] * 2
    df = spark.createDataFrame([(i, list(v)) for i, v in vectors], "vec_id long, embedding array<double>")
    for k in (10, 11, 12):
        got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k, scale=1).orderBy("rank").collect()]
        scores = sorted((-int(sum(v)), i) for i, v in vectors if i)[:k]
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_top_k_of_huge_components(spark):
    """Components beyond what sums in 64 bits allow: exact, then held to 64 bits; other rows are scored as ever."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(4)]) for i in range(40)]
    rows += [(50, [1e300, 0.0, 0.0, 0.0]), (51, [-1.7e308, 1.0, 0.0, 0.0]), (52, [3e9, -3e9, 1.5, 0.0]), (53, [2.0**60, 2.0**60, 0.5, -0.25]), (54, [1e6, 1e6, 1e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 < 4, k=12).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = {i: topk.wide_integers(np.array(v), 1024) for i, v in rows}
    assert whole[0] == [math.floor(1024 * x) for x in rows[0][1]]
    held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q, a in whole.items():
        if q % 10 < 4:
            scores = sorted((-held(sum(x * y for x, y in zip(a, b))), i) for i, b in whole.items() if i != q)[:12]
            assert got[q] == [(i, -s) for s, i in scores]


def test_top_k_collects_few(spark):
    """Where the first slice says enough, the cutoff leaves few entries to resolve, and none of the answers is lost."""
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(500, 16)) * np.repeat([100, 1], 8))
    pair = topk._Pair(v[:20], v)
    whole = (v[:20] @ v.T).astype(np.int64)
    assert (pair.bound >= whole).all()
    tenth = -np.sort(-whole, axis=1)[:, 9:10]
    assert (pair.bound >= tenth).sum() < 0.1 * whole.size
    i, j = np.nonzero(pair.bound >= tenth)
    assert (pair.exact(i, j) == whole[i, j]).all() and (pair.exact(i[:3], j[:3]) == whole[i[:3], j[:3]]).all()


def test_url_list_is_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SMALL}/pages.parquet')")
    key = lambda r: tuple("" if x is None else str(x)[:10] if i in (2, 5) else str(x) for i, x in enumerate(r))
    columns = "page_id, url, fetched_at, decision, rule, listed_at"
    want = sorted(map(key, con.execute(f"select {columns} from ({urllist.ORACLE})").fetchall()))
    assert sorted(map(key, urllist.op5_query(spark, SMALL).select(*columns.split(", ")).collect())) == want


def test_url_list(spark):
    entries = spark.createDataFrame([("a.com", "block", 10), ("a.com", "remove", 20), ("a.com", "block", 30), ("a.com/ok", "allow", 5), ("x.a.com", "allow", 12), (None, "block", 1), ("b.com", "block", None)], "rule string, action string, listed_at int")
    seen = [("http://a.com/p", 9), ("http://a.com/p", 10), ("http://a.com/p", 20), ("http://u@www.A.com:80/p", 35), ("http://a.com/ok/z?q", 15), ("http://a.com/okay", 15), ("http://x.a.com/", 13), ("http://nota.com/", 13), (None, 10), ("nonsense", 10), ("http://a.com/", None), ("http://b.com/", 10)]
    captures = spark.createDataFrame([(i, u, t, "mine") for i, (u, t) in enumerate(seen)], "id int, url string, fetched_at int, rule string")
    got = [r.decision for r in urllist.evaluate(captures, urllist.validity(entries)).orderBy("id").collect()]
    assert got == ["none", "block", "none", "block", "allow", "block", "allow", "none", "none", "none", "none", "none"]
    assert urllist.evaluate(captures, urllist.validity(entries.where("false"))).where("decision <> 'none'").count() == 0


def test_url_list_with_busy_rules(spark, monkeypatch):
    """Rules with many entries and captures, cut by time; extra columns of any name; repeated captures."""
    monkeypatch.setattr(urllist, "STRETCH", 5)
    rng = random.Random(2)
    entries = [(rng.choice(["a.com", "b.a.com", "a.com/x", "c.org"]), rng.choice(["block", "allow", "remove"]), rng.randrange(200)) for _ in range(80)]
    seen = [(rng.choice(["http://a.com/", "http://b.a.com/x", "https://a.com/x/y", "http://c.org", "http://d.net/", "bad", None]), rng.choice([None, *range(220)])) for _ in range(400)]
    df = spark.createDataFrame([(i, u, t, "r", "b", "k", "p") for i, (u, t) in enumerate(seen)], "id int, url string, fetched_at int, rules string, best string, url_key string, asked_url string")
    df = df.unionByName(df.where("id < 10"))
    rows = urllist.evaluate(df, urllist.validity(spark.createDataFrame(entries, "rule string, action string, listed_at int"))).collect()
    want = brute.decided(seen, entries)
    assert len(rows) == 410 and all((r.decision, r.rule, r.listed_at) == want[r.id] for r in rows)
    assert {(r.rules, r.best, r.url_key, r.asked_url) for r in rows} == {("r", "b", "k", "p")}
    assert urllist.evaluate(df.where("false"), urllist.validity(spark.createDataFrame(entries, "rule string, action string, listed_at int"))).count() == 0


def test_best_run():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.randint(-4, 4) for _ in range(rng.randrange(12))]
        a, b = mainpage.best_run(scores)
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0)
        assert sum(scores[a:b]) == max(0, best)


PARAGRAPHS = "".join(f"<p>Paragraph {i} holds some words of real content and goes on for quite a while.</p>" for i in range(4))
LINES = [f"Paragraph {i} holds some words of real content and goes on for quite a while." for i in range(4)]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body><form action='/x'>{PARAGRAPHS}</form></body></html>", LINES),
        (f"<html><body><div class='share'>{PARAGRAPHS}</body></html>", LINES),
        (f"<html><body><div class='related-topics-page'>{PARAGRAPHS}</div></body></html>", LINES),
        (f"<html><body><form><nav><a href='/'>Home</a></nav><div class='sidebar'><p>Some words beside it</p></div>{PARAGRAPHS}</form></body></html>", LINES),
        (f"<article><div class='hd'><div><h1>Short Title</h1></div></div>{PARAGRAPHS}</article>", ["Short Title", *LINES]),
        (f"<article>{PARAGRAPHS}<ul><li><a href='a'>Source one</a></li><li><a href='b'>Source two</a></li></ul></article>", [*LINES, "Source one", "Source two"]),
        (f"<article>{PARAGRAPHS}<div><div><em>The end.</em></div></div></article>", [*LINES, "The end."]),
        (f"<body><article>{PARAGRAPHS}</article><div>Words between them</div><article><h2>Other</h2><p>More text.</p></article></body>", [*LINES, "Other", "More text."]),
        (f"<article>{PARAGRAPHS}<div class='article-comments'><p>{'I disagree. ' * 30}</p></div></article>", LINES),
        (f"<article><p>{LINES[0]}</p><div class='content-ad'>Buy now</div>{PARAGRAPHS}<footer>Filed under x</footer></article>", [LINES[0], *LINES]),
        (f"<body>Menu words<article>{PARAGRAPHS}</article>words after it that are quite a few and not marked at all</body>", LINES),
        (f"<body><div id='w'><div><h1>The Title</h1></div>{PARAGRAPHS}<p>End.</p></div><div class='sidebar'>Side words</div><footer>c</footer></body>", ["The Title", *LINES, "End."]),
        (f"<main><h1>Title</h1><div class='content with-sidebar'>{PARAGRAPHS}</div><aside>Beside</aside></main>", ["Title", *LINES]),
        (f"<section class='comments'><article class='comment'><p>First!</p></article></section><article>{PARAGRAPHS}</article>", LINES),
        ("<article><ul><li>One<li>Two</ul><p>x<p>y &lt;z&gt; <br>end<table><tr><td>a<td>b</table></article>", ["One", "Two", "x", "y <z> end", "a b"]),
    ],
)
def test_main_text_of_page_shapes(spark, page, want):
    """With weights fitted on pages that never have a div, a list or a table in the article, and with the default ones."""
    fitted = mainpage.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert mainpage.extract(page, fitted).split("\n") == want
    assert mainpage.extract(page, mainpage.DEFAULT).split("\n") == want


def test_region_is_the_best_run():
    """The run that the region grows from has the largest sum of all, and the text holds all of its words."""
    rng = random.Random(12)
    parts = ["<div>", "</div>", "<p>", "</p>", "<a href='x'>", "</a>", "<nav>", "</nav>", "<article>", "</article>", "<div class='ad'>", "<h1>", "</h1>", "words of text ", "one ", "<br>", "<form>", "</form>", "<b>", "</b>", "<!-- c -->", "<script>x</script>"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        scored = mainpage.Scored(page, mainpage.DEFAULT)
        a, b = mainpage.best_run(scored.scores)
        assert sum(scored.scores[a:b]) == pytest.approx(max([sum(scored.scores[i:j]) for i in range(len(scored.scores)) for j in range(i, len(scored.scores) + 1)], default=0))
        begin, end = scored.region()
        assert begin <= a and b <= end
        run = [w for t in range(a, b) if scored.page.texts[t] and scored.counted[t] and not scored.dropped[t] for w in scored.page.texts[t].split()]
        assert len(scored.text().split()) >= len(run)


def test_main_text_long_and_deep():
    """Long pages, deep nesting and unclosed tags take linear time."""
    deep = "<div>" * 50_000 + PARAGRAPHS + "</div>" * 50_000
    assert mainpage.extract(deep, mainpage.DEFAULT).split("\n") == LINES
    unclosed = "<span class='ad'>x" * 50_000
    mainpage.extract(unclosed, mainpage.DEFAULT)
    assert mainpage.extract("<article>" + "<p>word</p>" * 100_000 + "</article>", mainpage.DEFAULT).count("word") == 100_000


def test_main_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    scores = mainpage.fit(pages)
    html = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First   words of a <b>long</b> paragraph\nwith many words in it.</p><p>Second &#8212; one with quite a lot of words as well.</p></article><script>var x = 1;</script><footer><p>All rights reserved</p></footer></body></html>"
    some = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x")], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in mainpage.main_text(some, scores).collect()}
    assert got[1] == "Title & more\nFirst words of a long paragraph with many words in it.\nSecond — one with quite a lot of words as well."
    assert got[2] == got[3] == ""
    digest = lambda rows: hashlib.sha256("".join(sorted(r.text for r in rows)).encode()).hexdigest()
    assert digest(mainpage.main_text(pages, scores).collect()) == digest(mainpage.main_text(pages.repartition(3), scores).collect())


def test_store_of_texts_in_one_pass(spark, tmp_path):
    """Texts encoded on the way to the store give the store of their ids, by one Python worker a task."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "".join(f" word{i * j} \n" for j in range(i * 40)) if i % 5 else None) for i in range(40)], "doc_id long, text string")
    idstore.write_store(idstore.tokenize(docs, path), f"{tmp_path}/a")
    idstore.write_texts(docs, path, f"{tmp_path}/b")
    a, b = (sorted(map(tuple, idstore.read_store(spark, f"{tmp_path}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 40
    assert idstore.damaged(spark, f"{tmp_path}/b").isEmpty()


def test_forgotten_units_are_not_held(monkeypatch):
    monkeypatch.setattr(idstore, "REMEMBERED", 20)
    encoder = idstore._Encoder(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    for i in range(20):
        encoder.encode(pa.array([" ".join(f"unit{i}x{j}" for j in range(15))]))
        assert not getattr(encoder.units.older, "older", None) and len(encoder.units) + len(encoder.units.older) <= 20 + 60


def test_pieces_between_cuts_as_the_library():
    """Texts cut by bytes give the library's ids, wherever white space, punctuation and other scripts meet."""
    library = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    known, encoder = library.Tokenizer.from_file(path), idstore._Encoder(path)
    parts = ["a", "Word", "don't", "I'll", "'s", "x's", "é", "né", "ß", "ñ!", "日本", "語。", "5", "12a", "a12", "_", "__x", "#", "(b)", "...", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\u00a0", "\u3000", "\u0301", "🙂", "½", "ⅷ", "\x00", "\x7f", "<|endoftext|>", "-", "'", '"', "`", "~", "{", "@me"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(4000)] + ["", " ", "\n", None, *parts] + [f"{a}{b}{c}" for a in parts for b in parts for c in ("", " x")]
    want = [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    batches = [pa.record_batch({"doc_id": range(len(some)), "text": some}) for at in range(0, len(texts), 700) if (some := pa.array(texts[at : at + 700], pa.string()))]
    got = [list(np.frombuffer(x, f"<u{encoder.width}")) for b in batches for x in encoder.encode(idstore.text_column(b.slice(3), "text"))]
    assert got == [w for at in range(0, len(texts), 700) for w in want[at + 3 : at + 700]]


def test_repeated_units_are_looked_up_once(monkeypatch):
    """What a slice repeats is one lookup, and a worker keeps nothing once it meets a stage that encodes nothing."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    encoder, seen = idstore._Encoder(path), []
    monkeypatch.setattr(encoder, "piece", lambda x, f=encoder.piece: seen.append(x) or f(x))
    monkeypatch.setitem(idstore._ENCODERS, path, encoder)
    encoder.encode(pa.array(["one two, two\n three"] * 500))
    assert sorted(seen) == sorted({"one", " two", ",", "\n three"}) and len(encoder.units) == 4
    idstore._forget()
    assert not encoder.units and not encoder.units.older and idstore._encoder(path) is encoder


def test_store_bounds_batches_and_writes_recipes_once(spark, monkeypatch):
    """What an executor holds: batches of 2 MB, no second table of recipes; starts follow from the manifest."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(idstore, "FAN", 3)
    paths, before = [], spark.conf.get(bound, None)
    spark.conf.unset(bound)
    try:
        monkeypatch.setattr(idstore, "remove", lambda s, x: paths.append(x))
        got = {r.doc_id: r for r in idstore.op10_query(spark, SMALL).collect()}
        assert spark.conf.get(bound) == str(2 << 20)
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)
    assert [x.rsplit("/", 1)[1] for x in paths] == ["staged"]
    start = 0
    for i in sorted(got):
        assert got[i].start == start
        start += got[i].n_tokens


def test_top_k_sends_narrow_blocks_once(spark):
    """Whole numbers travel in as few bytes as they need, and no row has both a vector block and a query block."""
    rows = spark.createDataFrame([(i, [float(i), -1.0, x]) for i, x in enumerate([0.5, 2.0, 3e4, 1e300])], "id long, v array<double>").coalesce(1)
    for part, width in (("id < 2", 2), ("id = 2", 4), ("id = 3", 8)):
        blocks = topk._blocks(rows.where(part), 100, 1024, "blocks")
        assert [len(r.matrix) for r in blocks.collect()] == [width * 3 * len(r.ids) // 8 for r in blocks.collect()]
        met = topk._met(blocks, blocks.toDF("q_block", "dim", "q_wide", "q_ids", "q_matrix"), 10, 1024, 1)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
        assert met.count() == (2 if width == 2 else 0)
