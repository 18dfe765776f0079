"""Circulant MinHash against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import minhash, parity
from marlstone.llm.batches import mixed
from tests.llm import brute
from tests.llm.test_pairs import corpus, frame


def test_signatures():
    """Each coordinate is the least rank of the places after a shift, the ranks being one permutation."""
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    ends = np.array([0, 3, 3, 2600, 5000])
    order = np.random.default_rng(20240611).permutation(minhash.PLACES)
    assert len(np.unique(order)) == minhash.PLACES
    got = minhash.signatures(flat, ends, 366)
    places = (mixed(flat ^ np.uint64(0xC3A5C85C97CB3127)) % np.uint64(minhash.PLACES)).astype(np.int64)
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        for k in (0, 1, 200, 365):
            want = order[(places[a:b] + k) % minhash.PLACES].min() if b > a else np.iinfo(np.uint32).max
            # Beyond the last place the ranks of the first ones follow: the shift is circular.
            assert got[i, k] == want


def test_layout():
    for percent in (50, 70, 80, 85, 90, 99, 100):
        bands, size = minhash.layout(percent)
        assert bands * size <= minhash.COORDINATES and (1 - (percent / 100) ** size) ** bands <= minhash.MISSED * 1.0001
    assert minhash.layout(80) == (61, 6)


def test_agreement_estimates_similarity():
    """Pairs at the similarity agree in about that share of coordinates, and in a band at least."""
    rng = np.random.default_rng(2)
    method, share = minhash.Circulant(80), []
    for n in (5, 10, 45, 90, 900, 9000):
        for _ in range(40):
            own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            common, rest = own[: len(own) * 8 // 9], own[len(own) * 8 // 9 :]
            other = np.sort(np.concatenate([common, rng.integers(0, 1 << 63, len(rest), dtype=np.uint64)]))
            flat, ends = np.concatenate([own, other]), np.array([len(own), len(own) + len(other)])
            similar = len(common) / (len(own) + len(other) - len(common))
            a, b = minhash.signatures(flat, ends, method.size)
            share.append((a == b).mean() - similar)
            if similar >= 0.8:
                keys, counts = method.keys(flat, ends, np.zeros(0, np.uint64))
                assert counts.tolist() == [61, 61] and np.intersect1d(keys[:61], keys[61:]).size
                assert method.pairs([len(own)], [len(other)], *([x] for x in method.sketches(flat, ends))) == [True]
    assert abs(np.mean(share)) < 0.01 and np.std(share) < 0.035


@pytest.mark.parametrize("shingle, percent", [(2, 80), (5, 80), (3, 50)])
def test_near_copies(spark, shingle, percent):
    docs = corpus(30 + shingle, 90)
    got = minhash.near_copies(frame(spark, docs), shingle, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(docs, shingle, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_hubs(spark, monkeypatch):
    """Near copies of near copies, of which most are not linked with the first; groups compared in cells."""
    monkeypatch.setattr(parity, "SMALL", 3)
    monkeypatch.setattr(parity, "CHUNK", 8)
    rng = random.Random(7)
    docs, text = {}, [f"v{rng.randrange(5000)}" for _ in range(150)]
    for i in range(120):
        text = list(text)
        for _ in range(rng.choice([1, 2, 4, 8])):
            text[rng.randrange(len(text))] = f"z{rng.randrange(5000)}"
        docs[(i * 37) % 120] = " ".join(text)
    docs |= {200 + i: "an exact copy that is in a third of all rows" for i in range(60)}
    rows = minhash.near_copies(frame(spark, docs), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(docs, 2, 80)


def test_defined_results(spark):
    none = frame(spark, {0: "a"}).where("false")
    assert minhash.near_copies(none).count() == 0
    rows = frame(spark, {1: "a b c d e f g", 2: "a b c d e f g", 3: None, 4: " ", 5: "one", 6: "ONE"}).withColumnRenamed("extra", "component_id")
    rows = rows.unionByName(rows).unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_copies(rows, 2).collect()}
    assert got == {1: (6, 1, True), 2: (6, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False)}
