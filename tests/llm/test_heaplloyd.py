"""Product codes by heaps against plain Lloyd."""

import hashlib
import math
import random

import numpy as np
import pytest

from marlstone.llm import heaplloyd


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, label, code, error) of every kept row, and the final codebooks: every part against every entry, every round."""
    kept = [(i, x, [n * scale // d for n, d in (float(v).as_integer_ratio() for v in e)]) for i, e, x in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    if not kept:
        return [], []
    width = max(1, -(-max(len(e) for _, _, e in kept) // parts))
    cut = [[(e + [0] * (parts * width - len(e)))[p * width : (p + 1) * width] for p in range(parts)] for _, _, e in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, cut[r]))
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda c: (far(v[p], books[p][c]), c)) for p in range(parts)] for v in cut]
        for p in range(parts if step < rounds else 0):
            for c in range(len(books[p])):
                own = [v[p] for v, k in zip(cut, codes) if k[p] == c]
                if own:
                    books[p][c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, x, "".join(f"{c:02x}" for c in k), min(sum(far(v[p], books[p][k[p]]) for p in range(parts)), (1 << 63) - 1)) for (i, x, _), v, k in zip(kept, cut, codes)]
    return out, books


def flat(rows):
    return sorted((i is None, i or 0, x is None, x or 0, c, e) for i, x, c, e in rows)


def check(spark, rows, **settings):
    df = spark.createDataFrame([(x, e, i, "x") for i, e, x in rows], "label int, embedding array<double>, vec_id long, block string").repartition(3)
    coded = heaplloyd.heap_lloyd(df, **settings)
    want, books = plain(rows, **settings)
    assert flat((r.vec_id, r.label, r.code, r.error) for r in coded.rows.collect()) == flat(want)
    numbers = ",".join(str(v) for book in books for entry in book for v in entry)
    assert coded.digest() == hashlib.sha256(numbers.encode()).hexdigest()
    sums = {}
    for _, x, _, e in want:
        sums[x] = sums.get(x, 0) + e
    for r in heaplloyd.with_label_error(coded.rows).collect():
        assert r.label_error == min(sums[r.label], (1 << 63) - 1)
    return coded


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * spread
    return [(int(i), (centres[rng.integers(30)] + rng.normal(size=dim) * 0.2).tolist(), int(rng.integers(4)) if rng.random() < 0.8 else None) for i in rng.permutation(n)]


def test_against_plain(spark):
    rows = vectors(400, 24, 1)
    rows += [(1000, None, 1), (1001, [1.0, None] * 12, 1), (1002, [math.nan] * 24, None), (1003, [math.inf] * 24, 1), (None, [0.5] * 24, None), (7, [0.25] * 24, 9), (7, [0.25] * 24, 9)]
    coded = check(spark, rows)
    assert len(coded.compared) == 7 and coded.compared[0] == 403 * 8


def test_saves_comparisons(spark):
    """Parts of clear groups are not compared again once entries hardly move."""
    coded = check(spark, vectors(1500, 16, 2, 20.0), rounds=5)
    assert sum(coded.compared) < 0.6 * len(coded.compared) * coded.compared[0]


def test_ties_and_equal_entries(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(2)) for _ in range(16)], 1) for i in range(200)] + [(i, [1.0] * 16, 2) for i in range(200, 320)]
    check(spark, rows)


def test_lengths_and_few_rows(spark):
    check(spark, [(3, [1.0, 2.0, 3.0], None), (1, [], 1), (2, [0.5] * 9, 1)])
    check(spark, [(3, [1.0] * 8, None)], rounds=2)


def test_large_components(spark):
    """Beyond what doubles hold exactly, and beyond 64 bits."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, -3.7, 2e5, 1e12, -1e300, 1e-300]) for _ in range(8)], i % 3) for i in range(60)]
    check(spark, rows, rounds=3)
    check(spark, [(i, [rng.uniform(-5e4, 5e4) for _ in range(8)], i % 3) for i in range(60)], rounds=3)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(heaplloyd, "BLOCK", 7)
    check(spark, vectors(120, 8, 6), parts=4, entries=5)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("marlstone_")]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)]])
def test_nothing_kept(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    coded = heaplloyd.heap_lloyd(df)
    assert coded.rows.count() == 0 and heaplloyd.with_label_error(coded.rows).count() == 0
