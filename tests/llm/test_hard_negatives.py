import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.llm import hard_negatives
from daftar.llm.hard_negatives import Best, best_matter, mine, vertical, windows_matter

SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, k=5, percent=80):
    """Every anchor against every row, in Python integers."""
    whole = lambda x: int(x) * 256 if abs(x) > 1e300 else math.floor(x * 256)
    fit = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, label, [whole(x) for x in v]) for i, label, v in rows if i is not None and label is not None and fit(v)]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for a, la, va in {r[0]: r for r in sorted(rows, reverse=True) if r[0] % 10 == 0}.values():
        scores = [(-clip(sum(p * q for p, q in zip(va, v))), i, label) for i, label, v in rows if i != a and len(v) == len(va)]
        best = sorted((s, i) for s, i, label in scores if label == la)[:k]
        for s, p in best:
            some = sorted((n, i) for n, i, label in scores if label != la and percent * -s <= 100 * -n <= 100 * -s)[:k]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(some, 1)]
    return sorted(out)


def answer(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", rank int").repartition(4)
    return sorted(tuple(r) for r in mine(df, F.col("label"), F.col("vec_id") % 10 == 0).collect())


def some_rows(rng, n, dim, spread=1.0, labels=4):
    return [(i, rng.randrange(labels), [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 24])
def test_against_all_pairs(spark, monkeypatch, dim):
    """Blocks of few rows, so anchors meet many; coarse components give many ties."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "PER_SHARE", 2)
    rng = random.Random(dim)
    rows = some_rows(rng, 300, dim, 0.02 if dim == 3 else 1.0)
    want = plain(rows)
    assert answer(spark, rows) == want and want


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = some_rows(rng, 120, 6) + [(130, 1, None), (140, 1, []), (150, None, [1.0] * 6), (None, 1, [1.0] * 6), (160, 1, [1.0, None] * 3), (170, 1, [float("nan")] * 6),
                                     (180, 2, [float("inf")] + [0.0] * 5), (190, 0, [0.0] * 6), (200, 1, [1.0] * 4), (201, 1, [1.0] * 4), (202, 2, [1.0] * 4), (210, 9, [1.0] * 6)]
    rows += [(30, 0, [0.1] * 6), (30, 3, [0.2] * 6), (33, 1, [0.3] * 6), (33, 1, [0.3] * 6), (34, 2, [0.3] * 6), (33, 1, [0.3] * 6)]
    want = plain(rows)
    got = answer(spark, rows)
    assert got == want and any(r[0] == 200 for r in got) and not any(r[0] in (130, 140, 150, 160, 170, 180, 210) for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty, F.col("label"), F.col("vec_id") % 10 == 0).collect() == []


def test_large_components_are_exact_or_held_at_the_ends_of_a_long(spark):
    rng = random.Random(4)
    for scale in (1e5, 1e7, 1e12, 1e306):
        rows = some_rows(rng, 60, 5, scale) + some_rows(rng, 20, 5)
        rows = [(i, label, v) for i, (_, label, v) in enumerate(rows)]
        assert answer(spark, rows) == plain(rows)


def test_bounds_shrink_the_bitmap_and_lose_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    x[::100] += np.floor(256 * x[0] / 600)
    columns, read = np.ascontiguousarray(x.T), 0
    least, most = columns.min(axis=1), columns.max(axis=1)
    for nth in range(20):
        q, everyone = x[nth * 100], np.arange(len(x))
        scores = (x @ q).astype(np.int64)
        found = Best(5)
        left, exact, n = vertical(q, columns, least, most, everyone, best_matter(found))
        read += n
        assert (exact == scores[left]).all()
        found.add(left, exact)
        order = np.lexsort((everyone, -scores))[:5]
        assert (found.ids == order).all()
        window = (int(scores[order[2]] * 0.5), int(scores[order[2]]), Best(5))
        left, exact, n = vertical(q, columns, least, most, everyone, windows_matter([window]))
        inside = (exact >= window[0]) & (exact <= window[1])
        window[2].add(left[inside], exact[inside])
        good = np.flatnonzero((scores >= window[0]) & (scores <= window[1]))
        assert (window[2].ids == good[np.lexsort((good, -scores[good]))[:5]]).all()
    assert read < 0.8 * 20 * x.size
