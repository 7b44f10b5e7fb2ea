"""Hard negatives against brute force: ties, repeats, nulls, large components, vectors of other lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelens.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>, anchor string, v int, score string"


def brute(rows, positives=5, negatives=3, step=50):
    """rows: (vec_id, label, embedding) in the order that settles what ids leave open."""
    ok = [(i, v, y, [math.floor(256 * t) for t in x]) for i, (v, y, x) in enumerate(rows) if y is not None and x is not None and all(t is not None and math.isfinite(t) for t in x)]
    first = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, v, y, x in ok:
        if v is None or v % step:
            continue
        scored = [(sum(p * q for p, q in zip(x, z)), w, j, u) for j, w, u, z in ok if j != i]
        for ps, pid, *_ in sorted((s for s in scored if s[3] == y), key=first)[:positives]:
            far = sorted((s for s in scored if s[3] != y and 50 * ps <= 100 * s[0] <= 95 * ps), key=first)[:negatives]
            out += [(v, pid, k + 1, s[1], ps, s[0]) for k, s in enumerate(far)]
    return sorted(out, key=str)


def rows_of(r, n, dims=9, labels=3):
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        y = r.randrange(labels)
        out.append((i, y, [0.6 * c + r.gauss(0, 0.7) for c in centre[r.choice([y, r.randrange(labels)])]]))
    return out


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], KIND)
    return sorted(map(tuple, hn.mine(table, F.col("vec_id") % 50 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("wave", [2, 4096])
def test_mine(spark, wave):
    r = random.Random(1)
    rows = rows_of(r, 300)
    same = rows[7][2]
    rows += [(1000 + i, i % 3, same) for i in range(40)]  # ties in every label
    rows += [(2000, None, same), (2001, 1, None), (2002, 1, [math.nan] * 9), (2003, 1, [math.inf, *same[1:]]), (2004, 1, [None, *same[1:]]), (2050, 1, [])]
    rows += [(2100, 0, same[:4]), (2101, 1, [*same, 5.0]), (-50, 2, same)]
    got = mined(spark, rows, wave=wave)
    assert got == brute(rows)
    assert len(got) > 50


def test_repeats(spark):
    """Rows of one vec_id and null vec_ids are rows of their own; scores and ids decide, so equal rows give equal output."""
    r = random.Random(2)
    rows = rows_of(r, 120)
    rows += [rows[50], rows[50], (None, 1, rows[3][2]), (None, 2, rows[3][2])]
    assert mined(spark, rows) == brute(rows)


def test_large(spark):
    rows = [(50 * i, i % 2, [x * 3.0 for x in v]) for i, v in enumerate([[1e15, 2.0], [1e15, 1.0], [9e14, 4.0], [6e14, -1e14], [1.0, 1.0], [5e9, 1.0]])]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert mined(spark, rows) == sorted(((a, p, k, n, clip(x), clip(y)) for a, p, k, n, x, y in brute(rows)), key=str)


def test_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []


def test_survivors():
    """Every pair within its bounds, and no other, whatever the kind of number."""
    r = np.random.default_rng(3)
    for high in (4, 1 << 9, 1 << 20, 1 << 28):
        x, a = r.integers(-high, high, (200, 17)), r.integers(-high, high, (13, 17))
        s = x @ a.T
        low, most = np.quantile(s, 0.9, axis=0).astype(np.int64), np.quantile(s, 0.97, axis=0).astype(np.int64)
        i, j, score = hn.survivors(x, a, low, most)
        want = {(p, q): s[p, q] for p, q in zip(*np.nonzero((s >= low) & (s <= most)))}
        assert {(p, q): v for p, q, v in zip(i.tolist(), j.tolist(), score.tolist())} == want
    for x in ([[0, 5, -5]], [[-1, -1, -1]], [[-8, 7, 0]]):
        bits, weights = hn.planes(np.array(x))
        assert (sum(b * w for b, w in zip(bits, weights)) == np.array(x)).all()
