"""Draws of the splitting tree: their law, and the tree's exact quotas."""

import math

import pytest

from bytelens.llm import mixing


@pytest.mark.parametrize("pop,good,n", [(20, 7, 10), (500, 30, 250), (4000, 3900, 2000), (9, 9, 4), (6, 1, 3), (10**12, 4 * 10**11, 5 * 10**11)])
def test_draws_follow_the_law(spark, pop, good, n):
    uniform = "((shiftrightunsigned(xxhash64(5L, id, @I), 11) + 0.5D) / 9007199254740992D)"
    rows = spark.range(6000).selectExpr("id", f"{pop}L AS pop", f"{good}L AS good", f"{n}L AS n").selectExpr(f"{mixing._draw('pop', 'good', 'n', uniform)} AS k")
    got = [r.k for r in rows.collect()]
    assert min(got) >= max(0, n + good - pop) and max(got) <= min(n, good)
    mean = n * good / pop
    var = n * good / pop * (pop - good) / pop * (pop - n) / max(1, pop - 1)
    assert abs(sum(got) / len(got) - mean) <= 5 * math.sqrt(var / len(got)) + 1e-9
    if pop < 1000:
        log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        for k in range(max(0, n + good - pop), min(n, good) + 1):
            p = math.exp(log(good, k) + log(pop - good, n - k) - log(pop, n))
            assert abs(got.count(k) / len(got) - p) <= 5 * math.sqrt(p * (1 - p) / len(got)) + 1e-3


def test_tree_keeps_quotas(spark):
    quotas = {0: 1000, 1: 7, 2: 0, 3: 123_456_789_012}
    leaves = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "rank long, blocks long"), 64, 3).collect()
    for rank, blocks in quotas.items():
        parts = sorted((r.first, r.quota) for r in leaves if r.rank == rank)
        assert len(parts) == 64 and sum(q for _, q in parts) == blocks
        at = 0
        for first, q in parts:
            assert first == at and q >= 0
            at += q
    sizes = [sum(r.quota for r in leaves if r.shard == k) for k in range(64)]
    assert max(sizes) - min(sizes) <= 6
