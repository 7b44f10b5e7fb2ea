"""Fixpoints inside tasks against plain Python on random graphs, over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from bytelens.operators import bymethod, cfg, dataflow


@pytest.fixture(scope="module")
def graphs():
    r = random.Random(5)
    out = {}
    for m in range(25):
        n = r.randint(1, 12)
        out[m] = (n, sorted({(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 2 * n))}))
    return out


@pytest.fixture(scope="module")
def edges(spark, graphs):
    return spark.createDataFrame([(m, a, b, "goto") for m, (_, e) in graphs.items() for a, b in e], "method_uid long, from_id long, to_id long, edge_kind string")


def reach(e, start, closed=None, enter=True):
    seen, stack = {start}, [start]
    while stack:
        n = stack.pop()
        if n == closed:
            continue
        for a, b in e:
            if a == n and b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


@pytest.mark.parametrize("rows", [1, 1000])
def test_batches(spark, edges, rows):
    """Methods that span batches are whole, whatever the size of a batch."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        t = bymethod.tagged(edges.select("method_uid", "from_id", "to_id"))
        got = bymethod.by_method(t, lambda x: [[len(x["a"])], [x["b"].sum()]], ["n", "total"])
        want = edges.groupBy("method_uid").agg(F.count("*").alias("n"), F.sum("to_id").alias("total"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_reachable_and_pairs(spark, graphs, edges):
    starts = spark.createDataFrame([(m, 0) for m in graphs], "method_uid long, block_id long")
    assert sorted(map(tuple, cfg.reachable(edges, starts).collect())) == sorted((m, b) for m, (_, e) in graphs.items() for b in reach(e, 0))
    r = random.Random(6)
    ask = list({(m, r.randrange(n), r.randrange(n), r.choice([None, r.randrange(n)])) for m, (n, _) in graphs.items() for _ in range(12)})
    got = cfg.reaches(edges, spark.createDataFrame(ask, "method_uid long, start long, target long, exclude long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((m, s, t, x, t in reach(graphs[m][1], s, x)) for m, s, t, x in ask), key=str)
    assert {r.found for r in got} == {True, False}


def test_dominators(spark, graphs, edges):
    blocks = spark.createDataFrame([(m, b) for m, (n, _) in graphs.items() for b in range(n)], "method_uid long, block_id long")
    got = {(r.method_uid, r.block_id): (r.rpo, r.idom) for r in cfg.graph_facts(edges, blocks).collect()}
    for m, (n, e) in graphs.items():
        inside = reach(e, 0)
        assert {b for k, b in got if k == m} == inside and sorted(got[m, b][0] for b in inside) == list(range(1, len(inside) + 1))
        strict = {b: {d for d in inside if d != b and b not in reach([x for x in e if d not in x], 0)} | ({0} if b else set()) for b in inside}
        for b in inside:
            want = max(strict[b], key=lambda d: len(strict[d])) if strict[b] else None
            assert got[m, b][1] == want


def test_reaching_definitions(spark, graphs, edges):
    r = random.Random(7)
    blocks, rw = [], []
    for m, (n, _) in graphs.items():
        blocks += [(m, b, 10 * b, 10 * b + 10) for b in range(n)]
        rw += [(m, 2 * i, reg, w, 0) for i in range(5 * n) for reg in range(3) for w in (True, False) if r.random() < 0.3]
    got = dataflow.reaching_use_def(spark.createDataFrame(rw, "method_uid long, off long, reg long, is_write boolean, pos long"), spark.createDataFrame(blocks, "method_uid long, block_id long, start_off long, end_off long"), edges)
    want = set()
    for m, (n, e) in graphs.items():
        writes = {(o, g) for k, o, g, w, _ in rw if k == m and w}
        for k, o, g, w, _ in rw:
            if k != m or w:
                continue
            own = [x for x, h in writes if h == g and x // 10 == o // 10 and x < o]
            if own:
                want.add((m, o, g, max(own)))
                continue
            seen, stack = set(), [a for a, b in e if b == o // 10]
            while stack:
                b = stack.pop()
                if b in seen:
                    continue
                seen.add(b)
                last = [x for x, h in writes if h == g and x // 10 == b]
                if last:
                    want.add((m, o, g, max(last)))
                else:
                    stack += [a for a, c in e if c == b]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_tables_dealt_before(spark):
    """A method is whole also where the tables that are united are dealt by method already, in partitions of different sizes."""
    options = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        own = F.col("id") % 500
        many = spark.range(40_000).groupBy(own.alias("method_uid")).agg(F.sort_array(F.collect_list("id")).alias("x")).select("method_uid", F.explode("x").alias("x"))
        few = spark.range(500).groupBy(own.alias("method_uid")).agg(F.count("*").alias("n"))
        got = bymethod.by_method(bymethod.tagged(many, few), lambda x: [[len(x["part"])]], ["n"]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.method_uid, r.n) for r in got) == [(m, 81) for m in range(500)]
