"""Blocks, edges and graphs of small methods."""

from bytelens.operators import cfg
from bytelens.plans import flow_queries

KIND = "method_uid long, off long, mnemonic string, operands string, code_end long"


def test_method_without_edges_has_its_entry(spark):
    ins = spark.createDataFrame(
        [(1, 0, "const/4", "v0, 1", 4), (1, 2, "return-void", "", 4), (2, 0, "if-eqz", "v0, 4", 6), (2, 2, "const/4", "v0, 1", 6), (2, 4, "return-void", "", 6), (3, 0, "return-void", "", 2)], KIND
    )
    b = cfg.blocks(ins)
    got = {(r.method_uid, r.block_id): (r.rpo, r.idom) for r in cfg.graph_facts(cfg.edges(b), b).collect()}
    assert got == {(1, 0): (1, None), (2, 0): (1, None), (2, 1): (2, 0), (2, 2): (3, 0), (3, 0): (1, None)}


def test_switch_has_cases_and_default(spark):
    code = [(0, "const/4", "v0, 1"), (2, "packed-switch", "v0, 40"), (8, "goto", "16"), (10, "const/4", "v1, 2"), (12, "return-void", ""), (14, "const/4", "v1, 3"), (16, "return-void", "")]
    ins = spark.createDataFrame([(m, *x, 18) for m in (1, 2) for x in code], KIND)
    # two cases of one target, one into the middle of an instruction's block (15 lies in that of 14), one outside the code
    cases = spark.createDataFrame([(1, 2, -1, 14), (1, 2, 0, 10), (1, 2, 1, 10), (1, 2, 2, 15), (1, 2, 3, 90)], "method_uid long, off long, case_value int, target long")
    b = cfg.blocks(ins, cases)
    assert sorted((r.block_id, r.start_off, r.end_off, r.end_kind) for r in b.where("method_uid = 1").collect()) == [
        (0, 0, 8, "switch"), (1, 8, 10, "goto"), (2, 10, 14, "exit"), (3, 14, 16, "fallthrough"), (4, 16, 18, "exit")
    ]
    e = cfg.edges(b, cases)
    got = sorted((r.from_id, r.to_id, r.edge_kind, r.case_value) for r in e.where("method_uid = 1").collect())
    want = [(0, 1, "default", None), (0, 2, "case", 0), (0, 2, "case", 1), (0, 3, "case", -1), (0, 3, "case", 2), (1, 4, "goto", None), (3, 4, "fall", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    facts = {r.block_id: (r.rpo, r.idom) for r in cfg.graph_facts(e, b).where("method_uid = 1").collect()}
    # depth first in the payload's order: 3 (case -1), 4, 2 (case 0), 1 (default)
    assert facts == {0: (1, None), 1: (2, 0), 2: (3, 0), 3: (4, 0), 4: (5, 0)}
    assert {(r.from_id, r.to_id, r.edge_kind) for r in cfg.edges(cfg.blocks(ins)).where("method_uid = 2").collect()} == {(0, 1, "default"), (1, 4, "goto"), (3, 4, "fall")}


def test_dominators_of_methods_with_edges(spark, tmp_path):
    """The query's SQL begins at edges: a method without any has no row, whether it is one block or ends in the middle."""
    rows = [(1, "view", 3), (1, "click", 4), (2, "view", 4), (2, "error", 1), (2, "view", 4), (3, "view", 4), (3, "error", 4), (3, "view", 4)]
    events = spark.createDataFrame([(i, m, t, f'{{"k": {k}}}') for i, (m, t, k) in enumerate(rows)], "event_id long, user_id long, event_type string, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.method_uid, r.block_id, r.idom) for r in flow_queries.immediate_dominators(spark, str(tmp_path)).collect()}
    assert got == {(3, 0, None), (3, 1, 0)}
