"""Value-flow cases with read/write rows set by hand: offset, reads, writes."""

import pytest

from bytelens.operators import dataflow as d, detectors, ir

CASES = {
    "copy and return": ([(0, [], [0]), (2, [0], [1]), (4, [1], [])], (0, 0), {(0, 0), (2, 1)}, {(2, 0), (4, 1)}),
    "transitive": ([(0, [], [0]), (2, [0], [1]), (4, [1], [2]), (6, [2], [])], (0, 0), {(0, 0), (2, 1), (4, 2)}, {(2, 0), (4, 1), (6, 2)}),
    "two uses": ([(0, [], [0]), (2, [0], [1]), (4, [1], []), (6, [0], [2]), (8, [2], [])], (0, 0), {(0, 0), (2, 1), (6, 2)}, {(2, 0), (4, 1), (6, 0), (8, 2)}),
    "result of a call": ([(0, [0], []), (2, [], [0]), (4, [0], [1]), (6, [1], [])], (2, 0), {(2, 0), (4, 1)}, {(4, 0), (6, 1)}),
}


def table(spark, rows):
    out = [(1, off, r, w, i) for off, reads, writes in rows for w, regs in ((False, reads), (True, writes)) for i, r in enumerate(regs)]
    return spark.createDataFrame(out, "method_uid long, off long, reg long, is_write boolean, pos long")


@pytest.mark.parametrize("name", CASES)
def test_flow(spark, name):
    rows, seed, writes, reads = CASES[name]
    rw = table(spark, rows)
    ud = d.linear_use_def(rw)
    t = d.closure(spark.createDataFrame([(1, *seed)], "method_uid long, off long, reg long"), d.flow_edges(rw, ud))
    assert {(r.off, r.reg) for r in t.collect()} == writes
    assert {(r.off, r.reg) for r in d.tainted_reads(t, ud).collect()} == reads


@pytest.mark.parametrize("mnemonic,operands,reads,writes", [("move", "v1, v0", [0], [1]), ("return", "v0", [0], []), ("const/4", "v0, 0", [], [0]), ("add-int/2addr", "v0, v1", [], []), ("invoke-virtual", "v1, v2, a.B.c(I)V", [1, 2], []), ("aput", "v0, v1, v2", [0, 1, 2], []), ("iget-object", "v0, v1, a.B.f", [1], [0])])
def test_read_write(spark, mnemonic, operands, reads, writes):
    ins = spark.createDataFrame([(1, 0, mnemonic, operands)], "method_uid long, off long, mnemonic string, operands string")
    got = d.rw_sets(ins).orderBy("pos").collect()
    assert [r.reg for r in got if not r.is_write] == reads and [r.reg for r in got if r.is_write] == writes


def test_loop_definitions_reach_over_back_edges(spark):
    rw = table(spark, [(0, [], [0]), (2, [0], []), (4, [], [0])])
    blocks = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 6)], "method_uid long, block_id long, start_off long, end_off long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 1)], "method_uid long, from_id long, to_id long")
    assert {(r.use_off, r.def_off) for r in d.reaching_use_def(rw, blocks, edges).collect()} == {(2, 0), (2, 4)}


@pytest.mark.parametrize("setter,sink,empty,danger", [(False, "android.app.Notification.Builder.setContentIntent", True, True), (True, "android.app.Notification.Builder.setContentIntent", False, True), (False, "android.app.AlarmManager.set", True, False)])
def test_pending_intents(spark, setter, sink, empty, danger):
    rows = [(4, [0, 1, 2, 3], []), (6, [], [4]), (8, [4], [])]
    inv, src = [(1, 4, "android.app.PendingIntent.getActivity"), (1, 8, sink)], [(1, 6, 4, "android.app.PendingIntent.getActivity")]
    if setter:
        rows += [(0, [0, 1], []), (2, [], [2])]
        inv.append((1, 0, "android.content.Intent.setAction"))
        src.append((1, 2, 2, "android.content.Intent.setAction"))
    rw = table(spark, rows)
    got = detectors.risk_label(detectors.pending_intents(rw, d.linear_use_def(rw), spark.createDataFrame(src, "method_uid long, off long, reg long, method_ref string"), spark.createDataFrame(inv, "method_uid long, off long, method_ref string"))).collect()
    assert [(r.invoke_off, r.base_intent_empty, r.dangerous_destination) for r in got] == [(4, empty, danger)]
    assert got[0].risk == ("RISK" if empty and danger else "review")


def test_versions(spark):
    rw = table(spark, [(0, [], [0]), (2, [0], [0]), (4, [0], [])])
    got = {(r.off, r.is_write): r.ver for r in ir.ssa_versions(rw).collect()}
    assert got == {(0, True): 1, (2, False): 1, (2, True): 2, (4, False): 2}
