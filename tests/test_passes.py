"""Passes block by block, names in text, types from signatures, literals, ranges, and pairing as rows arrive."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from bytelens.operators import cfg, dataflow, intervals, passes, statements as st
from bytelens.sources import payloads
from bytelens.streaming import pairing

INS = "method_uid long, off long, mnemonic string, operands string"
IR = "method_uid long, block_id long, off long, kind string, dst string, form string, target string, text string"


def ir(spark, *rows, block=0):
    return spark.createDataFrame([(1, block, 2 * i, *r) for i, r in enumerate(rows)], IR)


def texts(t):
    return [r.line for r in st.lines(t).orderBy("method_uid", "off").collect()]


def test_placed_agrees_with_blocks(spark):
    r = random.Random(1)
    rows = []
    for m in range(40):
        n = r.randint(1, 30)
        for i in range(n):
            kind = r.choice(["move", "const/4", "goto", "if-eqz", "return-void", "packed-switch", "throw"])
            ops = {"goto": f"{2 * r.randrange(n)}", "if-eqz": f"v0, {2 * r.randrange(n)}", "move": "v0, v1", "const/4": "v0, 1", "throw": "v0", "packed-switch": "v0, +008h"}.get(kind, "")
            rows.append((m, 2 * i, kind, ops, 2 * n))
    ins = spark.createDataFrame(rows, INS + ", code_end long")
    want = dataflow.membership(ins.select("method_uid", "off"), cfg.blocks(ins))
    assert sorted(map(tuple, cfg.placed(ins).select("method_uid", "off", "block_id").collect())) == sorted(map(tuple, want.collect()))


def test_a_constant_is_not_folded_over_a_place_that_is_jumped_to(spark):
    rows = [(1, 0, "if-eqz", "v9, 4"), (1, 2, "const/4", "v0, 1"), (1, 4, "if-eqz", "v0, 8"), (1, 6, "const/high16", "v1, 65536"), (1, 8, "return-void", "")]
    rows += [(2, 0, "const/high16", "v1, 65536"), (2, 2, "if-ne", "v1, v10, 0"), (2, 4, "const/4", "v1, 3"), (2, 6, "if-gt", "v10, v1, 0")]
    got = {(r.method_uid, r.off): r.cond for r in st.folded_conditions(cfg.placed(spark.createDataFrame(rows, INS))).collect()}
    assert got == {(1, 0): "v9 == 0", (1, 4): "v0 == 0", (2, 2): "65536 != v10", (2, 6): "v10 > 3"}


def test_versions_start_again_in_each_block(spark):
    rows = [("assign", "v1", "raw", None, "v1 + v10"), ("assign", "v10", "var", None, "v1"), ("expr", None, "call", "v1.go", "v10, v1"), ("assign", "v1", "raw", None, '"v1"'), ("return", None, "var", None, "v1")]
    both = ir(spark, *rows).union(ir(spark, *rows, block=1).withColumn("off", F.col("off") + 100))
    one = ["v1_1 = v1 + v10;", "v10_1 = v1_1;", "v1_1.go(v10_1, v1_1);", 'v1_2 = "v1_1";', "return v1_2;"]
    assert texts(passes.versions().run(both)) == one * 2
    assert texts(passes.versions(("method_uid",)).run(both))[5] == "v1_3 = v1_2 + v10_1;"


def test_default_pipeline(spark):
    rows = [
        ("assign", "v0", "raw", None, "new a.Foo()"), ("expr", None, "call", "v0.<init>", "v2, v3"), ("expr", None, "call", "a.B.get", "v0"), ("assign", "v4", "pending", None, ""), ("assign", "v5", "raw", None, "7"),
        ("assign", "v6", "raw", None, "v4 + 1"), ("raw", None, "raw", None, "v4[v6] = v0;"), ("return", None, "none", None, ""),
    ]
    got = passes.default_runner().run(ir(spark, *rows))
    assert texts(got) == ["v0_1 = new a.Foo(v2, v3);", "v4_1 = a.B.get(v0_1);", "v6_1 = v4_1 + 1;", "v4_1[v6_1] = v0_1;", "return;"]


def test_own_passes(spark):
    start = ir(spark, ("assign", "v0", "raw", None, "v0 + 1"), ("assign", "v1", "raw", None, "v0 - 5"))
    assert texts(passes.Runner().add(passes.SIMPLIFY).add(passes.identity()).run(start)) == ["v0++;", "v1 = v0 - 5;"]
    loud = passes.Runner().add("loud", lambda t: t.withColumn("text", F.upper("text")))
    assert [r.text for r in loud.run(start).orderBy("off").collect()] == ["V0 + 1", "V0 - 5"]
    with pytest.raises(ValueError, match="bad changes the columns"):
        passes.Runner().add("bad", lambda t: t.drop("text")).run(start)


def test_types_from_signatures(spark):
    rows = [
        ("assign", "v0_1", "call", "a.B.make", "v4"), ("assign", "v1_1", "var", None, "v0_1"), ("assign", "v2_1", "call", "v1_1.size", ""), ("assign", "v3_1", "raw", None, "v2_1 * 2"), ("assign", "v6_1", "call", "v9.size", ""),
        ("assign", "v7_1", "raw", None, "new int[v2_1]"), ("assign", "v8_1", "call", "a.B.make", "v4, v5"), ("return", None, "var", None, "v3_1"),
    ]
    m = spark.createDataFrame([(1, "a.Main", ["long", "java.lang.String"], "long", False, 9, 4)], "method_uid long, class_name string, params array<string>, return_type string, is_static boolean, registers_size int, ins_size int")
    sig = spark.createDataFrame([("a.B.make", 1, "java.util.List"), ("java.util.List.size", 0, "int")], "target string, n_args int, return_type string")
    seeds = passes.parameter_seeds(m)
    assert sorted(map(tuple, seeds.collect())) == [(1, "v5", "a.Main"), (1, "v6", "long"), (1, "v8", "java.lang.String")]
    code = ir(spark, *rows)
    assert [tuple(r) for r in passes.return_seeds(code, m).collect()] == [(1, 0, "v3_1", "long")]
    got = {r.v: r.type for r in passes.typed(code, seeds, sig).collect()}
    assert got == {"v5": "a.Main", "v6": "long", "v8": "java.lang.String", "v0_1": "java.util.List", "v1_1": "java.util.List", "v2_1": "int", "v3_1": "int", "v7_1": "int[]"}
    assert {r.v: r.type for r in passes.typed(code, passes.return_seeds(code, m), sig).collect()}["v3_1"] == "long"


def test_names(spark):
    rows = [
        ("assign", "v0_1", "raw", None, "v5.length"), ("assign", "v1_1", "raw", None, "v5[v2]"), ("assign", "v3_1", "raw", None, "v6[v4]"), ("raw", None, "raw", None, "v6[v8] = v3_1;"), ("raw", None, "raw", None, "v6[v9] = v3_1;"),
        ("assign", "v3_2", "raw", None, "1"), ("expr", None, "call", "a.B.f", "v10, v11, v12, v3_2, v1_1, v0_1"), ("return", None, "var", None, "v1_1"),
    ]
    code = ir(spark, *rows)
    types = spark.createDataFrame([(1, 0, "v3_1", "java.lang.String"), (1, 0, "v3_2", "int")], "method_uid long, block_id long, v string, type string")
    m = spark.createDataFrame([(1, 13, 3, False)], "method_uid long, registers_size int, ins_size int, is_static boolean")
    named = passes.names(code, types, m)
    got = {r.v: r.name for r in named.collect()}
    assert got == {"v5": "arr0", "v0_1": "length", "v2": "i", "v1_1": "result", "v6": "arr1", "v4": "j", "v3_1": "str0", "v8": "k", "v9": "k", "v3_2": "n0", "v10": "this", "v11": "p0", "v12": "p1"}
    assert texts(passes.renamed(code, named))[2:5] == ["str0 = arr1[j];", "arr1[k] = str0;", "arr1[k] = str0;"]
    cond = spark.createDataFrame([(1, 0, 20, "v3 == v1"), (1, 0, 22, "v12 < v33"), (1, 5, 24, "v3 != v10")], "method_uid long, block_id long, off long, cond string")
    assert [r.cond for r in passes.renamed_conditions(cond, named, m).orderBy("off").collect()] == ["n0 == result", "p1 < v33", "v3 != this"]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    r = random.Random(seed)

    def ranges(n):
        return [(r.randrange(3), i, a := r.randrange(-500, 500) * r.choice([1, 1, 50]), a + r.choice([0, 1, 2, 7, 64, 300, 5000])) for i in range(n)]

    left, right = ranges(120) + [(1, 900, None, 5), (1, 901, 9, 3)], ranges(120)
    got = intervals.overlaps(spark.createDataFrame(left, "m int, x int, a long, b long"), spark.createDataFrame(right, "m int, y int, c long, d long"), ["m"], ("a", "b"), ("c", "d"))
    want = [(m, x, a, b, y, c, d) for m, x, a, b in left for n, y, c, d in right if m == n and a is not None and a < b and c < d and a < d and c < b]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_overlaps_join_few_rows(spark):
    """A large method of short ranges: what the join makes is within three times of what comes out."""
    n = 20_000
    left = spark.range(n).select(F.lit(1).alias("m"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 12).alias("b"))
    right = spark.range(n).select(F.lit(1).alias("m"), (F.col("id") * 10 + 5).alias("c"), (F.col("id") * 10 + 17).alias("d"))
    t = intervals.overlaps(left, right, ["m"], ("a", "b"), ("c", "d"))
    out = t.count()
    assert n < out < 4 * n
    cells = lambda lo, hi: sum(1 for _ in range(lo // 16, (hi - 1) // 16 + 1))
    seats: dict[int, list[int]] = {}
    for k, (shift, _) in enumerate(((0, 0), (5, 0))):
        for i in range(n):
            lo = 10 * i + shift
            for c in range(lo // 16, (lo + 11) // 16 + 1):
                seats.setdefault(c, [0, 0])[k] += 1
    assert sum(a * b for a, b in seats.values()) <= 3 * out and cells(0, 17) == 2


def test_tries_of_blocks(spark):
    blocks = spark.createDataFrame([(1, i, 10 * i, 10 * i + 10) for i in range(6)] + [(2, 0, 0, 4)], "method_uid long, block_id long, start_off long, end_off long")
    tries = spark.createDataFrame([(1, 0, 5, 25), (1, 1, 20, 30), (1, 2, 55, 900), (1, 3, 7, 7), (2, 0, 0, 4), (3, 0, 0, 9)], "method_uid long, try_id int, start long, end long")
    got = sorted(map(tuple, intervals.tries_of_blocks(tries, blocks).collect()))
    assert got == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 2), (1, 2, 5), (2, 0, 0)]


def literal(spark, code, off=0, mnemonic="fill-array-data", operands="v1, +003h"):
    c = spark.createDataFrame([(1, bytes(code))], "method_uid long, insns binary")
    r = payloads.literals(c, spark.createDataFrame([(1, off, mnemonic, operands)], INS)).collect()[0]
    return r["values"], r.line


def test_array_data(spark):
    head = bytes.fromhex("260103000000")
    for width, form, values in ((1, "b", [-1, 127, -128]), (2, "h", [-1, 32767]), (4, "i", [-(2**31), 5]), (8, "q", [-(2**63), 2**63 - 1, -1, 2**32])):
        code = head + struct.pack("<HHI", 0x300, width, len(values)) + struct.pack(f"<{len(values)}{form}", *values)
        assert literal(spark, code) == (values, f"/* v1 = {{ {', '.join(map(str, values))} }} */")
    assert literal(spark, head + struct.pack("<HHI", 0x300, 4, 0)) == ([], "/* v1 = {  } */")
    for bad in (head, head[:3], head + struct.pack("<HHI", 0x300, 3, 1) + b"abc", head + struct.pack("<HHI", 0x300, 4, 9) + b"abc", head + b"\0" * 30):
        assert literal(spark, bad) == (None, "/* fill-array-data v1, +003h */")
    two = bytes.fromhex("260102000000") + struct.pack("<HHI", 0x300, 1, 1) + b"\5\0"  # counted from two bytes on
    assert literal(spark, two)[0] == [5]


def test_switches(spark):
    head, payload = bytes.fromhex("2b0003000000"), struct.pack("<HHiii", 0x100, 2, -3, 9, 9)
    say = lambda code: literal(spark, code, 0, "packed-switch", "v2, +003h")
    assert say(head + payload) == ([-3, -2], "switch (v2) { case -3: case -2: default: break; }")
    assert say(head + struct.pack("<HHiiii", 0x200, 2, -9, 70000, 9, 9)) == ([-9, 70000], "switch (v2) { case -9: case 70000: default: break; }")
    assert say(head + struct.pack("<HHi", 0x100, 0, 5)) == ([], "switch (v2) { default: break; }")
    assert say(head + b"\0" * 6 + payload) == ([-3, -2], "switch (v2) { case -3: case -2: default: break; }")  # found within eight bytes
    assert say(head[:4]) == (None, "switch (v2);  // (payload missing)") and say(head + b"\0" * 20) == (None, "switch (v2);  // (payload not found)")
    assert say(head + payload[:-2])[1] == "switch (v2);  // (packed payload truncated)" and say(head + struct.pack("<HHi", 0x200, 2, 9))[1] == "switch (v2);  // (sparse payload truncated)"


def test_pairing_over_restarts(spark, tmp_path):
    """Rows in no order, some twice, over two runs from one checkpoint: the answers of the batch."""
    r = random.Random(3)
    rows = []
    for m in range(30):
        at = 0
        for _ in range(r.randint(1, 25)):
            kind, size = r.choice([("invoke-virtual", 6), ("move-result", 2), ("move-result-object", 2), ("nop", 2)])
            rows.append((m, at, size, kind, "v1, v2, a.B.f()" if kind.startswith("invoke") else f"v{r.randrange(9)}" if kind.startswith("move") else ""))
            at += size
    kind = "method_uid long, off long, size int, mnemonic string, operands string"
    want = sorted(map(tuple, dataflow.api_sources(spark.createDataFrame(rows, kind)).collect()))
    late = rows + r.sample(rows, 20)
    r.shuffle(late)
    pairing.use_store(spark)
    (tmp_path / "in").mkdir()
    for k in range(2):
        for i in range(2):
            spark.createDataFrame(late[2 * k + i :: 4], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pairing.paired(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == want and len(want) > 20
