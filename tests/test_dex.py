"""DEX tables and decoded code of files built byte by byte."""

import struct
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import dex_builder as builder  # noqa: E402

from bytelens.operators import cfg  # noqa: E402
from bytelens.sources import bytecode, dex  # noqa: E402

KIND = "dex_id long, dex_ord int, path string, content binary"


def table(spark, *contents):
    return dex.checked(spark.createDataFrame([(i, i, f"f{i}", c) for i, c in enumerate(contents)], KIND))


FULL = builder.build(
    ["V", "I", "Ljava/lang/Enum;", "Lpkg/Color;", "RED", "GREEN", "size", "go", "[I", "Ljava/util/List;", 'say "hi", é\n', "Lpkg/Note;", "LVI"],
    [0, 1, 2, 3, 8, 9, 11],
    [(12, 0, (1, 4)), (12, 5, ())],
    [(3, 3, 4), (3, 3, 5), (3, 1, 6)],
    [(3, 0, 7), (3, 1, 6)],
    [
        {
            "idx": 3, "super": 2, "flags": 0x4011, "static": [(0, 0x4019), (1, 0x4019)], "instance": [(2, 2)], "annotations": [6],
            "direct": [(0, 9, {"insns": bytes.fromhex("1a000a00 62010000 22020300 701000000200 6e2001002100 0c03 0e00".replace(" ", "")), "registers": 4, "ins": 1})], "virtual": [(1, 1, None)],
        }
    ],
)


def test_pools(spark):
    d = table(spark, FULL)
    assert [(r.string_idx, r.value) for r in dex.strings(d).orderBy("string_idx").collect()][9:11] == [(9, "Ljava/util/List;"), (10, 'say "hi", é\n')]
    assert [r.java_name for r in dex.types(d).orderBy("type_idx").collect()] == ["void", "int", "java.lang.Enum", "pkg.Color", "int[]", "java.util.List", "pkg.Note"]
    assert [tuple(r)[2:] for r in dex.fields(d).orderBy("field_idx").collect()] == [("pkg.Color", "RED", "pkg.Color"), ("pkg.Color", "GREEN", "pkg.Color"), ("pkg.Color", "size", "int")]
    assert [(r["class"], r.name, r.params, r.return_type) for r in dex.methods(d).orderBy("method_idx").collect()] == [("pkg.Color", "go", ["int", "int[]"], "void"), ("pkg.Color", "size", [], "java.util.List")]
    assert [(r.class_name, r.super_name, r.access_flags) for r in dex.classes(d).collect()] == [("pkg.Color", "java.lang.Enum", 0x4011)]
    m = dex.class_members(d).orderBy("kind", "pos").collect()
    assert [(r.kind, r.idx, r.access_flags) for r in m] == [("direct_method", 0, 9), ("instance_field", 2, 2), ("static_field", 0, 0x4019), ("static_field", 1, 0x4019), ("virtual_method", 1, 1)]
    assert [(r.class_name, r.constants) for r in dex.enums(d).collect()] == [("pkg.Color", ["RED", "GREEN"])]
    assert [r.name for r in dex.annotations(d).collect()] == ["Note"]


def test_resolved_instructions(spark):
    got = [(r.off, r.mnemonic, r.operands) for r in dex.instructions(table(spark, FULL)).orderBy("off").collect()]
    assert got == [
        (0, "const-string", 'v0, "say \\"hi\\", é\\n"'), (4, "sget-object", "v1, pkg.Color.RED"), (8, "new-instance", "v2, pkg.Color"), (12, "invoke-direct", "v2, pkg.Color.go(int, int[])"),
        (18, "invoke-virtual", "v1, v2, pkg.Color.size()"), (24, "move-result-object", "v3"), (26, "return-void", ""),
    ]


def test_unreadable_files(spark):
    d = table(spark, b"", b"not a DEX file!!" * 9, b"dex\n035\0", builder.simple(bytes.fromhex("0e00")), FULL[:150])
    assert {r.dex_id: r.error for r in dex.errors(d).collect()} == {0: "Parse: empty or truncated", 1: "InvalidMagic", 2: "Truncated"}
    assert [r.class_name for r in dex.classes(d).collect()] == ["Simple"]
    assert dex.instructions(d).count() == 1


def test_first_match_over_files(spark):
    d = table(spark, builder.simple(bytes.fromhex("0e00")), builder.simple(bytes.fromhex("12000e00")))
    assert [(r.dex_id, r["class"]) for r in dex.find_methods(d, "some.pkg.Simple", "foo").collect()] == [(0, "Simple")]
    assert dex.class_list(d, only_package="Simple").count() == 2 and dex.class_list(d, exclude=["Simple"]).count() == 0 and dex.class_list(d, exclude=["android.", "other."]).count() == 2


@pytest.mark.parametrize("name,code,kinds,loops", [
    ("return", "0e00", {"exit"}, 0), ("const return", "12000f00", {"exit"}, 0), ("if else", "38000300 2802 0e00 0e00", {"conditional", "goto", "exit"}, 0), ("loop", "1200 38000400 28fd 0000 0000 0e00", {"conditional", "goto", "fallthrough", "exit"}, 1),
])
def test_blocks_of_programs(spark, name, code, kinds, loops):
    d = table(spark, builder.simple(bytes.fromhex(code.replace(" ", ""))))
    ins = bytecode.absolute_branches(bytecode.instructions(dex.code(d)))
    b = cfg.blocks(ins)
    e = cfg.edges(b)
    assert {r.end_kind for r in b.collect()} <= kinds | {"fallthrough"} and kinds - {"fallthrough"} <= {r.end_kind for r in b.collect()}
    assert cfg.loop_headers(b, e).count() == loops


def test_every_format(spark):
    code = bytes.fromhex("".join("""
        0221 0300 | 0300 0100 0200 | 127f | 1300 ffff | 1401 78563412 | 1502 3412 | 1603 feff | 1704 ffffffff | 1805 0807060504030201 | 1906 0080 | 2a00 fdffffff | 2900 0500 | 3210 0400 | 3d01 feff
        | 9000 0102 | b021 | d021 9cff | d800 01ff | 2402 0300 1000 | 7403 0400 0500 | e300""".replace("|", "").split()))  # fmt: skip
    got = [(m, o) for _, m, o in bytecode.decode(code)]
    assert got == [
        ("move/from16", "v33, v3"), ("move/16", "v1, v2"), ("const/4", "v15, 7"), ("const/16", "v0, -1"), ("const", "v1, 305419896"), ("const/high16", "v2, 305397760"), ("const-wide/16", "v3, -2"), ("const-wide/32", "v4, -1"),
        ("const-wide", "v5, 72623859790382856"), ("const-wide/high16", f"v6, {-32768 << 48}"), ("goto/32", "-003h"), ("goto/16", "+005h"), ("if-eq", "v0, v1, +004h"), ("if-lez", "v1, -002h"),
        ("add-int", "v0, v1, v2"), ("add-int/2addr", "v1, v2"), ("add-int/lit16", "v1, v2, -100"), ("add-int/lit8", "v0, v1, -1"), ("filled-new-array", "type@3"), ("invoke-virtual/range", "v5, v6, v7, method@4"), ("unused-e3", ""),
    ]
    assert len(bytecode.OPCODES) == 218 and list(bytecode.decode(code[:5])) == [(0, "move/from16", "v33, v3")]


def test_switches(spark):
    # packed-switch v0 to a payload at 12, two cases; sparse-switch v0 to one at 26
    packed = struct.pack("<HHiii", 0x0100, 2, 10, 5, 4)
    code = bytes.fromhex("2b00060000000e0000000e00") + packed + b"\0\0" * 0
    rows = list(bytecode.decode(code))
    assert rows[-1] == (12, "packed-switch-payload", "") and bytecode.cases_of(code, 0, 12) == [(10, 10), (11, 8)]
    sparse = bytes.fromhex("2c0004000000" + "0e00") + struct.pack("<HHiiii", 0x0200, 2, -5, 70, 3, 3)
    assert bytecode.cases_of(sparse, 0, 8) == [(-5, 6), (70, 6)] and bytecode.cases_of(sparse, 0, 6) == [] and bytecode.cases_of(sparse[:20], 0, 8) == []
    d = table(spark, builder.simple(code), builder.simple(sparse))
    c = dex.code(d)
    ins = bytecode.instructions(c)
    assert sorted((r.case_value, r.target) for r in bytecode.switch_cases(c, ins).collect()) == [(-5, 6), (10, 10), (11, 8), (70, 6)]


def test_tries_and_handlers(spark):
    nops = b"\0\0" * 64
    one = builder.simple(nops, tries=[(0, 16, 0)], handlers=[([(1, 31)], None)])
    two = builder.simple(b"\0\0" * 31, tries=[(0, 10, 0)], handlers=[([(1, 20), (2, 25)], 30)])
    d = table(spark, one, two)
    got = sorted((r.start, r.end, r.pos, r.type_idx, r.handler_start, r.handler_end) for r in dex.tries(d).collect())
    assert sorted(got, key=str) == sorted([(0, 32, 0, 1, 62, 128), (0, 20, 0, 1, 40, 50), (0, 20, 1, 2, 50, 60), (0, 20, 2, None, 60, 62)], key=str)


def test_raw_listing(spark):
    d = table(spark, builder.simple(bytes.fromhex("1200 38000400 28fd 0e00".replace(" ", ""))))
    assert [r.line for r in bytecode.raw_listing(dex.code(d)).orderBy("off").collect()] == ["// [0] 0 (12 00): const/4 v0, 0", "// [1] 2 (38 00 04 00): if-eqz v0, +004h", "// [2] 6 (28 fd): goto -003h", "// [3] 8 (0e 00): return-void"]


def test_files_from_disk(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.dex").write_bytes(builder.simple(bytes.fromhex("0e00")))
    d = dex.files(spark, f"{tmp_path}/1.dex", f"{tmp_path}/0.dex")
    assert [r.path.rsplit("/", 1)[1] for r in d.orderBy("dex_ord").collect()] == ["1.dex", "0.dex"] and dex.classes(d).count() == 2
