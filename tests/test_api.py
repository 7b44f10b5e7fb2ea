"""The object over DEX files, from bytes to answers."""

import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import dex_builder as builder  # noqa: E402

from bytelens.__main__ import answer, main, parser  # noqa: E402
from bytelens.api import Program  # noqa: E402
from bytelens.sources import dex  # noqa: E402

# class A: go()V takes a text from an intent into v1 and queries with it; sum(II)I adds its parameters
DEX = builder.build(
    ["V", "LA;", "Ljava/lang/Object;", "Landroid/content/Intent;", "Landroid/database/SQLiteDatabase;", "go", "sum", "getStringExtra", "rawQuery", "I", "III"],
    [0, 1, 2, 3, 4, 9],
    [(0, 0, ()), (10, 5, (5, 5))],
    [],
    [(1, 0, 5), (1, 1, 6), (3, 0, 7), (4, 0, 8)],
    [{"idx": 1, "super": 2, "direct": [(0, 9, {"insns": bytes.fromhex("6e1002000000 0c01 6e2003001200 0e00".replace(" ", "")), "registers": 4}), (1, 9, {"insns": bytes.fromhex("90000102 0f00".replace(" ", "")), "registers": 3, "ins": 2})]}],
)


def program(spark):
    return Program(dex.checked(spark.createDataFrame([(1, 0, "a", DEX)], "dex_id long, dex_ord int, path string, content binary")))


def test_findings_and_statements(spark):
    p = program(spark)
    found = answer(p, parser().parse_args(["-i", "a", "--scan-vulns"])).collect()
    assert [(r.category, r.class_name, r.method_name, r.source_off, r.sink_off) for r in found] == [("sql_injection", "A", "go", 6, 8)]
    assert p.findings(only_package="other").count() == 0
    lines = [r.line for r in p.statements().join(p.code.where("method_name = 'go'"), "method_uid", "left_semi").orderBy("off").collect()]
    assert lines == ["v1 = android.content.Intent.getStringExtra(v0);", "android.database.SQLiteDatabase.rawQuery(v2, v1);", "return;"]


def test_emulation_from_text_parameters(spark):
    last = sorted(answer(program(spark), parser().parse_args(["-i", "a", "--emulate", "A#sum", "--emulate-params", "10;20"])).collect(), key=lambda r: r.step)[-1]
    assert last.status == "finished" and last.returned.i == 30


def test_named_source(spark):
    p = program(spark)
    go = [r.line for r in p.source().join(p.code.where("method_name = 'go'"), "method_uid", "left_semi").orderBy("off").collect()]
    assert go == ["local1 = android.content.Intent.getStringExtra(local0);", "android.database.SQLiteDatabase.rawQuery(local2, local1);", "return;"]
    add = [r.line for r in p.source().join(p.code.where("method_name = 'sum'"), "method_uid", "left_semi").orderBy("off").collect()]
    assert add == ["result = p0 + p1;", "return result;"]
    assert {(r.v, r.type) for r in p.variable_types.collect()} == {("v1", "int"), ("v2", "int"), ("v0_1", "int")}


def test_files_of_source(spark, tmp_path):
    p = program(spark)
    p.write_sources(f"{tmp_path}/out")
    assert (tmp_path / "out/A.java").read_text() == p.text("A")
    lines = p.text("A").splitlines()
    assert lines[0] == "void go():" and lines[4:] == ["int sum(int, int):", "    result = p0 + p1;", "    return result;"] and p.text("B") == ""


def test_command_line(spark, tmp_path, capsys):
    """Every flag that asks for something gives it, to the console, to Parquet and to a folder."""
    (tmp_path / "a.dex").write_bytes(DEX)
    run = lambda *flags: main(["-i", f"{tmp_path}/a.dex", *flags])
    run("--scan-vulns")
    assert "sql_injection" in capsys.readouterr().out
    run("--scan-vulns", "--only-package", "other")
    assert capsys.readouterr().out == ""
    run("--scan-vulns", "--exclude", "A")
    assert capsys.readouterr().out == ""
    run("--scan-pending-intent")
    assert capsys.readouterr().out == ""
    run("--show-bytecode")
    assert len(capsys.readouterr().out.splitlines()) == 6
    run("--taint-method", "A#go", "--taint-offset", "6", "--taint-reg", "1")
    assert [x.split("\t")[3:] for x in sorted(capsys.readouterr().out.splitlines())] == [["6", "1", "True"], ["8", "1", "False"]]
    run("--taint-method", "A#go", "--taint-api", "getStringExtra")
    assert len(capsys.readouterr().out.splitlines()) == 2
    run("-o", f"{tmp_path}/rows")
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 5
    run("-d", f"{tmp_path}/out")
    assert (tmp_path / "out/A.java").exists()
    with __import__("pytest").raises(SystemExit):
        main(["--scan-vulns"])
