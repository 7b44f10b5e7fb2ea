"""The DEX data source, the tree sink, and walks over large files."""

import os
import struct
import sys
import time

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import dex_builder as builder  # noqa: E402
from test_dex import FULL, table  # noqa: E402

from bytelens.plans.dex_queries import build_file  # noqa: E402
from bytelens.sources import dex, dex_format  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dex_format.register(spark)
    root = tmp_path_factory.mktemp("dex")
    (root / "full.dex").write_bytes(FULL)
    (root / "parts.dex").write_bytes(build_file(7, [(k, k % 50, f"box {k}") for k in range(3, 60)]))
    (root / "no.dex").write_bytes(b"not a DEX file!!" * 20)
    (root / "short.dex").write_bytes(b"dex\n035\0")
    return str(root)


def read(spark, folder, name="classes", path="*.dex"):
    return spark.read.format("dex").option("table", name).load(f"{folder}/{path}")


def test_tables_agree_with_column_functions(spark, folder):
    d = dex.files(spark, f"{folder}/*.dex")
    classes = dex.classes(d)
    names = classes.select("dex_id", "class_idx", "class_name")
    got = read(spark, folder).select("class_name", "super_name", "access_flags").collect()
    assert sorted(got, key=str) == sorted(classes.select("class_name", "super_name", "access_flags").collect(), key=str) and len(got) == 58
    members = dex.class_members(d).join(names, ["dex_id", "class_idx"]).select("class_name", "kind", "pos", "access_flags", (F.col("code_off") > 0).alias("has_code"))
    assert sorted(read(spark, folder, "members").select(members.columns).collect()) == sorted(members.collect())
    notes = dex.annotations(d).join(names, ["dex_id", "class_idx"]).select("class_name", "pos", "name")
    assert sorted(read(spark, folder, "annotations").select(notes.columns).collect()) == sorted(notes.collect())
    m = dex.methods(d).select("dex_id", "method_idx", F.col("class").alias("class_name"), F.col("name").alias("method_name"), "params")
    code = dex.code(d).join(m, ["dex_id", "method_idx"])
    own = code.select("class_name", "method_name", "params", F.col("registers_size").cast("int"), F.col("ins_size").cast("int"), "insns")
    assert sorted(read(spark, folder, "code").select(own.columns).collect(), key=str) == sorted(own.collect(), key=str)
    ty = dex.types(d).select("dex_id", "type_idx", F.col("java_name").alias("type"))
    tr = dex.tries(d).join(code.select("method_uid", "dex_id", "class_name", "method_name"), "method_uid").join(ty, ["dex_id", "type_idx"], "left")
    tr = tr.select("class_name", "method_name", "try_id", "start", "end", "pos", "type", "handler_start", "handler_end")
    assert sorted(read(spark, folder, "tries").select(tr.columns).collect(), key=str) == sorted(tr.collect(), key=str) and tr.count() > 50


def test_filters_reach_the_reader(spark, folder):
    t = read(spark, folder).where(F.col("class_name").startswith("b7.P1") & (F.col("access_flags") > 3))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "access_flags" in plan.split("BatchScan")[0] and "StartsWith" not in plan  # Spark has only the other filter left
    assert sorted(r.class_name for r in t.collect()) == sorted(f"b7.P{k}" for k in range(3, 60) if f"{k}".startswith("1") and (k % 50 * 37 % 32 | 1) > 3)
    reader = dex_format.DexReader([f"{folder}/*.dex"], "classes")
    kept = list(reader.pushFilters([dex_format.StringStartsWith(("class_name",), "pkg."), dex_format.EqualTo(("access_flags",), 1)]))
    assert [f.attribute for f in kept] == [("access_flags",)]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == ["pkg.Color"]
    one = read(spark, folder).where(F.col("path").endswith("full.dex") & F.col("class_name").isin("pkg.Color", "x"))
    assert one.count() == 1 and read(spark, folder, path="nothing*.dex").count() == 0


def test_ranges_of_classes(spark, folder, monkeypatch):
    monkeypatch.setattr(dex_format, "CLASSES_PER_TASK", 10)
    reader = dex_format.DexReader([folder], "members")
    parts = reader.partitions()
    assert [(p.path.rsplit("/", 1)[1], p.first, p.last) for p in parts][:2] == [("full.dex", 0, 1), ("parts.dex", 0, 10)] and len(parts) == 7
    whole = [tuple(r)[1:] for r in read(spark, folder, "members").collect()]
    assert sorted((x[1:] for p in parts for x in reader.read(p)), key=str) == sorted(whole, key=str)


def test_damaged_files_lose_their_own_rows_only(spark, tmp_path):
    dex_format.register(spark)
    for n in range(0x70, len(FULL), 37):
        (tmp_path / f"{n}.dex").write_bytes(FULL[:n])
    (tmp_path / "whole.dex").write_bytes(FULL)
    for name in dex_format.TABLES:
        rows = read(spark, str(tmp_path), name).where(F.col("path").endswith("whole.dex")).count()
        assert rows == spark.read.format("dex").option("table", name).load(f"{tmp_path}/whole.dex").count()


def test_unknown_table(spark, folder):
    with pytest.raises(Exception, match="table is one of"):
        read(spark, folder, "nothing").count()


def test_tree(spark, tmp_path):
    dex_format.register(spark)
    root = tmp_path / "out"
    rows = [(f"com/app/C{k}.java", f"line {i} é" if i else None, k * 100 + i) for k in range(7) for i in range(5)]
    t = spark.createDataFrame(rows, "path string, text string, at int").repartition(3, "path").sortWithinPartitions("path", "at").select("path", "text")
    t.write.format("tree").mode("append").save(str(root))
    assert sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names) == sorted(f"com/app/C{k}.java" for k in range(7))
    assert (root / "com/app/C3.java").read_text() == "\n" + "".join(f"line {i} é\n" for i in range(1, 5))
    spark.createDataFrame([("x.bin", b"\0\xff")], "path string, b binary").write.format("tree").mode("append").save(str(root))
    assert (root / "x.bin").read_bytes() == b"\0\xff" and (root / "com/app/C0.java").exists()
    spark.createDataFrame([("only.txt", "a")], "path string, text string").write.format("tree").mode("overwrite").save(str(root))
    assert sorted(os.listdir(root)) == ["only.txt"]


@pytest.mark.parametrize("bad", ["../out.txt", "/etc/x", "", "twice"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    dex_format.register(spark)
    root = tmp_path / "out"
    rows = [(f"f{k}.txt", "a") for k in range(40)] + [("f0.txt" if bad == "twice" else bad, "b")]
    t = spark.createDataFrame(rows, "path string, text string").repartition(4)
    with pytest.raises(Exception, match="leaves the folder|follow each other|repartition by path"):
        t.write.format("tree").mode("append").save(str(root))
    assert not root.exists() or not [n for _, _, names in os.walk(root) for n in names]


def test_a_large_file_is_walked_once(spark):
    """Ten thousand classes in about 10 MB."""
    names = ["V", "Ljava/lang/Object;", "()V", "foo"]
    n, code = 10_000, {"insns": b"\0\0" * 480 + b"\x0e\0"}
    strings = names + [f"Lp/C{k};" for k in range(n)]
    data = builder.build(strings, [0, 1, *range(4, n + 4)], [(0, 0, ())], methods=[(2 + k, 0, 3) for k in range(n)], classes=[{"idx": 2 + k, "super": 1, "direct": [(k, 9, code)]} for k in range(n)])
    assert len(data) > 9_900_000 and struct.unpack_from("<I", data, 0x60)[0] == n
    d = table(spark, data)
    began = time.time()
    assert dex.class_members(d).count() == n
    assert time.time() - began < 10
    assert dex.code(d).agg(F.count("*"), F.sum(F.octet_length("insns"))).collect()[0][:] == (n, n * 962)


def test_small_files_share_tasks(spark, tmp_path):
    """A task opens many small files, no DEX files among them too; large ones still have tasks of their own."""
    dex_format.register(spark)
    for k in range(60):
        (tmp_path / f"f{k}.dex").write_bytes(build_file(k, [(j, j % 50, "box") for j in range(k % 3)]))
    (tmp_path / "no.dex").write_bytes(b"not a DEX file!!" * 20)
    (tmp_path / "short.dex").write_bytes(b"dex\n035\0")
    (tmp_path / "large.dex").write_bytes(build_file(99, [(j, 1, "box") for j in range(2500)]))
    reader = dex_format.DexReader([str(tmp_path)], "classes")
    parts = reader.partitions()
    assert sorted(type(p).__name__ for p in parts) == ["ClassRange", "ClassRange", "SmallFiles"]
    want = sorted([f"b{k}.P{j}" for k in range(60) for j in range(k % 3)] + [f"b99.P{j}" for j in range(2500)])
    assert sorted(r[1] for p in parts for r in reader.read(p)) == want
    assert sorted(r.class_name for r in read(spark, str(tmp_path)).collect()) == want
    assert read(spark, str(tmp_path)).where(F.col("path").endswith("f5.dex") & F.col("class_name").startswith("b5.")).count() == 2
