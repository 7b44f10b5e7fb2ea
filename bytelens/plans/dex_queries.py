"""Queries over DEX files that are built from `part`, read back, and held against SQL over `part`: members, annotations, tries, code,
resolved operands and switch cases.

A file holds the parts of a brand in a thousand keys, a class for each; what a class has follows from its part's key and size. SQL
says the same in terms of the columns, so that it shares nothing with the readers.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.runtime import fresh_path, materialize, ship
from bytelens.sources import bytecode, dex, dex_format

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def leb(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


FIRST_TYPES = ("V", "I", "[I", "Ljava/lang/Object;", "Ljava/lang/String;", "Ljava/util/List;", "Ljava/lang/Exception;", "Lnote/N0;", "Lnote/N1;")


def method_code(key: int, size: int, string: int, own: int, method: int, field: int | None) -> bytes:
    """The code of m0 with its tries: a string, an instance, a call, a field or a constant, a switch, nops, a return, the payload."""
    n, k = 4 + size % 8, key % 4
    pad = (13 + n) % 2
    payload_at = 13 + n + pad
    code = struct.pack("<BBH BBH BBHBB", 0x1A, 0, string, 0x22, 1, own, 0x71, 0x20, method, 0x10, 0)
    code += struct.pack("<BBH", 0x60, 2, field) if field is not None else bytes([0x12, 0x02, 0, 0])
    code += struct.pack("<BBi", 0x2B if size % 2 == 0 else 0x2C, 2, payload_at - 9) + b"\0\0" * n + b"\x0e\0" + b"\0\0" * pad
    targets = [3 + i for i in range(k)]
    code += struct.pack(f"<HHi{k}i", 0x0100, k, size, *targets) if size % 2 == 0 else struct.pack(f"<HH{2 * k}i", 0x0200, k, *(10 * size + 7 * i for i in range(k)), *targets)
    first = bytes([0x7F if key % 3 == 0 else 1]) + leb(6) + leb(12) + (leb(13) if key % 3 == 0 else b"")  # 0x7F: one type, and a catch-all
    lists = leb(2) + first + b"\0" + leb(14)
    tries = [(0, 4, 1)] + ([(7, 2, 1 if size % 5 == 0 else 1 + len(first))] if size % 2 else [])
    out = struct.pack("<HHHHII", 4, 1, 2, len(tries), 0, len(code) // 2) + code
    out += b"\0" * (-len(out) % 4)
    return out + b"".join(struct.pack("<IHH", *t) for t in tries) + lists


def build_file(brand: int, parts: list[tuple[int, int, str]]) -> bytes:
    """A DEX file of classes for parts (key, size, container), in their order."""
    strings: list[str] = []

    def string(s: str) -> int:
        if s not in place:
            place[s] = len(strings)
            strings.append(s)
        return place[s]

    place: dict[str, int] = {}
    types = [string(t) for t in FIRST_TYPES] + [string(f"Lb{brand}/P{key};") for key, _, _ in parts]
    protos, fields, methods, bodies = [(string("VIL"), 0, (1, 2)), (string("L"), 5, ())], [], [], []
    for c, (key, size, container) in enumerate(parts):
        own = len(FIRST_TYPES) + c
        static = [(len(fields) + i, 0x18 if i else 9) for i in range(size % 3)]
        fields += [(own, 1, string(f"s{i}")) for i in range(size % 3)]
        instance = [(len(fields), 2)] * (key % 2)
        fields += [(own, 4, string("x0"))] * (key % 2)
        direct = len(methods)
        methods.append((own, 0, string("m0")))
        virtual = [len(methods)] * (size % 4 == 0)
        methods += [(own, 1, string("size"))] * (size % 4 == 0)
        bodies.append((own, key, size, string(container or ""), static, instance, direct, virtual))
    at, places = 0x70, []
    for count, width in ((len(strings), 4), (len(types), 4), (len(protos), 12), (len(fields), 8), (len(methods), 8), (len(parts), 32)):
        places.append((count, at if count else 0))
        at += count * width
    base, data = at, bytearray()

    def put(raw: bytes, align: int = 1) -> int:
        data.extend(b"\0" * (-(base + len(data)) % align))
        data.extend(raw)
        return base + len(data) - len(raw)

    string_ids = b"".join(struct.pack("<I", put(leb(len(s.encode("utf-16-le")) // 2) + s.encode() + b"\0")) for s in strings)
    proto_ids = b"".join(struct.pack("<III", shorty, ret, put(struct.pack(f"<I{len(params)}H", len(params), *params), 4) if params else 0) for shorty, ret, params in protos)
    defs = b""
    for own, key, size, text, static, instance, direct, virtual in bodies:
        code = put(method_code(key, size, text, own, direct, static[0][0] if static else None), 4)
        body = leb(len(static)) + leb(len(instance)) + leb(1) + leb(len(virtual))
        for group in (static, instance):
            last = 0
            for idx, flags in group:
                body += leb(idx - last) + leb(flags)
                last = idx
        body += leb(direct) + leb(9) + leb(code) + b"".join(leb(v) + leb(1) + leb(0) for v in virtual)
        notes = 0
        if size % 3:
            items = [put(b"\x01" + leb(7 + i) + leb(0)) for i in range(size % 3)]
            notes = put(struct.pack("<IIII", put(struct.pack(f"<I{len(items)}I", len(items), *items), 4), 0, 0, 0), 4)
        defs += struct.pack("<8I", own, size * 37 % 32 | 1, 3, 0, 0xFFFFFFFF, notes, put(body), 0)
    head = b"dex\n035\0" + b"\0" * 24 + struct.pack("<III", base + len(data), 0x70, 0x12345678) + b"\0" * 12 + b"".join(struct.pack("<II", *p) for p in places)
    rows = string_ids + b"".join(struct.pack("<I", t) for t in types) + proto_ids + b"".join(struct.pack("<HHI", *f) for f in fields) + b"".join(struct.pack("<HHI", *m) for m in methods) + defs
    return head.ljust(0x70, b"\0") + rows + bytes(data)


def contents(spark: SparkSession, d: str) -> DataFrame:
    """dex_id, content: the built files."""
    ship(spark)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.sort_values("key")
        return pd.DataFrame({"dex_id": [int(t["dex_id"].iloc[0])], "content": [build_file(int(t["brand"].iloc[0]), list(zip(t["key"].tolist(), t["size"].tolist(), t["container"].tolist(), strict=True)))]})

    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    p = spark.read.parquet(f"{d}/part.parquet").select(brand.alias("brand"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_type").alias("container"))
    return p.withColumn("dex_id", F.col("brand") * 10_000_000 + F.floor(F.col("key") / 1000)).groupBy("dex_id").applyInPandas(build, "dex_id long, content binary")


def built(spark: SparkSession, d: str) -> DataFrame:
    t = contents(spark, d).select("dex_id", F.lit(0).alias("dex_ord"), F.col("dex_id").cast("string").alias("path"), "content")
    return dex.checked(materialize(t, "built-dex"))


_P = """p AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS brand, p_partkey AS k, CAST(p_size AS BIGINT) AS s, p_type AS box FROM part),
c AS (SELECT *, brand * 10000000 + k // 1000 AS dex_id, 'b' || brand || '.P' || k AS class_name, 4 + s % 8 AS n, k % 4 AS cases, (13 + 4 + s % 8) + (13 + 4 + s % 8) % 2 AS pay FROM p),
z AS (SELECT *, 2 * (pay + CASE WHEN s % 2 = 0 THEN 4 + 2 * cases ELSE 2 + 4 * cases END) AS code_end FROM c)"""
_CLASS = ["dex_id", "class_idx"]


def _named(t: DataFrame, files: DataFrame) -> DataFrame:
    return t.join(dex.classes(files).select("dex_id", "class_idx", "class_name"), _CLASS)


@query(
    f"""WITH {_P} SELECT dex_id, class_name, 'static_field' AS kind, CAST(i AS INTEGER) AS pos, 's' || i AS name, CASE WHEN i = 0 THEN 9 ELSE 24 END AS access_flags, false AS has_code FROM (SELECT *, unnest(range(0, s % 3)) AS i FROM z)
UNION ALL SELECT dex_id, class_name, 'instance_field', 0, 'x0', 2, false FROM z WHERE k % 2 = 1 UNION ALL SELECT dex_id, class_name, 'direct_method', 0, 'm0', 9, true FROM z
UNION ALL SELECT dex_id, class_name, 'virtual_method', 0, 'size', 1, false FROM z WHERE s % 4 = 0"""
)
def dex_members(spark: SparkSession, d: str) -> DataFrame:
    """Fields and methods of the classes, with their names."""
    f = built(spark, d)
    names = dex.fields(f).select("dex_id", F.lit(True).alias("is_field"), F.col("field_idx").alias("idx"), "name").union(dex.methods(f).select("dex_id", F.lit(False), "method_idx", "name"))
    m = _named(dex.class_members(f), f).withColumn("is_field", F.col("kind").endswith("field")).join(names, ["dex_id", "is_field", "idx"])
    return m.select("dex_id", "class_name", "kind", "pos", "name", "access_flags", (F.col("code_off") > 0).alias("has_code"))


@query(f"WITH {_P} SELECT dex_id, class_name, CAST(i AS INTEGER) AS pos, 'N' || i AS name, 'java.lang.Object' AS super_name, ((s * 37) % 32) | 1 AS access_flags FROM (SELECT *, unnest(range(0, s % 3)) AS i FROM z)")
def dex_annotations(spark: SparkSession, d: str) -> DataFrame:
    f = built(spark, d)
    return dex.annotations(f).join(dex.classes(f), _CLASS).select("dex_id", "class_name", "pos", "name", "super_name", "access_flags")


_TRIES = f"""{_P}, t AS (SELECT *, 0 AS try_id, 0 AS start, 8 AS stop, 1 AS list FROM z UNION ALL SELECT *, 1, 14, 18, CASE WHEN s % 5 = 0 THEN 1 ELSE 2 END FROM z WHERE s % 2 = 1),
h AS (SELECT *, 0 AS pos, 'java.lang.Exception' AS type, 24 AS handler_start FROM t WHERE list = 1 UNION ALL SELECT *, 1, NULL, 26 FROM t WHERE list = 1 AND k % 3 = 0 UNION ALL SELECT *, 0, NULL, 28 FROM t WHERE list = 2),
b AS (SELECT DISTINCT k, handler_start AS place FROM h), e AS (SELECT k, place, lead(place) OVER (PARTITION BY k ORDER BY place) AS after FROM b),
tries AS (SELECT dex_id, class_name, k, CAST(try_id AS INTEGER) AS try_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CAST(pos AS INTEGER) AS pos, type, CAST(handler_start AS BIGINT) AS handler_start, coalesce(after, code_end) AS handler_end, code_end FROM h JOIN e USING (k) WHERE e.place = handler_start)"""


@query(f"WITH {_TRIES} SELECT dex_id, class_name, try_id, start, stop, pos, type, handler_start, handler_end FROM tries")
def dex_tries(spark: SparkSession, d: str) -> DataFrame:
    """Tries with their handlers and where these end."""
    f = built(spark, d)
    t = dex.tries(f).join(dex.code(f).select("method_uid", "dex_id", "method_idx"), "method_uid").join(dex.methods(f).select("dex_id", "method_idx", F.col("class").alias("class_name")), ["dex_id", "method_idx"])
    t = t.join(dex.types(f).select("dex_id", "type_idx", F.col("java_name").alias("type")), ["dex_id", "type_idx"], "left")
    return t.select("dex_id", "class_name", "try_id", "start", F.col("end").alias("stop"), "pos", "type", "handler_start", "handler_end")


@query(
    f"""WITH {_P}, i AS (SELECT dex_id, class_name, unnest([{{'o': 0, 'm': 'const-string', 'x': 'v0, "' || box || '"'}}, {{'o': 4, 'm': 'new-instance', 'x': 'v1, ' || class_name}},
{{'o': 8, 'm': 'invoke-static', 'x': 'v0, v1, ' || class_name || '.m0(int, int[])'}}, {{'o': 14, 'm': CASE WHEN s % 3 > 0 THEN 'sget' ELSE 'const/4' END, 'x': CASE WHEN s % 3 > 0 THEN 'v2, ' || class_name || '.s0' ELSE 'v2, 0' END}},
{{'o': 18, 'm': CASE WHEN s % 2 = 0 THEN 'packed-switch' ELSE 'sparse-switch' END, 'x': 'v2, +' || lpad(lower(to_hex(pay - 9)), 3, '0') || 'h'}}, {{'o': 24 + 2 * n, 'm': 'return-void', 'x': ''}}]) AS r FROM z)
SELECT dex_id, class_name, CAST(r.o AS BIGINT) AS off, r.m AS mnemonic, r.x AS operands FROM i"""
)
def dex_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Instructions with what their operands name, without nops and payloads."""
    f = built(spark, d)
    c = materialize(dex.code(f), "dex-code")
    names = dex.methods(f).select("dex_id", "method_idx", F.col("class").alias("class_name"))
    ins = dex.resolve(bytecode.instructions(c), f, c).where("mnemonic != 'nop' and not mnemonic like '%-payload'")
    return ins.join(c.select("method_uid", "dex_id", "method_idx"), "method_uid").join(names, ["dex_id", "method_idx"]).select("dex_id", "class_name", "off", "mnemonic", "operands")


@query(f"WITH {_P} SELECT dex_id, class_name, CAST(18 AS BIGINT) AS off, CAST(CASE WHEN s % 2 = 0 THEN s + i ELSE 10 * s + 7 * i END AS INTEGER) AS case_value, 24 + 2 * i AS target FROM (SELECT *, unnest(range(0, cases)) AS i FROM z)")
def dex_switch_cases(spark: SparkSession, d: str) -> DataFrame:
    f = built(spark, d)
    c = materialize(dex.code(f), "dex-code")
    names = dex.methods(f).select("dex_id", "method_idx", F.col("class").alias("class_name"))
    return bytecode.switch_cases(c, bytecode.instructions(c)).join(c.select("method_uid", "dex_id", "method_idx"), "method_uid").join(names, ["dex_id", "method_idx"]).select("dex_id", "class_name", "off", "case_value", "target")


def written(spark: SparkSession, d: str) -> str:
    """A folder of the built files, written by the tree sink: brand folders with a file for each thousand keys."""
    path = fresh_path(dex_format.register(spark), "dex-tree")
    name = F.concat(F.lit("brand"), F.floor(F.col("dex_id") / 10_000_000), F.lit("/"), F.col("dex_id") % 10_000_000, F.lit(".dex"))
    contents(spark, d).select(name.alias("path"), "content").write.format("tree").mode("append").save(path)
    return path


@query(
    f"""WITH {_TRIES}, own AS (SELECT * FROM tries WHERE starts_with(class_name, 'b2')) SELECT 'brand' || (dex_id // 10000000) || '/' || (dex_id % 10000000) || '.dex' AS file, class_name, 'm0' AS method_name, try_id, start, stop, pos, type, handler_start, handler_end FROM own"""
)
def dex_source(spark: SparkSession, d: str) -> DataFrame:
    """Tries read by the data source from files that the sink has written; the filter on packages reaches the reader."""
    t = spark.read.format("dex").option("table", "tries").load(written(spark, d)).where(F.col("class_name").startswith("b2"))
    return t.select(F.regexp_extract("path", r"(brand\d+/\d+\.dex)$", 1).alias("file"), "class_name", "method_name", "try_id", "start", F.col("end").alias("stop"), "pos", "type", "handler_start", "handler_end")
