"""DEX files as tables: read as binary rows, pools and class tables cut out by column functions.

Fixed-width records (header, ids, class definitions, parameter lists) are slices of the content, computed by
Spark; byte streams of variable width are walked once for each file (strings here, the rest in sources.walk). A file that can't be
read gives one row in `errors` and none elsewhere; it never fails the others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bytelens.functions.java import descriptor_to_java
from bytelens.runtime import ship
from bytelens.sources.bytecode import instructions as decoded
from bytelens.sources.walk import walked

NO_INDEX = 0xFFFFFFFF
# Places of (size, offset) of the tables in a header: fixed values of the format.
HEADER = {"string": 0x38, "type": 0x40, "proto": 0x48, "field": 0x50, "method": 0x58, "class": 0x60}


def little(content: Column, off: Column | int, n: int) -> Column:
    """The unsigned little-endian number of n bytes at an offset."""
    at = off if isinstance(off, Column) else F.lit(off)
    h = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))]), 16, 10).cast("long")


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """dex_id, dex_ord (place among the paths given), path, content, error."""
    out = None
    for k, p in enumerate(paths):
        t = spark.read.format("binaryFile").load(p).select(F.xxhash64("path").alias("dex_id"), F.lit(k).alias("dex_ord"), "path", "content")
        out = t if out is None else out.union(t)
    return checked(out)


def checked(raw: DataFrame) -> DataFrame:
    """raw (dex_id, dex_ord, path, content) with error: null for files whose header can be read."""
    c = F.col("content")
    magic = F.hex(F.substring(c, 1, 4)) == "6465780A"
    error = F.when(F.coalesce(F.octet_length(c), F.lit(0)) < 4, "Parse: empty or truncated").when(~magic, "InvalidMagic").when(F.octet_length(c) < 0x70, "Truncated")
    return raw.withColumn("error", error)


def errors(dex: DataFrame) -> DataFrame:
    return dex.where("error is not null").select("dex_id", "path", "error")


def _records(dex: DataFrame, table: str, width: int, more=None, **parts: tuple[int, int]) -> DataFrame:
    """dex_id, idx and a number for each part (offset in the record, bytes) of a table's records; with more also what it makes of a
    record and the file's content."""
    good = dex.where("error is null")
    size, off = little(F.col("content"), HEADER[table], 4), little(F.col("content"), HEADER[table] + 4, 4)
    room = F.greatest(F.lit(0), F.floor((F.octet_length("content") - off) / width)).cast("long")
    ids = F.when(F.least(size, room) > 0, F.sequence(F.lit(0).cast("long"), F.least(size, room) - 1)).otherwise(F.array().cast("array<long>"))
    record = lambda i: F.substring(F.col("content"), (off + i * width + 1).cast("int"), F.lit(width))
    if more is None:
        t = good.select("dex_id", F.posexplode(F.transform(ids, record)).alias("idx", "record"))
        return t.select("dex_id", F.col("idx").cast("long"), *[little(F.col("record"), at, n).alias(name) for name, (at, n) in parts.items()])
    both = F.transform(ids, lambda i: F.struct(record(i).alias("record"), more(record(i)).alias("more")))
    t = good.select("dex_id", F.posexplode(both).alias("idx", "x"))
    return t.select("dex_id", F.col("idx").cast("long"), *[little(F.col("x.record"), at, n).alias(name) for name, (at, n) in parts.items()], F.col("x.more").alias("more"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _strings(content: pd.Series, off: pd.Series, size: pd.Series) -> pd.Series:
    """The string pool of each file: MUTF-8 up to a zero byte; null where an entry can't be read."""

    def text(data: bytes, at: int) -> str | None:
        while at < len(data) and data[at] & 0x80:  # the length, a LEB128 number
            at += 1
        end = data.find(b"\0", at + 1)
        if at >= len(data) or end < 0:
            return None
        raw = data[at + 1 : end].replace(b"\xc0\x80", b"\0")
        return raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def pool(data: bytes, off: int, size: int) -> list[str | None]:
        out = []
        for i in range(min(size, max(0, len(data) - off) // 4)):
            try:
                out.append(text(data, int.from_bytes(data[off + 4 * i : off + 4 * i + 4], "little")))
            except UnicodeDecodeError:
                out.append(None)
        return out

    return pd.Series([pool(bytes(c), int(o), int(n)) for c, o, n in zip(content, off, size, strict=True)])


def strings(dex: DataFrame) -> DataFrame:
    """dex_id, string_idx, value; entries that can't be read are left out, indices stay."""
    ship(dex.sparkSession)
    c = F.col("content")
    t = dex.where("error is null").select("dex_id", F.posexplode(_strings(c, little(c, HEADER["string"] + 4, 4), little(c, HEADER["string"], 4))).alias("string_idx", "value"))
    return t.where("value is not null").select("dex_id", F.col("string_idx").cast("long").alias("string_idx"), "value")


def types(dex: DataFrame) -> DataFrame:
    """dex_id, type_idx, descriptor, java_name."""
    t = _records(dex, "type", 4, string_idx=(0, 4)).withColumnRenamed("idx", "type_idx").join(strings(dex), ["dex_id", "string_idx"])
    return t.select("dex_id", "type_idx", F.col("value").alias("descriptor"), descriptor_to_java(F.col("value")).alias("java_name"))


def _named(t: DataFrame, column: str, pool: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """t with name: value of the pool's entry that column numbers; null if there is none."""
    return t.join(pool.select("dex_id", F.col(key).alias(column), F.col(value).alias(name)), ["dex_id", column], "left")


def fields(dex: DataFrame) -> DataFrame:
    """dex_id, field_idx, class, name, type (Java names)."""
    t = _records(dex, "field", 8, c=(0, 2), t=(2, 2), n=(4, 4)).withColumnRenamed("idx", "field_idx")
    ty = types(dex)
    t = _named(_named(_named(t, "c", ty, "type_idx", "java_name", "class"), "t", ty, "type_idx", "java_name", "type"), "n", strings(dex), "string_idx", "value", "name")
    return t.select("dex_id", "field_idx", "class", "name", "type")


def protos(dex: DataFrame) -> DataFrame:
    """dex_id, proto_idx, params (array of Java names), return_type."""
    c = F.col("content")

    def listed(record: Column) -> Column:
        """Type indices of the record's parameters: a size and a number for each, at the record's offset."""
        at = little(record, 8, 4)
        n = F.when(at > 0, F.least(little(c, at, 4), F.floor((F.octet_length(c) - at - 4) / 2).cast("long"))).otherwise(0)
        return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), lambda i: little(c, at + 4 + 2 * i, 2))

    t = _records(dex, "proto", 12, listed, r=(4, 4)).withColumnRenamed("idx", "proto_idx")
    ty = types(dex)
    one = t.select("dex_id", "proto_idx", F.posexplode("more").alias("pos", "type_idx")).join(ty.select("dex_id", "type_idx", "java_name"), ["dex_id", "type_idx"], "left")
    params = one.groupBy("dex_id", "proto_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "java_name"))), lambda x: x["java_name"]).alias("params"))
    t = _named(t, "r", ty, "type_idx", "java_name", "return_type").join(params, ["dex_id", "proto_idx"], "left")
    return t.select("dex_id", "proto_idx", F.coalesce("params", F.array().cast("array<string>")).alias("params"), "return_type")


def methods(dex: DataFrame) -> DataFrame:
    """dex_id, method_idx, class, name, params, return_type."""
    t = _records(dex, "method", 8, c=(0, 2), proto_idx=(2, 2), n=(4, 4)).withColumnRenamed("idx", "method_idx")
    t = _named(_named(t, "c", types(dex), "type_idx", "java_name", "class"), "n", strings(dex), "string_idx", "value", "name")
    return t.join(protos(dex), ["dex_id", "proto_idx"], "left").select("dex_id", "method_idx", "class", "name", "params", "return_type")


def classes(dex: DataFrame) -> DataFrame:
    """dex_id, class_idx (type index), class_name, super_name (null if there is none), access_flags, data_off, annotations_off."""
    t = _records(dex, "class", 32, class_idx=(0, 4), access_flags=(4, 4), s=(8, 4), annotations_off=(20, 4), data_off=(24, 4))
    ty = types(dex)
    t = _named(_named(t, "class_idx", ty, "type_idx", "java_name", "class_name"), "s", ty, "type_idx", "java_name", "super_name")
    return t.select("dex_id", F.col("idx").alias("def_idx"), "class_idx", "class_name", "super_name", "access_flags", "data_off", "annotations_off")


def class_members(dex: DataFrame) -> DataFrame:
    """dex_id, class_idx, kind, pos, idx, access_flags, code_off (0 for fields and methods without code)."""
    return walked(dex, "member").select("dex_id", "class_idx", "kind", "pos", "idx", "access_flags", "code_off")


def code(dex: DataFrame) -> DataFrame:
    """Methods that have code: method_uid, dex_id, method_idx, is_static, registers_size, ins_size, tries_size, insns_off, insns."""
    static = (F.col("access_flags").bitwiseAND(8) != 0).alias("is_static")
    return walked(dex, "code").select(F.xxhash64("dex_id", "idx").alias("method_uid"), "dex_id", F.col("idx").alias("method_idx"), static, "registers_size", "ins_size", "tries_size", "insns_off", "insns")


def tries(dex: DataFrame, methods_code: DataFrame | None = None) -> DataFrame:
    """method_uid, try_id, start, end (byte offsets in the method), pos, type_idx (null for a catch-all), handler_start,
    handler_end (the next larger boundary of the method's handlers, or its code's end). Tries whose list isn't there are left out; with
    methods_code so are those of other methods."""
    t = walked(dex, "try").select(F.xxhash64("dex_id", "idx").alias("method_uid"), "try_id", "start", "end", "pos", "type_idx", "handler_start", "handler_end")
    return t if methods_code is None else t.join(methods_code.select("method_uid"), "method_uid", "left_semi")


def annotations(dex: DataFrame) -> DataFrame:
    """dex_id, class_idx, pos, type_idx, name (simple Java name) of the annotations of classes; entries that are cut off are
    left out."""
    t = walked(dex, "annotation").select("dex_id", "class_idx", "pos", "type_idx")
    t = _named(t, "type_idx", types(dex), "type_idx", "java_name", "java_name").where("java_name is not null")
    return t.select("dex_id", "class_idx", "pos", "type_idx", F.substring_index("java_name", ".", -1).alias("name"))


def resolve(ins: DataFrame, dex: DataFrame, uids: DataFrame) -> DataFrame:
    """Instructions with pool tokens in their operands replaced by what they name: a string in quotes, a class, Class.field,
    Class.method(types). Tokens that name nothing stay. uids: method_uid, dex_id. Tokens meet the pools in equi-joins."""
    from bytelens.functions.java import escape

    t = ins.join(uids.select("method_uid", "dex_id").distinct(), "method_uid")
    t = t.withColumn("kind", F.regexp_extract("operands", r"(string|type|field|method)@\d+$", 1)).withColumn("idx", F.nullif(F.regexp_extract("operands", r"@(\d+)$", 1), F.lit("")).cast("long"))
    names = strings(dex).select("dex_id", F.lit("string").alias("kind"), F.col("string_idx").alias("idx"), F.concat(F.lit('"'), escape(F.col("value")), F.lit('"')).alias("text"))
    names = names.union(types(dex).select("dex_id", F.lit("type"), "type_idx", "java_name"))
    names = names.union(fields(dex).select("dex_id", F.lit("field"), "field_idx", F.concat("class", F.lit("."), "name")))
    names = names.union(methods(dex).select("dex_id", F.lit("method"), "method_idx", F.concat("class", F.lit("."), "name", F.lit("("), F.array_join("params", ", "), F.lit(")"))))
    t = t.join(names, ["dex_id", "kind", "idx"], "left")
    resolved = F.when(F.col("text").isNotNull(), F.concat(F.regexp_replace("operands", r"(string|type|field|method)@\d+$", ""), "text")).otherwise(F.col("operands"))
    return t.select("method_uid", "off", "mnemonic", resolved.alias("operands"), "code_end", "units")


def instructions(dex: DataFrame) -> DataFrame:
    """Resolved instructions of all methods with code, offsets from the method's first byte."""
    c = code(dex)
    return resolve(decoded(c), dex, c)


def enums(dex: DataFrame) -> DataFrame:
    """dex_id, class_name, constants: static final fields of the class's own type, in order, of classes that extend Enum."""
    f = class_members(dex).where("kind = 'static_field'").join(fields(dex).withColumnRenamed("field_idx", "idx"), ["dex_id", "idx"])
    own = f.where((F.col("type") == F.col("class")) & (F.col("access_flags").bitwiseAND(0x18) == 0x18))
    names = own.groupBy("dex_id", "class_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("constants"))
    return classes(dex).where("super_name = 'java.lang.Enum'").join(names, ["dex_id", "class_idx"], "left").select("dex_id", "class_name", F.coalesce("constants", F.array().cast("array<string>")).alias("constants"))


def class_list(dex: DataFrame, only_package: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """dex_id, class_name of the classes that the filters leave."""
    from bytelens.functions.java import excluded, in_package

    t = classes(dex).select("dex_id", "class_name")
    if only_package:
        t = t.where(in_package(F.col("class_name"), only_package))
    return t.where(~excluded(F.col("class_name"), exclude)) if exclude else t


def find_methods(dex: DataFrame, class_name: str, method: str) -> DataFrame:
    """The first method of the name, by the files' order: an exact class first, then a class of that simple name in any
    package; direct methods before virtual ones."""
    m = methods(dex).join(class_members(dex).where("kind like '%method'").withColumnRenamed("idx", "method_idx").select("dex_id", "method_idx", "kind", "pos", "code_off", "access_flags"), ["dex_id", "method_idx"]).join(dex.select("dex_id", "dex_ord"), "dex_id")
    simple = class_name.rsplit(".", 1)[-1]
    m = m.where((F.col("name") == method) & ((F.col("class") == class_name) | (F.substring_index("class", ".", -1) == simple)))
    return m.orderBy((F.col("class") != class_name), "dex_ord", "class", (F.col("kind") != "direct_method"), "pos").limit(1)
