"""Literals that stand in a method's code: array data and switch keys, cut out of the bytes as arrays by column functions, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bytelens.sources.dex import little

# Marks of payloads: fixed values of the format.
PACKED, SPARSE, ARRAY = 0x0100, 0x0200, 0x0300


def signed(content: Column, at: Column, width: int) -> Column:
    """The signed little-endian number of 1, 2, 4 or 8 bytes at an offset."""
    if width == 8:
        return F.shiftleft(signed(content, at + 4, 4), 32).bitwiseOR(little(content, at, 4))
    x = little(content, at, width)
    return F.when(x >= 1 << (8 * width - 1), x - (1 << 8 * width)).otherwise(x)


def _mark(code: Column, at: Column) -> Column:
    return F.when((at >= 0) & (at + 4 <= F.octet_length(code)), little(code, at, 2))


def _each(n: Column, make) -> Column:
    return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), make)


def switch_payload(code: Column, off: Column, rel: Column) -> Column:
    """Where the payload of the switch at an offset stands, rel being its operand: at that distance in code units from the instruction, or by other
    conventions from two bytes on or in bytes; else the first within eight bytes. Null if there is none."""
    near = F.concat(F.array(off + 2 * rel, off + 2 + 2 * rel, off + rel, off + 2 + rel), F.transform(F.sequence(F.lit(-8).cast("long"), F.lit(8).cast("long")), lambda d: off + 2 * rel + d))
    return F.try_element_at(F.filter(near, lambda at: F.coalesce(_mark(code, at).isin(PACKED, SPARSE), F.lit(False))), F.lit(1))


def array_payload(code: Column, off: Column, rel: Column) -> Column:
    """Where the payload of the fill-array-data at an offset stands; null if there is none."""
    near = F.array(off + 2 * rel, off + 2 + 2 * rel)
    return F.try_element_at(F.filter(near, lambda x: F.coalesce((_mark(code, x) == ARRAY) & (x + 8 <= F.octet_length(code)), F.lit(False))), F.lit(1))


def switch_keys(code: Column, at: Column, mark: Column, n: Column) -> Column:
    """The n keys of the payload at an offset, in its order; null if it is cut off."""
    size, first = F.octet_length(code), F.array(signed(code, at + 4, 4))
    packed = F.when(at + 8 + 4 * n <= size, F.flatten(F.transform(first, lambda k: _each(n, lambda i: k + i))))
    sparse = F.when(at + 4 + 8 * n <= size, _each(n, lambda i: signed(code, at + 4 + 4 * i, 4)))
    return F.when(mark == PACKED, packed).when(mark == SPARSE, sparse)


def array_values(code: Column, at: Column, width: Column, n: Column) -> Column:
    """The n elements of the payload at an offset, signed by their width; null if it is cut off, or the width is none."""
    whole = at + 8 + n * width <= F.octet_length(code)

    def values(w: int) -> Column:
        return F.when(whole & (width == w), _each(n, lambda i: signed(code, at + 8 + i * w, w)))

    return F.coalesce(*map(values, (1, 2, 4, 8)))


def literals(code: DataFrame, ins: DataFrame) -> DataFrame:
    """method_uid, off, mnemonic, values (array of longs; null without a payload), line: array data and switches of instructions (method_uid, off, mnemonic, operands) of code
    (method_uid, insns). line is the array as a comment, or the switch with its cases."""
    t = ins.where(F.col("mnemonic").isin("packed-switch", "sparse-switch", "fill-array-data")).join(code.select("method_uid", "insns"), "method_uid")
    c, off, fills = F.col("insns"), F.col("off"), F.col("mnemonic") == "fill-array-data"
    room = off + 6 <= F.octet_length(c)
    t = t.withColumn("rel", F.when(room, signed(c, off + 2, 4)))  # column by column: each is used many times
    t = t.withColumn("at", F.when(fills, array_payload(c, off, F.col("rel"))).otherwise(switch_payload(c, off, F.col("rel"))))
    t = t.withColumns({"mark": _mark(c, F.col("at")), "second": little(c, F.col("at") + 2, 2), "third": F.when(fills, little(c, F.col("at") + 4, 4))})
    t = t.withColumn("values", F.when(fills, array_values(c, F.col("at"), F.col("second"), F.col("third"))).otherwise(switch_keys(c, F.col("at"), F.col("mark"), F.col("second"))))
    reg, text = F.trim(F.substring_index("operands", ",", 1)), F.transform("values", lambda v: v.cast("string"))
    array = F.coalesce(F.concat(F.lit("/* "), reg, F.lit(" = { "), F.array_join(text, ", "), F.lit(" } */")), F.concat(F.lit("/* fill-array-data "), "operands", F.lit(" */")))
    cases = F.array_join(F.concat(F.transform(text, lambda k: F.concat(F.lit("case "), k, F.lit(":"))), F.array(F.lit("default: break; }"))), " ")
    cut = F.when(F.col("mark") == PACKED, "packed").otherwise("sparse")
    why = F.when(~room, "payload missing").when(F.col("at").isNull(), "payload not found").otherwise(F.concat(cut, F.lit(" payload truncated")))
    switch = F.coalesce(F.concat(F.lit("switch ("), reg, F.lit(") { "), cases), F.concat(F.lit("switch ("), reg, F.lit(");  // ("), why, F.lit(")")))
    return t.select("method_uid", "off", "mnemonic", "values", F.when(fills, array).otherwise(switch).alias("line"))
