"""Instructions from code bytes: a method's bytes become rows of offset, mnemonic and operands, switch payloads rows of cases.

Operands read as registers (v0), decimal literals, pool tokens (string@5) and branch offsets in code units
(+008h, -3h). Decoding a method is sequential; Spark decodes methods side by side, and joins do the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from bytelens.runtime import ship

# Opcodes of the Dalvik bytecode format in their order: first opcode, format, names. Fixed values.
_KINDS = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
_CALLS = ("virtual", "super", "direct", "static", "interface")
_BITS = ("add", "sub", "mul", "div", "rem", "and", "or", "xor", "shl", "shr", "ushr")
_RUNS = (
    (0x00, "10x", ["nop"]), (0x01, "12x", ["move"]), (0x02, "22x", ["move/from16"]), (0x03, "32x", ["move/16"]),
    (0x04, "12x", ["move-wide"]), (0x05, "22x", ["move-wide/from16"]), (0x06, "32x", ["move-wide/16"]),
    (0x07, "12x", ["move-object"]), (0x08, "22x", ["move-object/from16"]), (0x09, "32x", ["move-object/16"]),
    (0x0A, "11x", ["move-result", "move-result-wide", "move-result-object", "move-exception"]),
    (0x0E, "10x", ["return-void"]), (0x0F, "11x", ["return", "return-wide", "return-object"]),
    (0x12, "11n", ["const/4"]), (0x13, "21s", ["const/16"]), (0x14, "31i", ["const"]), (0x15, "21h", ["const/high16"]),
    (0x16, "21s", ["const-wide/16"]), (0x17, "31i", ["const-wide/32"]), (0x18, "51l", ["const-wide"]), (0x19, "21h", ["const-wide/high16"]),
    (0x1A, "21c string", ["const-string"]), (0x1B, "31c string", ["const-string/jumbo"]), (0x1C, "21c type", ["const-class"]),
    (0x1D, "11x", ["monitor-enter", "monitor-exit"]), (0x1F, "21c type", ["check-cast"]), (0x20, "22c type", ["instance-of"]), (0x21, "12x", ["array-length"]),
    (0x22, "21c type", ["new-instance"]), (0x23, "22c type", ["new-array"]), (0x24, "35c type", ["filled-new-array"]), (0x25, "3rc type", ["filled-new-array/range"]),
    (0x26, "31t", ["fill-array-data"]), (0x27, "11x", ["throw"]), (0x28, "10t", ["goto"]), (0x29, "20t", ["goto/16"]), (0x2A, "30t", ["goto/32"]), (0x2B, "31t", ["packed-switch", "sparse-switch"]),
    (0x2D, "23x", ["cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"]),
    (0x32, "22t", [f"if-{c}" for c in ("eq", "ne", "lt", "ge", "gt", "le")]), (0x38, "21t", [f"if-{c}z" for c in ("eq", "ne", "lt", "ge", "gt", "le")]),
    (0x44, "23x", ["aget" + k for k in _KINDS] + ["aput" + k for k in _KINDS]), (0x52, "22c field", ["iget" + k for k in _KINDS] + ["iput" + k for k in _KINDS]),
    (0x60, "21c field", ["sget" + k for k in _KINDS] + ["sput" + k for k in _KINDS]), (0x6E, "35c method", ["invoke-" + k for k in _CALLS]), (0x74, "3rc method", [f"invoke-{k}/range" for k in _CALLS]),
    (0x7B, "12x", ["neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double"]),
    (0x81, "12x", [f"{a}-to-{b}" for a in ("int", "long", "float", "double") for b in ("int", "long", "float", "double") if a != b] + ["int-to-byte", "int-to-char", "int-to-short"]),
    (0x90, "23x", [f"{b}-int" for b in _BITS] + [f"{b}-long" for b in _BITS] + [f"{b}-{k}" for k in ("float", "double") for b in _BITS[:5]]),
    (0xB0, "12x", [f"{b}-int/2addr" for b in _BITS] + [f"{b}-long/2addr" for b in _BITS] + [f"{b}-{k}/2addr" for k in ("float", "double") for b in _BITS[:5]]),
    (0xD0, "22s", ["rsub-int" if b == "sub" else f"{b}-int/lit16" for b in _BITS[:8]]), (0xD8, "22b", [("rsub" if b == "sub" else b) + "-int/lit8" for b in _BITS]),
)
OPCODES = {first + i: (name, *form.split()) for first, form, names in _RUNS for i, name in enumerate(names)}
PAYLOADS = {0x0100: "packed-switch-payload", 0x0200: "sparse-switch-payload", 0x0300: "fill-array-data-payload"}


def payload_units(code: bytes, at: int) -> int:
    """Size of a payload in code units; 0 if what stands there is none or is cut off."""
    if at + 4 > len(code):
        return 0
    ident, n = struct.unpack_from("<HH", code, at)
    if ident == 0x0300 and at + 8 <= len(code):
        units = (struct.unpack_from("<I", code, at + 4)[0] * n + 1) // 2 + 4
    else:
        units = {0x0100: n * 2 + 4, 0x0200: n * 4 + 2}.get(ident, 0)
    return units if at + 2 * units <= len(code) else 0


def operands_of(form: str, pool: str, code: bytes, at: int) -> str:
    """Operand text of the instruction at an offset."""
    u = lambda i: struct.unpack_from("<H", code, at + 2 * i)[0]
    s = lambda i, f="<h": struct.unpack_from(f, code, at + 2 * i)[0]
    jump = lambda d: f"{'-' if d < 0 else '+'}{abs(d):03x}h"
    aa, a, b = code[at + 1], code[at + 1] & 15, code[at + 1] >> 4
    ref = lambda i: f"{pool}@{i}"
    if form == "35c":
        regs = [u(2) & 15, u(2) >> 4 & 15, u(2) >> 8 & 15, u(2) >> 12, a][:b]
        return ", ".join([*(f"v{r}" for r in regs), ref(u(1))])
    if form == "3rc":
        return ", ".join([*(f"v{r}" for r in range(u(2), u(2) + aa)), ref(u(1))])
    parts = {
        "10x": lambda: [], "12x": lambda: [f"v{a}", f"v{b}"], "11x": lambda: [f"v{aa}"], "22x": lambda: [f"v{aa}", f"v{u(1)}"], "32x": lambda: [f"v{u(1)}", f"v{u(2)}"],
        "11n": lambda: [f"v{a}", str(b - 16 if b > 7 else b)], "21s": lambda: [f"v{aa}", str(s(1))], "21h": lambda: [f"v{aa}", str(s(1) << (48 if code[at] == 0x19 else 16))],
        "31i": lambda: [f"v{aa}", str(s(1, "<i"))], "51l": lambda: [f"v{aa}", str(s(1, "<q"))], "21c": lambda: [f"v{aa}", ref(u(1))], "31c": lambda: [f"v{aa}", ref(s(1, "<I"))], "22c": lambda: [f"v{a}", f"v{b}", ref(u(1))],
        "10t": lambda: [jump(struct.unpack_from("<b", code, at + 1)[0])], "20t": lambda: [jump(s(1))], "30t": lambda: [jump(s(1, "<i"))], "31t": lambda: [f"v{aa}", jump(s(1, "<i"))], "22t": lambda: [f"v{a}", f"v{b}", jump(s(1))], "21t": lambda: [f"v{aa}", jump(s(1))],
        "23x": lambda: [f"v{aa}", f"v{u(1) & 255}", f"v{u(1) >> 8}"], "22s": lambda: [f"v{a}", f"v{b}", str(s(1))], "22b": lambda: [f"v{aa}", f"v{u(1) & 255}", str(struct.unpack_from("<b", code, at + 3)[0])],
    }
    return ", ".join(parts[form]())


def decode(code: bytes) -> Iterator[tuple[int, str, str]]:
    """(offset, mnemonic, operands) of a method's code; decoding ends at an instruction that is cut off."""
    at = 0
    while at + 2 <= len(code):
        op = code[at]
        if op == 0 and code[at + 1] and (units := payload_units(code, at)):
            yield at, PAYLOADS[struct.unpack_from("<H", code, at)[0]], ""
            at += 2 * units
            continue
        name, form, *pool = OPCODES.get(op, (f"unused-{op:02x}", "10x"))
        size = 2 * int(form[0])
        if at + size > len(code):
            return
        yield at, name, operands_of(form, pool[0] if pool else "", code, at)
        at += size


def cases_of(code: bytes, at: int, target: int) -> list[tuple[int, int]]:
    """(key, target offset) of the switch at an offset, from its payload, in the payload's order."""
    if target < 0 or not payload_units(code, target):
        return []
    ident, n = struct.unpack_from("<HH", code, target)
    if ident == 0x0100:
        first, *rel = struct.unpack_from(f"<{n + 1}i", code, target + 4)
        return [(first + i, at + 2 * r) for i, r in enumerate(rel)]
    if ident == 0x0200:
        both = struct.unpack_from(f"<{2 * n}i", code, target + 4)
        return [(k, at + 2 * r) for k, r in zip(both[:n], both[n:], strict=True)]
    return []


def instructions(code: DataFrame) -> DataFrame:
    """method_uid, off, mnemonic, operands, code_end, raw_hex (bytes up to the next instruction) of code (method_uid, insns)."""
    ship(code.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [(uid, *x, len(insns)) for uid, insns in zip(t["method_uid"], t["insns"], strict=True) if insns is not None for x in decode(bytes(insns))]
            yield pd.DataFrame(rows, columns=["method_uid", "off", "mnemonic", "operands", "code_end"])

    rows = code.select("method_uid", "insns").mapInPandas(run, "method_uid long, off long, mnemonic string, operands string, code_end long")
    return rows.withColumn("units", F.coalesce(F.lead("off").over(W.partitionBy("method_uid").orderBy("off")), "code_end") - F.col("off"))


def raw_listing(code: DataFrame) -> DataFrame:
    """method_uid, idx, off, raw_hex, line: each instruction with its bytes, as a comment line."""
    t = instructions(code).join(code.select("method_uid", "insns"), "method_uid")
    raw = F.lower(F.regexp_replace(F.hex(F.substring("insns", (F.col("off") + 1).cast("int"), F.col("units").cast("int"))), "(..)(?!$)", "$1 "))
    idx = (F.row_number().over(W.partitionBy("method_uid").orderBy("off")) - 1).cast("long")
    t = t.select("method_uid", idx.alias("idx"), "off", "mnemonic", "operands", raw.alias("raw_hex"))
    line = F.rtrim(F.concat(F.lit("// ["), "idx", F.lit("] "), "off", F.lit(" ("), "raw_hex", F.lit("): "), "mnemonic", F.lit(" "), "operands"))
    return t.select("method_uid", "idx", "off", "raw_hex", line.alias("line"))


def branch_target(off, operands):
    """Absolute byte offset that a branch's last operand names, from an offset in code units."""
    sign, digits = F.regexp_extract(operands, r"([+-])([0-9a-f]+)h\s*$", 1), F.regexp_extract(operands, r"([+-])([0-9a-f]+)h\s*$", 2)
    units = F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")
    return F.when(sign != "", off + 2 * F.when(sign == "-", -units).otherwise(units))


def absolute_branches(ins: DataFrame) -> DataFrame:
    """Instructions with absolute targets in their operands, as cfg takes them."""
    t = branch_target(F.col("off"), F.col("operands"))
    jumps = F.col("mnemonic").rlike("^(goto|if-)")
    return ins.withColumn("operands", F.when(jumps & t.isNotNull(), F.concat(F.regexp_replace("operands", r"[+-][0-9a-f]+h\s*$", ""), t.cast("string"))).otherwise(F.col("operands")))


def switch_cases(code: DataFrame, ins: DataFrame) -> DataFrame:
    """method_uid, off (of the switch), case_value, target, as cfg takes them."""
    ship(code.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = [(uid, off, *x) for uid, insns, off, target in t[["method_uid", "insns", "off", "target"]].itertuples(index=False) for x in cases_of(bytes(insns), int(off), int(target))]
            yield pd.DataFrame(rows, columns=["method_uid", "off", "case_value", "target"])

    sw = ins.where(F.col("mnemonic").isin("packed-switch", "sparse-switch")).select("method_uid", "off", branch_target(F.col("off"), F.col("operands")).alias("target"))
    return sw.join(code.select("method_uid", "insns"), "method_uid").mapInPandas(run, "method_uid long, off long, case_value int, target long")
