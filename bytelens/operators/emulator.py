"""Emulation of many methods at once: a round joins every running machine with its instruction and writes its next state.

A machine is a row: its place in the code, its registers (an array of structs), the last call's result and its console. All
machines take a step together; the trace is the table of all rounds. Values: Unset, Int, Str, Unknown. What is no int counts
as 0 in arithmetic and branches. Fields, arrays and switches are not emulated: reads give Unknown, writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytelens.functions import stubs
from bytelens.operators.dataflow import callee, has_callee
from bytelens.operators.statements import _once, call_arguments, operand
from bytelens.runtime import Rounds, materialize

VALUE = "struct<tag:string,i:int,s:string>"
_OPS = "add|sub|mul|div|rem|and|or|xor|shl|shr|ushr"
_BINARY = rf"^(r?sub|{_OPS})-int(/2addr|/lit8|/lit16)?$"


def value(tag: str, i: Column | None = None, s: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(tag).alias("tag"), (none if i is None else i).cast("int").alias("i"), (none if s is None else s).cast("string").alias("s"))


def program(ins: DataFrame) -> DataFrame:
    """ins (method_uid, off, mnemonic, operands with absolute targets) with idx, the registers a, b, c, the literal, and target_idx: the
    instruction at a branch's target, or the next one after it; null past the end."""
    t = ins.withColumn("idx", F.row_number().over(W.partitionBy("method_uid").orderBy("off")).cast("int") - 1)
    target = F.when(F.col("mnemonic").rlike("^(goto|if-)"), F.regexp_extract("operands", r"(-?\d+)\s*$", 1).try_cast("long"))
    reg = lambda i: F.regexp_extract(F.coalesce(operand(F.col("operands"), i), F.lit("")), r"^v(\d+)$", 1).try_cast("int")
    last = F.regexp_extract("operands", r"(-?\d+)\s*$", 1).try_cast("long")
    t = t.select("method_uid", "off", "idx", "mnemonic", "operands", reg(1).alias("a"), reg(2).alias("b"), reg(3).alias("c"), stubs.wrap_int(last).cast("int").alias("lit"), target.alias("target"))
    # an as-of join as a window: the least instruction at or after each target
    both = t.select("method_uid", F.col("off").alias("at"), F.col("idx").alias("found"), F.lit(1).alias("what")).union(t.where("target is not null").select("method_uid", "target", F.lit(None).cast("int"), F.lit(0)).distinct())
    w = W.partitionBy("method_uid").orderBy("at", "what").rowsBetween(0, W.unboundedFollowing)
    ends = both.withColumn("found", F.first("found", ignorenulls=True).over(w)).where("what = 0").select("method_uid", F.col("at").alias("target"), F.col("found").alias("target_idx"))
    return t.join(ends, ["method_uid", "target"], "left")


def _result(ref: Column, args: Column, regs: Column) -> Column:
    """What a call gives: the scalar library's calls, else Unknown with the call's name."""
    arg = lambda k: F.get(regs, F.get(args, F.lit(k)))
    number = lambda k: F.coalesce(arg(k)["i"], F.lit(0))
    text = lambda k: F.coalesce(arg(k)["s"], F.lit(""))
    known = lambda name: ref.endswith(name)
    boolean = lambda c: value("Int", F.when(c, 1).otherwise(0))
    return (
        F.when(known("Math.max"), value("Int", F.greatest(number(0), number(1)))).when(known("Math.min"), value("Int", F.least(number(0), number(1)))).when(known("Math.abs"), value("Int", stubs.wrap_int(F.abs(number(0).cast("long")))))
        .when(known("Integer.parseInt"), value("Int", stubs.parse_int(text(0)))).when(known("String.length"), value("Int", stubs.string_length(text(0)))).when(known("String.isEmpty"), boolean(text(0) == ""))
        .when(known("String.equals"), boolean(text(0) == text(1))).when(known("String.contains"), boolean(F.contains(text(0), text(1)))).when(known("String.startsWith"), boolean(F.startswith(text(0), text(1)))).when(known("String.endsWith"), boolean(F.endswith(text(0), text(1))))
        .when(known("String.concat"), value("Str", s=F.concat(text(0), text(1)))).when(known("String.trim"), value("Str", s=stubs.trim(text(0)))).when(known("String.toUpperCase"), value("Str", s=F.upper(text(0)))).when(known("String.toLowerCase"), value("Str", s=F.lower(text(0))))
        .when(ref.rlike(r"Log\.[diwev]$"), value("Int", F.lit(0))).otherwise(value("Unknown", s=F.concat(F.lit("result of "), ref)))
    )


def _printed(ref: Column, args: Column, regs: Column) -> Column:
    text = lambda k: F.coalesce(F.get(regs, F.get(args, F.lit(k)))["s"], F.get(regs, F.get(args, F.lit(k)))["i"].cast("string"), F.lit("null"))
    log = F.concat(F.lit("[Log."), F.regexp_extract(ref, r"Log\.([diwev])$", 1), F.lit("] "), text(0), F.lit(": "), text(1))
    return F.when(ref.endswith("PrintStream.println"), F.concat(text(1), F.lit("\n"))).when(ref.endswith("PrintStream.print"), text(1)).when(ref.rlike(r"Log\.[diwev]$"), log).otherwise(F.lit(""))


def run(ins: DataFrame, machines: DataFrame, *, max_steps: int = 10_000) -> DataFrame:
    """The trace: method_uid, step, off, idx (of the next instruction; null at the end), regs, result, console, status (running, finished,
    error or limit), returned, error; a row for each machine and step, step 0 its start. machines: method_uid, registers_size,
    params (array of values, which go to the highest registers; those beyond registers_size are left out)."""
    code = materialize(program(ins), "emulator-code")
    n, p = F.col("registers_size"), F.size("params")
    start = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= n - F.least(n, p), F.get(F.col("params"), i - n + F.least(n, p))).otherwise(value("Unset")))).otherwise(F.array().cast(f"array<{VALUE}>"))
    kind = f"method_uid long, step int, off long, idx int, regs array<{VALUE}>, result {VALUE}, console string, status string, returned {VALUE}, error string"
    spark = ins.sparkSession
    none = F.lit(None).cast(VALUE)
    first = machines.select("method_uid", F.lit(0).alias("step"), F.lit(None).cast("long").alias("off"), F.lit(0).alias("idx"), start.cast(f"array<{VALUE}>").alias("regs"), none.alias("result"), F.lit("").alias("console"), F.lit("running").alias("status"), none.alias("returned"), F.lit(None).cast("string").alias("error"))
    trace = Rounds(spark.createDataFrame([], kind).union(first), "emulator")
    for step in range(1, max_steps + 1):
        running = trace.front.where("status = 'running'")
        trace.add(_step(running, code, step, max_steps).select(*trace.schema.names))
        if not trace.size or not trace.front.where("status = 'running'").limit(1).count():
            break
    return trace.all()


def _step(running: DataFrame, code: DataFrame, step: int, max_steps: int) -> DataFrame:
    t = running.drop("off", "step").join(code.drop("target"), ["method_uid", "idx"], "left")
    m, regs = F.col("mnemonic"), F.col("regs")
    at = lambda r: F.coalesce(F.get(regs, F.col(r))["i"], F.lit(0))
    t = t.select("*", at("a").alias("va"), at("b").alias("vb"), at("c").alias("vc"), F.coalesce("lit", F.lit(0)).alias("vl"), F.regexp_extract(m, r"^(?:r(?=sub))?(\w+)-int", 1).alias("op"))
    swap, two, lits = m.startswith("rsub"), m.endswith("/2addr"), m.rlike("/lit(8|16)$|^rsub-int$")
    x = F.when(swap, F.col("vl")).when(two, F.col("va")).otherwise(F.col("vb"))
    y = F.when(swap, F.col("vb")).when(two, F.col("vb")).when(lits, F.col("vl")).otherwise(F.col("vc"))

    def arithmetic(op: Column, p: Column, q: Column) -> Column:
        out = None
        for name in _OPS.split("|"):
            e = stubs.int_op(name, p, q).cast("int")
            out = F.when(op == name, e) if out is None else out.when(op == name, e)
        return out

    binary, call = m.rlike(_BINARY), has_callee()
    args = F.transform(F.split(call_arguments(F.col("operands")), ", "), lambda r: F.substring(r, 2, 9).try_cast("int"))
    t = t.withColumn("sum", F.when(binary, _once(arithmetic, op=F.col("op"), p=x, q=y))).withColumn("bad", binary & F.col("op").isin("div", "rem") & (y == 0))
    t = t.withColumn("called", F.when(call, _once(_result, ref=callee(F.col("operands")), args=args, regs=regs))).withColumn("said", F.when(call, _once(_printed, ref=callee(F.col("operands")), args=args, regs=regs)))
    text = F.regexp_replace(F.trim(F.regexp_replace("operands", r"^[^,]*,", "")), '^"|"$', "")
    written = (
        F.when(m.rlike("^const(/4|/16|/high16)?$"), value("Int", F.col("lit"))).when(m.startswith("const-string"), value("Str", s=text)).when(m.rlike("^move(-wide|-object)?(/from16|/16)?$"), F.get(regs, F.col("b")))
        .when(binary & ~F.col("bad"), value("Int", F.col("sum"))).when(m == "neg-int", value("Int", stubs.wrap_int(-F.col("vb").cast("long")))).when(m == "not-int", value("Int", -F.col("vb").cast("long") - 1))
        .when(m == "int-to-byte", value("Int", stubs.to_byte(F.col("vb")))).when(m == "int-to-short", value("Int", stubs.to_short(F.col("vb")))).when(m == "int-to-char", value("Int", stubs.to_char(F.col("vb"))))
        .when(m.startswith("move-result"), F.coalesce("result", value("Unknown"))).when(m.rlike("^(iget|sget|aget|move-exception|array-length|new-|instance-of|const-class|const-wide)"), value("Unknown"))
    )
    t = t.withColumn("written", written)
    zero = F.when(m.endswith("z"), F.lit(0)).otherwise(F.col("vb"))
    cond = F.regexp_extract(m, "^if-(eq|ne|lt|ge|gt|le)", 1)
    a = F.col("va")
    taken = F.when(cond == "eq", a == zero).when(cond == "ne", a != zero).when(cond == "lt", a < zero).when(cond == "ge", a >= zero).when(cond == "gt", a > zero).when(cond == "le", a <= zero).otherwise(m.startswith("goto"))
    ends = m.isNull() | m.startswith("return") | (m == "throw")
    following = F.when(ends | F.col("bad"), F.lit(None).cast("int")).when(taken, F.col("target_idx")).otherwise(F.col("idx") + 1)
    status = F.when(F.col("bad"), "error").when(ends | (taken & F.col("target_idx").isNull()), "finished").when(F.lit(step >= max_steps), "limit").otherwise("running")
    new = F.when(F.col("written").isNotNull(), F.transform(regs, lambda v, i: F.when(i == F.col("a"), F.col("written")).otherwise(v))).otherwise(regs)
    return t.select(
        "method_uid", F.lit(step).alias("step"), "off", following.alias("idx"), new.alias("regs"), F.when(call, F.col("called")).otherwise(F.col("result")).alias("result"), F.concat("console", F.coalesce("said", F.lit(""))).alias("console"),
        status.alias("status"), F.when(m.startswith("return") & (m != "return-void"), F.get(regs, F.col("a"))).alias("returned"), F.when(F.col("bad"), "division by zero").alias("error"),
    )
