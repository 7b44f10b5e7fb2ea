"""Register reads and writes, invokes, API results, reaching definitions, taint closures.

Tables are keyed by method_uid; offsets are longs. Everything is a join or a window on method keys, so a
run covers all methods at once; fixpoints run inside a task, method by method, on rows that are dealt by method once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bytelens.operators.bymethod import bits, by_method, groups, tagged

# Mnemonics by effect on registers: fixed values. Forms not listed have no effect (wide moves, unary
# operations, conversions, compares, /2addr, lit16, typed array access).
_BIN = "add|sub|mul|div|rem|and|or|xor|shl|shr|ushr"
WRITE_FIRST_READ_REST = rf"^(move|move/from16|move/16|move-object|({_BIN})-(int|long)|(add|sub|mul|div|rem)-(float|double)|(rsub|add|mul|div|rem|and|or|xor|shl|shr|ushr)-int/lit8|aget|new-array|instance-of|iget(-.*)?)$"
WRITE_FIRST = r"^(move-result(-wide|-object)?|const/4|const/16|const|const-string(/jumbo)?|const-class|new-instance|sget(-.*)?)$"
READ_ALL = r"^(aput|iput(-.*)?|invoke-.*|if-(eq|ne|lt|ge|gt|le)z?|(packed|sparse)-switch|return(-wide|-object)?|throw|sput(-.*)?)$"


def operand_list(operands: Column) -> Column:
    return F.transform(F.split(operands, ","), lambda x: F.trim(x))


def registers(operands: Column) -> Column:
    return F.transform(F.filter(operand_list(operands), lambda x: x.rlike(r"^v\d+$")), lambda x: F.substring(x, 2, 9).cast("long"))


def rw_sets(ins: DataFrame) -> DataFrame:
    """method_uid, off, reg, is_write, pos: a row for each register an instruction writes or reads; pos keeps
    the order of the operands. block_id stays where instructions have it."""
    m = F.col("mnemonic")
    ins = ins.withColumns({"__regs": registers(F.col("operands")), "__both": m.rlike(WRITE_FIRST_READ_REST)})  # named twice, made once
    r, both = F.col("__regs"), F.col("__both")
    first, rest = F.slice(r, 1, 1), F.slice(r, 2, 255)
    none = F.array().cast("array<long>")
    writes = F.when(both | m.rlike(WRITE_FIRST), first).otherwise(none)
    reads = F.when(both, rest).when(m.rlike(READ_ALL), r).otherwise(none)
    pairs = F.concat(
        F.transform(writes, lambda x, i: F.struct(x.alias("reg"), F.lit(True).alias("is_write"), i.cast("long").alias("pos"))),
        F.transform(reads, lambda x, i: F.struct(x.alias("reg"), F.lit(False).alias("is_write"), i.cast("long").alias("pos"))),
    )
    return ins.select("method_uid", *(["block_id"] if "block_id" in ins.columns else []), "off", F.inline(pairs))


def callee(operands: Column) -> Column:
    """The method an invoke calls: after the last comma outside the parameters, without them."""
    return F.regexp_extract(operands, r",\s*([^,(]+)(\(.*)?$", 1)


def has_callee() -> Column:
    """An invoke without argument registers has no comma, and so no callee here."""
    return F.col("mnemonic").startswith("invoke-") & F.col("operands").contains(",")


def invoke_map(ins: DataFrame) -> DataFrame:
    return ins.where(has_callee()).select("method_uid", "off", callee(F.col("operands")).alias("method_ref"))


def api_sources(ins: DataFrame) -> DataFrame:
    """method_uid, off, reg, method_ref: a move-result right after an invoke takes the invoke's result."""
    w = W.partitionBy("method_uid").orderBy("off")
    t = ins.withColumn("before", F.lag(F.when(has_callee(), callee(F.col("operands")))).over(w))
    return t.where(F.col("mnemonic").startswith("move-result") & F.col("before").isNotNull()).select("method_uid", "off", registers(F.col("operands"))[0].alias("reg"), F.col("before").alias("method_ref"))


def linear_use_def(rw: DataFrame) -> DataFrame:
    """method_uid, use_off, reg, def_off: the last write before each read, in the order of offsets."""
    w = W.partitionBy("method_uid", "reg").orderBy("off").rangeBetween(W.unboundedPreceding, -1)
    t = rw.withColumn("def_off", F.max(F.when(F.col("is_write"), F.col("off"))).over(w))
    return t.where(~F.col("is_write") & F.col("def_off").isNotNull()).select("method_uid", F.col("off").alias("use_off"), "reg", "def_off").distinct()


def reaching_use_def(rw: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """method_uid, use_off, reg, def_off over all paths: in a block the last write before the use; else every
    definition that reaches the block. A block passes a definition on unless it writes the register.

    blocks: method_uid, block_id, start_off, end_off (exclusive). edges: method_uid, from_id, to_id. A method's definitions are the bits of a
    number: what reaches a block is a union, what a block stops a mask, and a worklist of blocks runs until nothing changes."""
    parts = tagged(blocks.select("method_uid", "start_off", "block_id"), edges.select("method_uid", "from_id", "to_id").distinct(), rw.select("method_uid", "off", "reg", F.col("is_write").cast("long")))
    return by_method(parts, _reach, ["use_off", "reg", "def_off"]).distinct()


def _reach(x: dict[str, np.ndarray]) -> list[np.ndarray]:
    part = x["part"]
    starts, ids = x["a"][part == 0], x["b"][part == 0]  # sorted by start
    succ = groups(x["a"][part == 1], x["b"][part == 1])
    off, reg, write = (x[c][part == 2] for c in "abc")
    at = np.searchsorted(starts, off, "right") - 1
    inside = at >= 0
    off, reg, write, block = off[inside], reg[inside], write[inside] == 1, ids[at[inside]]
    d_off, d_reg, d_block = (v[write].tolist() for v in (off, reg, block))
    of_reg: dict[int, int] = {}
    last: dict[int, dict[int, int]] = {}
    for i, (r, b) in enumerate(zip(d_reg, d_block)):  # by offset: the last one of a block stays
        of_reg[r] = of_reg.get(r, 0) | 1 << i
        last.setdefault(b, {})[r] = i
    gen = {b: sum(1 << i for i in own.values()) for b, own in last.items()}
    kill = {b: 0 for b in last}
    for b, own in last.items():
        for r in own:
            kill[b] |= of_reg[r]
    into: dict[int, int] = {}
    work = list(gen)
    queued = set(work)
    while work:
        b = work.pop()
        queued.discard(b)
        out = (into.get(b, 0) & ~kill.get(b, 0)) | gen.get(b, 0)
        for c in succ.get(b, ()):
            have = into.get(c, 0)
            if out & ~have:
                into[c] = have | out
                if c not in queued:
                    queued.add(c)
                    work.append(c)
    uses: tuple[list[int], list[int], list[int]] = ([], [], [])
    now: dict[tuple[int, int], int] = {}
    known: dict[tuple[int, int], list[int]] = {}
    rows = sorted(zip(off.tolist(), write.tolist(), reg.tolist(), block.tolist()))  # reads before writes of one instruction
    for o, is_write, r, b in rows:
        if is_write:
            now[b, r] = o
            continue
        own = now.get((b, r))
        if own is None:
            if (b, r) not in known:
                known[b, r] = [d_off[i] for i in bits(into.get(b, 0) & of_reg.get(r, 0))]
            found = known[b, r]
        else:
            found = [own]
        uses[0].extend([o] * len(found))
        uses[1].extend([r] * len(found))
        uses[2].extend(found)
    return [np.array(u, np.int64) for u in uses]


def membership(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """method_uid, off, block_id: blocks of a method partition its code, so the block is the last start at or
    before the offset; a window over both, no range join."""
    both = offsets.select("method_uid", "off", F.lit(None).cast("long").alias("block_id"), F.lit(1).alias("what")).union(blocks.select("method_uid", "start_off", F.col("block_id").cast("long"), F.lit(0)))
    w = W.partitionBy("method_uid").orderBy("off", "what").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("block_id", F.last("block_id", ignorenulls=True).over(w)).where("what = 1 and block_id is not null").select("method_uid", "off", "block_id")


def flow_edges(rw: DataFrame, use_def: DataFrame) -> DataFrame:
    """(method_uid, off, reg) to (to_off, to_reg): an instruction that reads a tainted definition taints all it writes."""
    writes = rw.where("is_write").select("method_uid", F.col("off").alias("to_off"), F.col("reg").alias("to_reg"))
    uses = use_def.select("method_uid", F.col("use_off").alias("to_off"), F.col("def_off").alias("off"), "reg")
    return uses.join(writes, ["method_uid", "to_off"]).select("method_uid", "off", "reg", "to_off", "to_reg").distinct()


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All tainted definitions: method_uid, seed_off, seed_reg, off, reg; the seed itself is one.

    seeds: method_uid, off, reg; edges as flow_edges gives them. Methods without a seed are left out before anything moves."""
    seeds = seeds.select("method_uid", "off", "reg").distinct()
    wanted = edges.join(seeds.select("method_uid").distinct(), "method_uid", "left_semi").select("method_uid", "off", "reg", "to_off", "to_reg")

    def work(x: dict[str, np.ndarray]) -> list[np.ndarray]:
        part = x["part"] == 0
        step: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in zip(*(x[k][part].tolist() for k in "abcd")):
            step.setdefault((a, b), []).append((c, d))
        out: list[tuple[int, int, int, int]] = []
        for seed in zip(x["a"][~part].tolist(), x["b"][~part].tolist()):
            seen, stack = {seed}, [seed]
            while stack:
                for n in step.get(stack.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        stack.append(n)
            out += [(*seed, *n) for n in seen]
        return list(np.array(out, np.int64).T) if out else []

    return by_method(tagged(wanted, seeds, columns=("a", "b", "c", "d")), work, ["seed_off", "seed_reg", "off", "reg"])


def tainted_reads(tainted: DataFrame, use_def: DataFrame) -> DataFrame:
    """method_uid, seed_off, seed_reg, off, reg: uses of tainted definitions."""
    u = use_def.select("method_uid", F.col("def_off").alias("off"), "reg", "use_off")
    return tainted.join(u, ["method_uid", "off", "reg"]).select("method_uid", "seed_off", "seed_reg", F.col("use_off").alias("off"), "reg").distinct()
