"""Basic blocks and edges from instructions; reachability, dominators, orders.

Branch operands are absolute byte offsets here. Leaders come from window flags and one join of branch targets;
block ids are running sums, so membership is an equi-key, not a range join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from bytelens.operators.bymethod import NONE, by_method, groups, tagged

EXITS = r"^(return.*|throw)$"
SWITCHES = ("packed-switch", "sparse-switch")


def branch_targets(ins: DataFrame) -> DataFrame:
    """method_uid, off, target for gotos and conditionals."""
    m = F.col("mnemonic")
    return ins.where(m.startswith("goto") | m.startswith("if-")).select("method_uid", "off", F.regexp_extract("operands", r"(-?\d+)\s*$", 1).cast("long").alias("target"))


def placed(ins: DataFrame) -> DataFrame:
    """Instructions (branch operands absolute) with block_id, dealt by method. One exchange: what groups or windows by method and
    anything else afterwards needs no other."""
    m = F.col("mnemonic")
    branch = m.startswith("goto") | m.startswith("if-")
    ends = branch | m.rlike(EXITS) | m.isin(*SWITCHES)
    target = F.when(branch, F.regexp_extract("operands", r"(-?\d+)\s*$", 1).try_cast("long"))
    own = F.struct(F.col("off").alias("at"), F.struct("mnemonic", "operands").alias("row"), ends.alias("ends"), F.lit(False).alias("is_target"))
    mark = F.struct(target.alias("at"), F.lit(None).cast("struct<mnemonic:string,operands:string>").alias("row"), F.lit(None).cast("boolean").alias("ends"), F.lit(True).alias("is_target"))
    t = ins.repartition("method_uid").select("method_uid", F.inline(F.filter(F.array(own, mark), lambda x: x["at"].isNotNull())))
    t = t.groupBy("method_uid", "at").agg(F.max("row").alias("row"), F.max("ends").alias("ends"), F.max("is_target").alias("is_target")).where("row IS NOT NULL")
    w = W.partitionBy("method_uid").orderBy("at")
    t = t.withColumn("head", F.col("is_target") | F.coalesce(F.lag("ends").over(w), F.lit(True)))
    return t.select("method_uid", (F.sum(F.col("head").cast("long")).over(w) - 1).alias("block_id"), F.col("at").alias("off"), "row.mnemonic", "row.operands")


def blocks(ins: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """method_uid, block_id, start_off, end_off (exclusive), end_kind, last_off, target. cases: method_uid, off (of the
    switch), case_value, target; a row for each case. A switch ends its block whether its cases are given or not."""
    t = branch_targets(ins)
    leaders = t.select("method_uid", F.col("target").alias("off"))
    if cases is not None:
        leaders = leaders.union(cases.select("method_uid", F.col("target").alias("off")))
    leaders = leaders.withColumn("is_target", F.lit(True)).distinct()
    w = W.partitionBy("method_uid").orderBy("off")
    ends = F.col("mnemonic").startswith("goto") | F.col("mnemonic").startswith("if-") | F.col("mnemonic").rlike(EXITS) | F.col("mnemonic").isin(*SWITCHES)
    x = ins.join(leaders, ["method_uid", "off"], "left").join(t, ["method_uid", "off"], "left")
    x = x.withColumn("head", F.coalesce("is_target", F.lit(False)) | F.coalesce(F.lag(ends).over(w), F.lit(True)))
    x = x.withColumn("block_id", F.sum(F.col("head").cast("long")).over(w) - 1)
    last = lambda c: F.max_by(c, "off")
    out = x.groupBy("method_uid", "block_id").agg(F.min("off").alias("start_off"), F.max("off").alias("last_off"), last("mnemonic").alias("m"), last("target").alias("target"), F.max("code_end").alias("code_end"))
    end = F.coalesce(F.lead("start_off").over(W.partitionBy("method_uid").orderBy("block_id")), "code_end")
    kind = F.when(F.col("m").startswith("goto"), "goto").when(F.col("m").startswith("if-"), "conditional").when(F.col("m").rlike(EXITS), "exit").when(F.col("m").isin(*SWITCHES), "switch").otherwise("fallthrough")
    return out.select("method_uid", "block_id", "start_off", end.alias("end_off"), kind.alias("end_kind"), "last_off", "target")


def edges(blocks: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """method_uid, from_id, to_id, edge_kind; with cases (as for blocks) also case_value, null but for cases. A missing
    fall-through or target falls to no edge at the code's end. A switch has an edge for each case, to the block that
    holds its target, and a default to the block that follows: a goto there is a block of its own. A case outside
    the code makes no edge."""
    to = blocks.select("method_uid", F.col("start_off").alias("target"), F.col("block_id").alias("to_id"))
    b = blocks.select("method_uid", F.col("block_id").alias("from_id"), "end_off", "end_kind", "target")
    jump = b.where("end_kind in ('goto', 'conditional')").join(to, ["method_uid", "target"]).select("method_uid", "from_id", "to_id", F.when(F.col("end_kind") == "goto", "goto").otherwise("taken").alias("edge_kind"))
    next_kind = F.when(F.col("end_kind") == "switch", "default").otherwise("fall")
    fall = b.where("end_kind in ('fallthrough', 'conditional', 'switch')").drop("target").withColumnRenamed("end_off", "target").join(to, ["method_uid", "target"]).select("method_uid", "from_id", "to_id", next_kind.alias("edge_kind"))
    out = jump.union(fall)
    if cases is None:
        return out
    from bytelens.operators.dataflow import membership

    switch = blocks.where("end_kind = 'switch'").select("method_uid", F.col("block_id").alias("from_id"), F.col("last_off").alias("off"))
    holds = membership(cases.select("method_uid", F.col("target").alias("off")).distinct(), blocks).select("method_uid", F.col("off").alias("target"), F.col("block_id").alias("to_id"))
    inside = blocks.groupBy("method_uid").agg(F.max("end_off").alias("code_end"))
    case = switch.join(cases, ["method_uid", "off"]).join(holds, ["method_uid", "target"]).join(inside, "method_uid").where("target < code_end")
    kind = cases.schema["case_value"].dataType
    return out.withColumn("case_value", F.lit(None).cast(kind)).union(case.select("method_uid", "from_id", "to_id", F.lit("case").alias("edge_kind"), "case_value"))


def fall_through(blocks: DataFrame) -> DataFrame:
    """method_uid, block_id, next_id: the block whose start is this one's end."""
    a, b = blocks.select("method_uid", "block_id", F.col("end_off").alias("off")), blocks.select("method_uid", F.col("block_id").alias("next_id"), F.col("start_off").alias("off"))
    return a.join(b, ["method_uid", "off"]).select("method_uid", "block_id", "next_id")


def loop_headers(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of edges that go strictly backwards."""
    s = blocks.select("method_uid", F.col("block_id").alias("from_id"), F.col("start_off").alias("from_off"))
    t = blocks.select("method_uid", F.col("block_id").alias("to_id"), F.col("start_off").alias("to_off"))
    return edges.join(s, ["method_uid", "from_id"]).join(t, ["method_uid", "to_id"]).where("to_off < from_off").select("method_uid", F.col("to_id").alias("block_id")).distinct()


def fall_through_predecessors(blocks: DataFrame) -> DataFrame:
    """method_uid, block_id, prev_id: blocks that end where this one starts, however they end."""
    return fall_through(blocks).select("method_uid", F.col("next_id").alias("block_id"), F.col("block_id").alias("prev_id"))


def reachable(edges: DataFrame, starts: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """method_uid, block_id (and another column of starts, which keeps searches apart) reachable from starts (method_uid, block_id and
    at most one more, of whole numbers), themselves included. Blocks of exclude (the columns of starts) are reached but not left."""
    keys = starts.columns
    extra = [c for c in keys if c not in ("method_uid", "block_id")]
    if len(extra) > 1:
        raise ValueError("starts have one column more at most")
    ask = lambda t: t.select("method_uid", "block_id", *(extra or [F.lit(0).alias("search")])).distinct()
    parts = [edges.select("method_uid", "from_id", "to_id").distinct(), ask(starts)] + ([] if exclude is None else [ask(exclude)])

    def work(x: dict[str, np.ndarray]) -> list[np.ndarray]:
        part, a, b = x["part"], x["a"], x["b"]
        succ = groups(a[part == 0], b[part == 0])
        first, stop = groups(b[part == 1], a[part == 1]), groups(b[part == 2], a[part == 2])
        out: tuple[list[int], list[int]] = ([], [])
        for search, own in first.items():
            closed, seen, stack = set(stop.get(search, ())), set(own), list(own)
            while stack:
                n = stack.pop()
                if n not in closed:
                    new = [c for c in succ.get(n, ()) if c not in seen]
                    seen.update(new)
                    stack += new
            out[0].extend(sorted(seen))
            out[1].extend([search] * len(seen))
        return [np.array(out[0], np.int64), np.array(out[1], np.int64)]

    got = by_method(tagged(*parts), work, ["block_id", extra[0] if extra else "search"])
    return got.select(*[F.col(c).cast(starts.schema[c].dataType) for c in keys])


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (method_uid, start, target, and exclude, a block that is not entered, or null) with found: whether the target is reached from the start. The target counts even if it is
    excluded, as does a start that is the target. A search ends as soon as its target is met; searches of one start share nothing, so each is as short as it can be."""
    asked = pairs.select("method_uid", "start", "target", *(["exclude"] if "exclude" in pairs.columns else [F.lit(None).cast("long").alias("exclude")])).distinct()

    def work(x: dict[str, np.ndarray]) -> list[np.ndarray]:
        part = x["part"]
        succ = groups(x["a"][part == 0], x["b"][part == 0])
        a, b, c = (x[k][part == 1].tolist() for k in "abc")
        found = []
        for start, target, closed in zip(a, b, c):
            hit, seen, front = start == target, {start}, [] if start == closed else [start]
            while front and not hit:
                front = [n for f in front for n in succ.get(f, ())]
                hit = target in front
                front = [n for n in dict.fromkeys(front) if n not in seen and n != closed]
                seen.update(front)
            found.append(hit)
        return [np.array(v, np.int64) for v in (a, b, c, found)]

    got = by_method(tagged(edges.select("method_uid", "from_id", "to_id").distinct(), asked), work, ["start", "target", "exclude", "found"])
    return got.select("method_uid", "start", "target", "exclude", (F.col("found") == 1).alias("found"))


def loop_bodies(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """method_uid, header, block_id: the blocks of each natural loop, its header included: those that reach a strictly
    backward edge into the header without passing it."""
    s = blocks.select("method_uid", F.col("block_id").alias("from_id"), F.col("start_off").alias("from_off"))
    t = blocks.select("method_uid", F.col("block_id").alias("to_id"), F.col("start_off").alias("to_off"))
    back = edges.join(s, ["method_uid", "from_id"]).join(t, ["method_uid", "to_id"]).where("to_off < from_off")
    latches = back.select("method_uid", F.col("to_id").alias("header"), F.col("from_id").alias("block_id")).distinct()
    headers = latches.select("method_uid", "header", F.col("header").alias("block_id")).distinct()
    reverse = edges.select("method_uid", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return reachable(reverse, latches.union(headers), headers)


def postorder(succ: dict[int, list[int]], entry: int) -> list[int]:
    """Depth-first order of leaving, children in the order of the edges."""
    seen, out, stack = {entry}, [], [(entry, iter(succ.get(entry, ())))]
    while stack:
        for c in stack[-1][1]:
            if c not in seen:
                seen.add(c)
                stack.append((c, iter(succ.get(c, ()))))
                break
        else:
            out.append(stack.pop()[0])
    return out


def dominators(succ: dict, entry) -> dict:
    """Immediate dominators of the reachable nodes, the entry's None. In reverse post-order a dominator comes first, so
    two candidates meet by climbing from whichever is later; passes go on until none changes."""
    order = postorder(succ, entry)[::-1]
    at = {n: i for i, n in enumerate(order)}
    pred: list[list[int]] = [[] for _ in order]
    for n in order:
        for c in succ.get(n, ()):
            pred[at[c]].append(at[n])
    up: list[int | None] = [0] + [None] * (len(order) - 1)
    changed = True
    while changed:
        changed = False
        for i in range(1, len(order)):
            best = None
            for p in pred[i]:
                if up[p] is None:
                    continue
                if best is None:
                    best = p
                while best != p:
                    if best > p:
                        best = up[best]
                    else:
                        p = up[p]
            if best != up[i]:
                up[i], changed = best, True
    return {n: order[up[i]] if i else None for i, n in enumerate(order)}


def graph_facts(edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """method_uid, block_id, rpo (from 1), idom (null for the entry, block 0), of blocks reachable from block 0; a
    method without edges has its entry, or no row without blocks. Depth-first: targets before what follows, cases by value."""
    value = (F.col("case_value") if "case_value" in edges.columns else F.lit(None)).cast("long")  # a payload's order
    e = edges.select("method_uid", "from_id", F.when(F.col("edge_kind").isin("fall", "default"), 1).otherwise(0).alias("ord"), F.coalesce(value, F.lit(0)).alias("case_value"), "to_id")
    if blocks is not None:
        e = e.union(blocks.where("block_id = 0").select("method_uid", F.lit(-1), F.lit(0), F.lit(0), F.lit(-1)))

    def work(x: dict[str, np.ndarray]) -> list[np.ndarray]:
        real = x["a"] >= 0
        succ = groups(x["a"][real], x["d"][real])  # rows come sorted
        order = postorder(succ, 0)[::-1]
        dom = dominators(succ, 0)
        return [np.array(order), np.arange(1, len(order) + 1), np.array([NONE if dom[n] is None else dom[n] for n in order], np.int64)]

    return by_method(tagged(e, columns=("a", "b", "c", "d")), work, ["block_id", "rpo", "idom"])
