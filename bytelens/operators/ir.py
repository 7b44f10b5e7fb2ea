"""Program passes as windows and semi-joins over read/write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def neighbours(ins: DataFrame) -> DataFrame:
    """The instructions before and after, in the same block: ins from cfg.placed."""
    w = W.partitionBy("method_uid", "block_id").orderBy("off")
    return ins.select("method_uid", "block_id", "off", F.lag("off").over(w).alias("prev_off"), F.lead("off").over(w).alias("next_off"))


def ssa_versions(rw: DataFrame) -> DataFrame:
    """Linear versions without phis, from 0 in each block: a write takes the next version of its register, a read the current one, 0
    before any write. rw of instructions from cfg.placed; without block_id a method is one block."""
    w = W.partitionBy("method_uid", *(["block_id"] if "block_id" in rw.columns else []), "reg").orderBy("off")
    is_write = F.when(F.col("is_write"), 1)
    now = F.count(is_write).over(w.rangeBetween(W.unboundedPreceding, 0))
    before = F.count(is_write).over(w.rangeBetween(W.unboundedPreceding, -1))
    return rw.withColumn("ver", F.when(F.col("is_write"), now).otherwise(before))


def dead_assignments(rw: DataFrame, use_def: DataFrame) -> DataFrame:
    used = use_def.select("method_uid", F.col("def_off").alias("off"), "reg")
    return rw.where("is_write").select("method_uid", "off", "reg").join(used, ["method_uid", "off", "reg"], "left_anti")


def dead_registers(rw: DataFrame) -> DataFrame:
    read = rw.where("not is_write").select("method_uid", "reg")
    return rw.where("is_write").select("method_uid", "off", "reg").distinct().join(read, ["method_uid", "reg"], "left_anti").select("method_uid", "off", "reg")


def register_names(rw: DataFrame, sources: DataFrame) -> DataFrame:
    """A name for each register of a method: a prefix by its role, numbered in order of first appearance."""
    res = sources.select("method_uid", "off", "reg", F.lit(True).alias("is_result"))
    t = rw.join(res, ["method_uid", "off", "reg"], "left").groupBy("method_uid", "reg").agg(F.min("off").alias("first_off"), F.max(F.coalesce(F.col("is_result") & F.col("is_write"), F.lit(False))).alias("r"))
    t = t.withColumn("prefix", F.when(F.col("r"), "result").otherwise("local"))
    nth = F.row_number().over(W.partitionBy("method_uid", "prefix").orderBy("first_off", "reg"))
    return t.select("method_uid", "first_off", "reg", "prefix", F.concat("prefix", nth.cast("string")).alias("name"))


def invoke_chain(ins: DataFrame) -> DataFrame:
    """Each invoke with the register that takes its result, where a move-result follows at once."""
    w = W.partitionBy("method_uid").orderBy("off")
    takes = F.lead("mnemonic").over(w).startswith("move-result")
    t = ins.withColumn("dst", F.when(takes, F.lead("operands").over(w))).withColumn("result_off", F.when(takes, F.lead("off").over(w)))
    return t.where(F.col("mnemonic").startswith("invoke-")).select("method_uid", "off", F.col("operands").alias("call"), "dst", "result_off")
