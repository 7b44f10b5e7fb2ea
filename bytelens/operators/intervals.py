"""Joins of ranges by equality: no pair of ranges meets only because they share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bytelens.operators.dataflow import membership


def _level(start: Column, end: Column) -> Column:
    """The power of two that is the least at or above a range's length."""
    return F.ceil(F.log2(F.greatest(end - start, F.lit(1).cast("long")))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[str, str], right_range: tuple[str, str], top: int | None = None) -> DataFrame:
    """Rows of left and right (other columns of different names) of equal keys whose ranges [start, end) overlap, each pair once. Empty ranges and null
    bounds overlap nothing; bounds are whole numbers below 2**50.

    A range has a level, the power of two at or above its length, and lies in one or two cells of that size. Two ranges that overlap
    share a cell of the longer one's level: the one that holds the later of their starts. So the longer one waits in the cells of its own level, and every range visits the
    cells it touches at its own and each higher level that occurs on the other side, up to top. A cell holds ranges that begin within its length, so in
    a cell few pairs fail the last test."""
    (a, b), (c, d) = left_range, right_range
    ok = lambda t, s, e: t.where((F.col(s) < F.col(e)))
    one = ok(left, a, b).withColumn("__l", _level(F.col(a), F.col(b)))
    two = ok(right, c, d).withColumn("__r", _level(F.col(c), F.col(d)))
    if top is None:
        row = one.agg(F.max("__l").alias("m")).union(two.agg(F.max("__r"))).agg(F.max("m")).collect()[0][0]
        top = row if row is not None else 0

    def waiting(t: DataFrame, s: str, e: str, level: str) -> DataFrame:
        return t.withColumn("__level", F.col(level)).withColumn("__cell", F.explode(F.sequence(_cell(F.col(s), F.col(level)), _cell(F.col(e) - 1, F.col(level)))))

    def visiting(t: DataFrame, s: str, e: str, level: str, least: Column) -> DataFrame:
        steps = F.when(least <= top, F.sequence(least, F.lit(top))).otherwise(F.array().cast("array<int>"))
        t = t.withColumn("__level", F.explode(steps))
        return t.withColumn("__cell", F.explode(F.sequence(_cell(F.col(s), F.col("__level")), _cell(F.col(e) - 1, F.col("__level")))))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        t = x.join(y, [*keys, "__level", "__cell"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
        return t.where(_cell(F.greatest(F.col(a), F.col(c)), F.col("__level")) == F.col("__cell"))

    # the left one is at least as long in level; then the right one is longer
    first = met(waiting(one, a, b, "__l"), visiting(two, c, d, "__r", F.col("__r")).where("__level >= __r"))
    second = met(visiting(one, a, b, "__l", F.col("__l") + 1), waiting(two, c, d, "__r"))
    columns = [*keys, *(x for x in left.columns if x not in keys), *(x for x in right.columns if x not in keys)]
    return first.select(*columns).union(second.select(*columns))


def tries_of_blocks(tries: DataFrame, blocks: DataFrame) -> DataFrame:
    """method_uid, try_id, block_id: the blocks that each try range (start, end) overlaps. Blocks follow each other, so a try covers those from the one
    that holds its start to the one that holds its last byte: as many rows as come out."""
    t = tries.select("method_uid", "try_id", "start", "end").distinct().where("start < end")
    inside = blocks.groupBy("method_uid").agg(F.min("start_off").alias("lo"), F.max("end_off").alias("hi"))
    t = t.join(inside, "method_uid").select("method_uid", "try_id", F.greatest("start", "lo").alias("first"), (F.least("end", "hi") - 1).alias("last")).where("first <= last")
    ends = t.select("method_uid", F.col("first").alias("off")).union(t.select("method_uid", F.col("last"))).distinct()
    at = membership(ends, blocks)
    t = t.join(at.select("method_uid", F.col("off").alias("first"), F.col("block_id").alias("one")), ["method_uid", "first"]).join(at.select("method_uid", F.col("off").alias("last"), F.col("block_id").alias("two")), ["method_uid", "last"])
    return t.select("method_uid", "try_id", F.explode(F.sequence("one", "two")).alias("block_id"))
