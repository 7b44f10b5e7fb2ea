"""Work that is sequential inside a method: rows are dealt and sorted by method, and a task walks whole Arrow batches, method by method.

A method's code is bounded by the format (65,536 registers, 16-bit tables), so a method is what a task may hold; nothing is gathered beyond it.
One exchange does for a whole fixpoint, and nothing is written in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytelens.runtime import ship


def tagged(*tables: DataFrame, columns: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """One table of several: method_uid, part (the table's number), and its other columns as a, b, c (longs)."""
    out = None
    for part, t in enumerate(tables):
        own = [c for c in t.columns if c != "method_uid"]
        row = t.select("method_uid", F.lit(part).alias("part"), *[(F.col(own[i]).cast("long") if i < len(own) else F.lit(None).cast("long")).alias(c) for i, c in enumerate(columns)])
        out = row if out is None else out.union(row)
    return out


def by_method(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], list[np.ndarray]], columns: list[str], together: bool = False) -> DataFrame:
    """method_uid and long columns: what work makes of each method's rows, given as arrays by column (a null is the least long), sorted by all columns in their order.
    together: work gets the rows of many methods at once, each of them whole, and gives their method_uid first; for steps that arrays take for all of them."""
    ship(rows.sparkSession)
    names = rows.columns
    least = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            data = {c: np.asarray(table.column(c).cast(pa.int64()).fill_null(least).to_numpy()) for c in names}
            uid = data["method_uid"]
            if together:
                if len(uid) and len((got := work(data))[0]):
                    yield pack([got])
                return
            cut = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1], [True])))
            out: list[list[np.ndarray]] = []
            size = 0
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                got = work({c: data[c][lo:hi] for c in names})
                n = len(got[0]) if got else 0
                if n:
                    out.append([np.full(n, uid[lo], np.int64), *(np.asarray(x, np.int64) for x in got)])
                    size += n
                if size > 100_000:
                    yield pack(out)
                    out, size = [], 0
            if out:
                yield pack(out)

        def pack(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64(), mask=x == least) for x in whole], names=["method_uid", *columns])

        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column("method_uid").to_numpy(zero_copy_only=False)
            start = int(np.searchsorted(uid, uid[-1]))
            if start or (held and held[-1].column("method_uid")[-1].as_py() != uid[0]):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            held.append(batch.slice(start))
        if held:
            yield from done(pa.Table.from_batches(held))

    # Dealt by a hash of the key and not by the key: a deal by a key that both sides of a union are dealt by already is left out of the plan, and the
    # sides' partitions are then joined up to larger ones apart from each other, so that a method's rows would lie in two tasks.
    dealt = rows.repartition(F.xxhash64("method_uid")).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("method_uid", *columns)))


NONE = np.iinfo(np.int64).min


def groups(keys: np.ndarray, values: np.ndarray) -> dict[int, list[int]]:
    """Values by key, in their order."""
    out: dict[int, list[int]] = {}
    for k, v in zip(keys.tolist(), values.tolist()):
        out.setdefault(k, []).append(v)
    return out


def bits(x: int) -> list[int]:
    """Places of the bits that are set."""
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out
