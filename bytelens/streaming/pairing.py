"""Calls and their results as instructions arrive: state for each method, in whatever order its rows come.

A method's state is the offset that must come next, the call whose result has not been taken yet, and the rows that have come too early. A row is
worked off when all before it are there, so what is held is what a gap holds back, and the answers are those of dataflow.api_sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bytelens.operators.dataflow import callee, has_callee, registers
from bytelens.runtime import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairing(StatefulProcessor):
    """Rows (method_uid, off, size, ref, takes): ref is what an instruction calls, takes the register that takes a result."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next_off long, pending string")
        self.early = handle.getMapState("early", "off long", "size long, ref string, takes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, pending = (self.place.get() if self.place.exists() else (0, None))
        came: dict[int, tuple] = {}
        for part in rows:
            for off, size, ref, takes in part[["off", "size", "ref", "takes"]].itertuples(index=False):
                if off >= at:  # a row that comes again after it was worked off says nothing new
                    came[int(off)] = (int(size), None if pd.isna(ref) else str(ref), None if pd.isna(takes) else int(takes))
        out = []
        while True:
            row = came.pop(at, None)
            if self.early.containsKey((at,)):
                row = row or self.early.getValue((at,))
                self.early.removeKey((at,))
            if row is None:
                break
            size, ref, takes = row
            if takes is not None and pending is not None:
                out.append((key[0], at, takes, pending))
            pending, at = ref, at + size
        for off, row in came.items():
            self.early.updateValue((off,), row)
        self.place.update((at, pending))
        if out:
            yield pd.DataFrame(out, columns=["method_uid", "off", "reg", "method_ref"])

    def close(self) -> None:
        pass


def paired(arrivals: DataFrame) -> DataFrame:
    """A stream of method_uid, off, reg, method_ref (see dataflow.api_sources) from a stream of instructions (method_uid, off, size in bytes, mnemonic, operands), a method's first at 0. The session's state
    store must be RocksDB (use_store)."""
    spark = ship(arrivals.sparkSession)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == STORE, "call use_store first"
    takes = F.when(F.col("mnemonic").startswith("move-result"), registers(F.col("operands"))[0])
    t = arrivals.select("method_uid", "off", F.col("size").cast("long").alias("size"), F.when(has_callee(), callee(F.col("operands"))).alias("ref"), takes.alias("takes"))
    return t.groupBy("method_uid").transformWithStateInPandas(Pairing(), "method_uid long, off long, reg long, method_ref string", "Append", "None")


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
