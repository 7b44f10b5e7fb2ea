"""Scans of instructions as they arrive: calls that a detector names, each found once.

Only what a single instruction shows can be found in a stream; flows need whole methods and stay batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelens.operators.dataflow import invoke_map
from bytelens.operators.detectors import pattern_table


def invoke_findings(arrivals: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """category, method_uid, sink_off, sink_desc, arrived: calls matching plain detectors. arrivals: method_uid, off, mnemonic,
    operands, arrived (timestamp). A finding that comes again within the watermark is dropped; state is bounded by it."""
    patterns = F.broadcast(pattern_table(arrivals.sparkSession).where("role = 'invoke'").select("category", "pattern"))  # a few dozen rows
    calls = invoke_map(arrivals.withColumn("method_uid", F.struct("method_uid", "arrived"))).select("method_uid.*", "off", "method_ref")
    found = calls.join(patterns, F.col("method_ref").contains(F.col("pattern")))
    out = found.select("category", "method_uid", F.col("off").alias("sink_off"), F.col("method_ref").alias("sink_desc"), "arrived")
    return out.withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["category", "method_uid", "sink_off"])


def write_findings(findings: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends findings to a Parquet folder until what has arrived is done."""
    return findings.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
