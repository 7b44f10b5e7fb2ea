"""Connected components of an edge table by hash-to-min with shortcuts; labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytelens.runtime import Scratch


def components(s: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of an edge in edges(a, b); comp is the smallest node of the component.

    A round gives each node the smallest label among its neighbours and itself, then the label of its label, until
    none falls any more. Each round is written to the shared folder and the one before it deleted. No node's neighbours are gathered: only
    minima travel."""
    both = s.write(edges.select("a", "b").where("a != b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    labels = s.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        new = s.write(hop.join(up, "mid", "left").select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("comp")), "cc-labels")
        s.drop(labels)
        labels = new
        if not new.where("old != comp").limit(1).count():
            s.drop(both)
            return new.select("node", "comp")
