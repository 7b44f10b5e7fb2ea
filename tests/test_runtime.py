"""Tables written to the shared folder."""

import time

from pyspark.sql import functions as F

from bytelens.runtime import RELEASE, Scratch, delete_path, fresh_path, materialize


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_the_write(spark):
    """Nothing that a step has shuffled stays on the disk for the steps after it, and the session is as it was."""
    rows = spark.range(20_000).repartition(5, "id").groupBy((F.col("id") % 100).alias("g")).agg(F.count("*").alias("n"))
    path = fresh_path(spark, "plain")
    before, own = shuffled(spark), spark.conf.get(RELEASE, None)
    rows.write.parquet(path)
    assert shuffled(spark) - before  # as Spark leaves them
    delete_path(spark, path)
    before = shuffled(spark)
    with Scratch(spark) as s:
        out = [s.write(rows, "scratch"), s.keep(rows, "kept"), materialize(rows, "table")]
        until = time.time() + 20
        while (left := shuffled(spark) - before) and time.time() < until:
            time.sleep(0.2)
        assert not left and spark.conf.get(RELEASE, None) == own
        assert all(t.agg(F.count("*"), F.sum("n")).collect()[0][:] == (100, 20_000) for t in out)
