"""What operators need from the session: code on the executors, a folder all machines share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(prefix="bytelens-"), "bytelens_pkg.zip")
        with open(path, "wb") as f:
            f.write(data.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, as in tests, a local master gets a
    temporary folder; any other master must set it, as executors don't see the driver's disk."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="bytelens-shared-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


_written: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete every table this process has written to the shared folder. Call it when nothing that was returned is read any more:
    results are lazy and may read such tables."""
    while _written:
        delete_path(spark, _written.pop())


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """A new table of the rows in the shared folder, and its path. The write's shuffle files go as soon as it is done: else they all stay until the
    driver happens to collect its garbage, so that a long job of many steps holds what it has ever shuffled."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives a lost executor."""
    return written(df, tag)[0]


class Scratch:
    """An operator's intermediate tables in the shared folder. drop deletes those that nothing reads any more, and leaving
    the block all but those kept: what an operator returns may read only kept tables and its inputs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = written(df, tag)
        self.paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """Write a table that stays after the block: a result, or what a lazy result reads."""
        return materialize(df, tag)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if got := self.paths.pop(id(t), None):
                delete_path(self.spark, got[1])

    def __exit__(self, *_) -> None:
        self.drop(*(t for t, _ in list(self.paths.values())))


class Rounds:
    """A table that grows by rounds: each round's new rows are written once, as a folder of their own, and never again."""

    def __init__(self, first: DataFrame, tag: str):
        self.spark, self.schema, self.tag = first.sparkSession, first.schema, tag
        self.paths: list[str] = []
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        """The rows of a round; they are the front now."""
        seen = Observation()
        self.paths.append(fresh_path(self.spark, self.tag))
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(self.paths[-1])
        self.size = seen.get["n"]
        self.front = self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def drop(self) -> None:
        """Delete the rounds; nothing may read them any more."""
        while self.paths:
            delete_path(self.spark, self.paths.pop())


KEY = ("__file", "__at")


def file_keys(df: DataFrame) -> DataFrame:
    """For rows read straight from files: with __file and __at, a row's file and its place there, which together are a
    key of its own whatever its columns hold. Rows that don't lie in files stay as they are."""
    if not df.inputFiles():
        return df
    try:
        return df.select("*", F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:  # a format without row numbers, or more than one scan
        return df


def keyed(df: DataFrame, tag: str) -> DataFrame:
    """The rows with __file and __at. Where file_keys has not set them the rows are written once, so that their keys stay."""
    if set(KEY) <= set(df.columns):
        return df
    return materialize(df.withColumn("__file", F.lit(0).cast("long")).withColumn("__at", F.monotonically_increasing_id()), tag)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
