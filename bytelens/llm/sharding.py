"""Sharding by size-tiered compaction: arrivals become small immutable shards, similarly sized shards are merged into
target-sized files, and a versioned manifest is committed atomically.

A dataset is a folder: data/ holds shard folders, each of Parquet files that never change, and
_manifests/ holds v00000001.json and so on, the list of live files with bytes, rows and tier. A reader takes
the highest version; a writer prepares files, writes the next manifest and makes it visible in one step,
which fails if another writer was first (it then reloads, re-plans and tries again). How that step is made depends on the
store. commit="rename" writes under another name and renames, for stores whose rename refuses an existing target (HDFS,
local disks, ABFS with a hierarchical namespace). commit="create" writes the manifest under its own name with overwrite
forbidden, for object stores that create conditionally and show an object only when it is whole (GCS, S3A with
conditional creation). On other stores one writer at a time may be at work.

After a commit, manifests that have been out of date for a day go, and the files that only they name with them: a reader that has
taken a version has that long to read it. retain_s sets another time; keep goes by count instead and removes all but the last `keep`
versions at once, which is for a single writer whose readers take no older ones. A merge that finds a file gone, because another
writer with a shorter time has removed it, reloads and plans again. Files of a writer that died before its commit are in no manifest: clean() removes those that have
reached an age no running writer's files have.

Merging reads whole files and writes one file in one task of bounded size, without a shuffle; the driver
handles file names and sizes only. Empty arrivals commit an unchanged list. All columns and rows pass through as they are:
nulls in any column, repeated rows, texts of any length, and columns of any name.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

PER_JOB = 64


class Dataset:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, keep: int | None = None, retain_s: float | None = None, commit: str = "rename"):
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self.keep, self.retain_s = keep or 1, retain_s if retain_s is not None else 86400.0 if keep is None else 0.0
        if commit not in ("rename", "create"):
            raise ValueError("commit is rename or create")
        self.how = commit
        self.jvm = spark.sparkContext._jvm
        root = self._p(self.path)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._p(f"{self.path}/_manifests"))

    def _p(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, path: str) -> list[tuple[str, int]]:
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._p(path)))

    # -- manifests

    def version(self) -> int:
        return max([int(n[1:-5]) for n, _ in self._list(f"{self.path}/_manifests") if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "files": []}
        try:
            stream = self.fs.open(self._p(f"{self.path}/_manifests/v{v:08d}.json"))
        except Py4JJavaError:
            if version is None and self.version() > v:  # superseded and removed in the meantime
                return self.manifest()
            raise
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, schema: str | None, files: list[dict]) -> dict | None:
        """The new manifest; None if another writer has committed that version."""
        v = base["version"] + 1
        made = {"version": v, "schema": schema, "files": sorted(files, key=lambda f: f["path"])}
        data = bytearray(json.dumps(made).encode())
        final = self._p(f"{self.path}/_manifests/v{v:08d}.json")
        if self.version() >= v:
            return None
        if self.how == "create":
            try:
                out = self.fs.create(final, False)
                out.write(data)
                out.close()
            except Py4JJavaError:
                return None
            return made
        tmp = self._p(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        out.write(data)
        out.close()
        if not self.fs.rename(tmp, final):
            self.fs.delete(tmp, False)
            return None
        return made

    # -- files

    def _tier(self, size: int) -> int:
        """0 for a full file; tier k holds files under target / fan_in ** (k - 1) bytes."""
        return 0 if 4 * size >= 3 * self.target else max(1, 1 + int(math.log(self.target / max(1, size), self.fan_in)))

    def _written(self, folder: str) -> list[dict]:
        rel = folder[len(self.path) + 1 :]
        sizes = {n: size for n, size in self._list(folder) if n.startswith("part-")}
        rows = {r[0]: r[1] for r in self.spark.read.parquet(folder).groupBy("_metadata.file_name").agg(F.count("*")).collect()} if sizes else {}
        return [{"path": f"{rel}/{n}", "bytes": size, "rows": rows.get(n, 0), "tier": self._tier(size)} for n, size in sizes.items()]

    def append(self, arrivals: DataFrame) -> dict:
        """Each task's rows become one small shard; nothing is moved between tasks."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        arrivals.write.option("compression", "zstd").parquet(folder)
        new = [f for f in self._written(folder) if f["rows"]]
        while True:
            base = self.manifest()
            if made := self.commit(base, base["schema"] or arrivals.schema.json(), base["files"] + new):
                self._vacuum(made["version"])
                return made

    def plan(self, files: list[dict], everything: bool = False) -> list[list[dict]]:
        """Groups to merge: neighbours in size of one tier, until a group has the target's bytes; a short group
        waits for more arrivals unless `everything` is asked for, when the tiers' remainders meet."""
        out, rest = [], []
        for tier in sorted({f["tier"] for f in files if f["tier"]}, reverse=True):
            group: list[dict] = []
            for f in sorted(rest + [f for f in files if f["tier"] == tier], key=lambda f: (f["bytes"], f["path"])):
                group.append(f)
                if sum(x["bytes"] for x in group) >= self.target:
                    out.append(group)
                    group = []
            if everything:
                rest = group
            else:
                rest = []
                if len(group) >= self.fan_in:
                    out.append(group)
        if len(rest) > 1:
            out.append(rest)
        return [g for g in out if len(g) > 1]

    def compact(self, everything: bool = False) -> dict:
        while True:
            base = self.manifest()
            groups = self.plan(base["files"], everything)
            if not groups:
                return base
            made: list[dict] = []
            gone = {f["path"] for g in groups for f in g}
            folders = []
            try:
                for i in range(0, len(groups), PER_JOB):
                    folders.append(f"{self.path}/data/{uuid.uuid4().hex}")
                    out = None
                    for g in groups[i : i + PER_JOB]:
                        one = self._read(base, [f["path"] for f in g]).coalesce(1)
                        out = one if out is None else out.union(one)
                    out.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(folders[-1])
                    made += self._written(folders[-1])
                new = self.commit(base, base["schema"], [f for f in base["files"] if f["path"] not in gone] + made)
            except (PySparkException, Py4JJavaError):
                if self.version() == base["version"]:  # nobody has removed what it read
                    raise
                new = None
            if new:
                self._vacuum(new["version"])
                return new
            for folder in folders:
                self.fs.delete(self._p(folder), True)

    def _vacuum(self, v: int) -> None:
        """Removes manifests older than the last `keep` up to v that have been out of date for retain_s, and the files that only they name."""
        status = {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(self._p(f"{self.path}/_manifests"))}
        since = {int(n[1:-5]): t for n, t in status.items() if n.startswith("v") and n.endswith(".json")}
        before = 1000 * (time.time() - self.retain_s)
        have = sorted(since)
        old = [k for k, after in zip(have, have[1:]) if k <= v - self.keep and since[after] <= before]
        if not old:
            return
        try:
            live = {f["path"] for k in have if k not in old for f in self.manifest(k)["files"]}
            for k in old:
                for p in {f["path"] for f in self.manifest(k)["files"]} - live:
                    self.fs.delete(self._p(f"{self.path}/{p}"), False)
                self.fs.delete(self._p(f"{self.path}/_manifests/v{k:08d}.json"), False)
        except Py4JJavaError:  # another writer is removing the same manifests
            return

    def clean(self, older_than_s: float = 7 * 86400.0) -> int:
        """Removes files that no manifest names and that are older than any running writer can be; how many."""
        live = {f["path"] for n, _ in self._list(f"{self.path}/_manifests") if n.startswith("v") for f in self.manifest(int(n[1:-5]))["files"]}
        gone, before = 0, 1000 * (time.time() - older_than_s)
        for folder in self.fs.listStatus(self._p(f"{self.path}/data")):
            name = folder.getPath().getName()
            for f in self.fs.listStatus(folder.getPath()):
                if f"data/{name}/{f.getPath().getName()}" not in live and f.getModificationTime() <= before:
                    self.fs.delete(f.getPath(), True)
                    gone += 1
            if not self.fs.listStatus(folder.getPath()):
                self.fs.delete(folder.getPath(), True)
        return gone

    def _read(self, m: dict, paths: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(m["schema"]))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one if none is given)."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing has been appended")
        return self._read(m, [f["path"] for f in m["files"]])


def digest(ds: Dataset) -> DataFrame:
    """doc_id, n_bytes and text_sha256 of every row, read back by way of the manifest."""
    return ds.read().select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
