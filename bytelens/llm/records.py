"""Token sequences as length-delimited binary records, with an offset index for shuffled reads.

A data file is a row of frames: length (u64), masked checksum of the length's bytes (u32), payload, masked checksum of the
payload (u32), little-endian. A checksum is zlib's CRC-32, turned right by 15 bits plus 0xA282EAD8, so that a file that holds
other files' checksums is checked as well. The payload is one document: kind of id (0 none, 1 number, 2 text), the id (i64, or
u32 length and UTF-8), bytes in a token id (2 or 4), the token ids. Beside each data file lies its index: for each record the
offset of its frame, the tokens of the file before it and its number of tokens, three u64.

Documents are dealt by ranges of their id and sorted in a task, which encodes them and writes one data file and one index to the
folder all machines share. A task that runs twice leaves a file that nothing names: what counts is the manifest, a table with a row
for each file, written at the end; it has the number of tokens in all files before each. Readers take files from the manifest, a task
each, and check every frame.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from bytelens.llm.encoding import ByteBpe, in_worker
from bytelens.runtime import KEY, delete_path, keyed, ship

BATCH, ENTRY = 4 << 20, np.dtype([("offset", "<u8"), ("first", "<u8"), ("tokens", "<u8")])
_FILES = "part long, file string, records long, tokens long, bytes long"


class Broken(ValueError):
    """A frame whose length or checksum is wrong."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload of an open file; None at its end."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise Broken("a record's length")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise Broken("a record's payload")
    return body[:n]


def pack(own: int | str | None, ids: bytes, width: int) -> bytes:
    if own is None:
        head = b"\0"
    elif isinstance(own, int):
        head = struct.pack("<Bq", 1, own)
    else:
        head = struct.pack("<BI", 2, len(x := own.encode())) + x
    return head + bytes([width]) + ids


def unpack(payload: bytes) -> tuple[int | str | None, np.ndarray]:
    kind, at, own = payload[0], 1, None
    if kind == 1:
        own, at = struct.unpack_from("<q", payload, 1)[0], 9
    elif kind == 2:
        at = 5 + struct.unpack_from("<I", payload, 1)[0]
        own = payload[5:at].decode()
    return own, np.frombuffer(payload, "<u2" if payload[at] == 2 else "<u4", offset=at + 1)


def _open(path: str, mode: str):
    """A file of the shared folder, by its URI, from a task: the local file system or any that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_output_stream(at) if mode == "w" else system.open_input_file(at)


def _writer(folder: str, sent, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = in_worker(sent.value, ".json", ByteBpe)
        end = b"" if end_id is None else np.array([end_id], bpe.kind).tobytes()
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, held, size, at, tokens, rows = None, [], 0, 0, 0, []
        for batch in batches:
            for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if out is None:
                    out = _open(f"{folder}/{part:08d}-{name}.rec", "w")
                ids = bpe.encode(text.as_py() or "") + end
                held.append(data := frame(pack(own, ids, bpe.kind.itemsize)))
                n = len(ids) // bpe.kind.itemsize
                rows.append((at, tokens, n))
                at, tokens, size = at + len(data), tokens + n, size + len(data)
                if size > BATCH:
                    out.write(b"".join(held))
                    held, size = [], 0
        if out is not None:
            out.write(b"".join(held))
            out.close()
            with _open(f"{folder}/{part:08d}-{name}.idx", "w") as f:
                f.write(np.array(rows, ENTRY).tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{part:08d}-{name}"], "records": [len(rows)], "tokens": [tokens], "bytes": [at]})

    return run


class Records:
    """A set of record files in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ship(spark), path

    @staticmethod
    def write(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int | None = 0) -> Records:
        """Encode and write the rows of docs (doc_id, text) in ascending doc_id order; end_id goes after each document's ids,
        unless it is None.

        Ids that are integers stay numbers, others are put down as text and ordered as they are. Null ids come last; rows of one id lie
        together, in the order of their files and places (docs from runtime.file_keys; others are written once); null and empty texts
        are documents of the end id only. A long text is one record. An empty table gives a manifest without files. Other columns are not read,
        whatever their names."""
        out = Records(docs.sparkSession, path)
        with open(tokenizer_path, "rb") as f:
            sent = out.spark.sparkContext.broadcast(f.read())
        docs = keyed(docs.select("doc_id", "text", *(c for c in KEY if c in docs.columns)), "records-keyed")
        order = [F.col("doc_id").asc_nulls_last(), *KEY]
        number = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
        dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("long" if number else "string"), "text")
        out._make("data")
        dealt.mapInArrow(_writer(f"{path}/data", sent, end_id), _FILES).write.parquet(f"{path}/written")
        files = out.spark.read.schema(_FILES).parquet(f"{path}/written")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        files = files.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"), F.lit(number).alias("number"))
        files.coalesce(1).write.parquet(f"{path}/manifest")
        delete_path(out.spark, f"{path}/written")
        out._sweep()
        return out

    def _files(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _make(self, name: str) -> None:
        fs, p = self._files(name)
        fs.mkdirs(p)

    def _sweep(self) -> None:
        """Delete the files of attempts that are not in the manifest."""
        named = {r[0] for r in self.manifest().select("file").collect()}  # a name for each file
        fs, p = self._files("data")
        for s in fs.listStatus(p):
            if s.getPath().getName().rpartition(".")[0] not in named:
                fs.delete(s.getPath(), False)

    def manifest(self) -> DataFrame:
        """part, file, records, tokens, bytes, first (tokens in all files before), number (whether ids are integers)."""
        return self.spark.read.schema(f"{_FILES}, first long, number boolean").parquet(f"{self.path}/manifest")

    def _kind(self) -> str:
        return "string" if self.manifest().where("not number").limit(1).count() else "long"

    def _spread(self) -> DataFrame:
        files = self.manifest()
        return files.repartitionByRange(max(1, min(files.count(), 20_000)), "part")

    def read(self) -> DataFrame:
        """doc_id, start (tokens of all documents before), ids (binary: little-endian u32 each), from the files in order, every frame
        checked."""
        kind, folder = self._kind(), f"{self.path}/data"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    held, size, at, seen = [], 0, row["first"], 0
                    with _open(f"{folder}/{row['file']}.rec", "r") as raw:
                        f = pa.BufferedInputStream(raw, 1 << 20)
                        while (payload := read_frame(f)) is not None:
                            own, ids = unpack(payload)
                            held.append((own, at, ids.astype("<u4").tobytes()))
                            at, size, seen = at + len(ids), size + 4 * len(ids), seen + 1
                            if size > BATCH:
                                yield _rows(held, kind)
                                held, size = [], 0
                    if seen != row["records"]:
                        raise Broken(f"{row['file']}: {seen} records of {row['records']}")
                    if held:
                        yield _rows(held, kind)

        return self._spread().select("file", "records", "first").mapInArrow(run, f"doc_id {kind}, start long, ids binary")

    def index(self) -> DataFrame:
        """file, offset (of the frame), start, tokens of every record, from the index files."""
        folder = f"{self.path}/data"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    with _open(f"{folder}/{row['file']}.idx", "r") as f:
                        while data := f.read(ENTRY.itemsize << 16):
                            e = np.frombuffer(data, ENTRY)
                            start = e["first"].astype(np.int64) + row["first"]
                            yield pa.RecordBatch.from_pydict({"file": [row["file"]] * len(e), "offset": e["offset"].astype(np.int64), "start": start, "tokens": e["tokens"].astype(np.int64)})

        return self._spread().select("file", "first").mapInArrow(run, "file string, offset long, start long, tokens long")

    def read_shuffled(self, seed: int, *, at_once: int = 1024) -> DataFrame:
        """The rows of read(), dealt to tasks and put in order by a hash of seed and place: the same rows in the same order for one seed and
        number of partitions. A task fetches at_once records at a time by their offsets, file by file."""
        kind, folder = self._kind(), f"{self.path}/data"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, at_once):
                    rows = batch.slice(lo, at_once).to_pylist()
                    got: list = [None] * len(rows)
                    last, f = None, None
                    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["file"], rows[i]["offset"])):
                        if rows[i]["file"] != last:
                            if f is not None:
                                f.close()
                            last, f = rows[i]["file"], _open(f"{folder}/{rows[i]['file']}.rec", "r")
                        f.seek(rows[i]["offset"])
                        own, ids = unpack(read_frame(f))
                        got[i] = (own, rows[i]["start"], ids.astype("<u4").tobytes())
                    if f is not None:
                        f.close()
                    yield _rows(got, kind)

        place = F.xxhash64(F.lit(seed), "file", "offset")
        return self.index().repartition(place).sortWithinPartitions(place).select("file", "offset", "start").mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def _rows(held: list[tuple], kind: str) -> pa.RecordBatch:
    own, start, ids = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64() if kind == "long" else pa.string()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
