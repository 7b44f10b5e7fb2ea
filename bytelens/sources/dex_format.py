"""spark.read.format("dex"): DEX files as a data source, and a sink that writes texts to files at their own paths.

    register(spark)
    spark.read.format("dex").option("table", "members").load("/apps/*.dex").where("class_name like 'com.app.%'")

A partition is a range of the classes of one file, so a large file is read by several tasks, or a run of small files; filters on class_name and on path
reach the reader, which leaves other classes' data unread. `table` is classes (the default), members, code, tries or
annotations. Files that are no DEX files have no rows; sources.dex.errors names them.
"""

from __future__ import annotations

import mmap
import os
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from bytelens.runtime import ship
from bytelens.sources.walk import NO_INDEX, annotation_types, leb, members, tries

CLASSES_PER_TASK = 2000
SMALL_PER_TASK = 4 << 20  # bytes of small files, which have no more classes than that each, whatever they hold: a class takes 32 bytes at least
_OWN = "path string, class_name string"
TABLES = {
    "classes": f"{_OWN}, super_name string, access_flags long",
    "members": f"{_OWN}, kind string, pos int, name string, type string, access_flags long, has_code boolean",
    "code": f"{_OWN}, method_name string, params array<string>, access_flags long, registers_size int, ins_size int, insns binary",
    "tries": f"{_OWN}, method_name string, try_id int, start long, end long, pos int, type string, handler_start long, handler_end long",
    "annotations": f"{_OWN}, pos int, name string",
}
# Letters of primitive types: fixed values of the format.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else os.path.abspath(path))


def java_name(descriptor: str) -> str:
    depth = len(descriptor) - len(descriptor.lstrip("["))
    own = descriptor[depth:]
    name = own[1:-1].replace("/", ".") if own.startswith("L") and own.endswith(";") else PRIMITIVES.get(own, own)
    return name + "[]" * depth


class Pools:
    """Look-ups by index in a file's tables; what an index names is read when it is asked for, None if it isn't there."""

    def __init__(self, data):
        self.data = data
        self.tables = {name: struct.unpack_from("<II", data, at) for name, at in (("string", 0x38), ("type", 0x40), ("proto", 0x48), ("field", 0x50), ("method", 0x58), ("class", 0x60))}

    def _record(self, table: str, width: int, form: str, i: int):
        n, at = self.tables[table]
        return struct.unpack_from(form, self.data, at + width * i) if 0 <= i < n and at + width * (i + 1) <= len(self.data) else None

    def string(self, i: int) -> str | None:
        try:
            at = self._record("string", 4, "<I", i)[0]
            _, at = leb(self.data, at)
            raw = bytes(self.data[at : self.data.find(b"\0", at)]).replace(b"\xc0\x80", b"\0")
            return raw.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        except (TypeError, IndexError, UnicodeDecodeError):
            return None

    def type(self, i: int) -> str | None:
        own = self._record("type", 4, "<I", i)
        text = self.string(own[0]) if own else None
        return None if text is None else java_name(text)

    def field(self, i: int) -> tuple[str | None, str | None]:
        own = self._record("field", 8, "<HHI", i)
        return (self.string(own[2]), self.type(own[1])) if own else (None, None)

    def method(self, i: int) -> tuple[str | None, str | None, list[str | None]]:
        """Name, return type, parameters."""
        own = self._record("method", 8, "<HHI", i)
        proto = self._record("proto", 12, "<III", own[1]) if own else None
        params: list = []
        if proto and proto[2] and proto[2] + 4 <= len(self.data):
            n = min(struct.unpack_from("<I", self.data, proto[2])[0], (len(self.data) - proto[2] - 4) // 2)
            params = [self.type(k) for k in struct.unpack_from(f"<{n}H", self.data, proto[2] + 4)]
        return (self.string(own[2]) if own else None), (self.type(proto[1]) if proto else None), params


def rows_of(table: str, path: str, p: Pools, first: int, last: int, wanted) -> Iterator[tuple]:
    data = p.data
    for d in range(first, last):
        own = p._record("class", 32, "<7I", d)
        name = p.type(own[0]) if own else None
        if not own or not wanted(name):
            continue
        if table == "classes":
            yield path, name, (None if own[2] == NO_INDEX else p.type(own[2])), own[1]
            continue
        if table == "annotations":
            for pos, kind in annotation_types(data, own[5]) if own[5] else ():
                if (full := p.type(kind)) is not None:
                    yield path, name, pos, full.rpartition(".")[2]
            continue
        for kind, pos, idx, flags, off in members(data, own[6]) if own[6] else ():
            if table == "members":
                called, ty = p.field(idx) if kind.endswith("field") else p.method(idx)[:2]
                yield path, name, kind, pos, called, ty, flags, off > 0
                continue
            if not off or off + 16 > len(data):
                continue
            registers, ins, _, n_tries, _, units = struct.unpack_from("<HHHHII", data, off)
            size = min(2 * units, len(data) - off - 16)
            called, _, params = p.method(idx)
            if table == "code":
                yield path, name, called, params, flags, registers, ins, bytes(data[off + 16 : off + 16 + size])
            elif n_tries:
                for i, start, end, at, kind_idx, handler, stop in tries(data, off + 16, size, n_tries):
                    yield path, name, called, i, start, end, at, None if kind_idx is None else p.type(kind_idx), handler, stop


@dataclass
class ClassRange(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class SmallFiles(InputPartition):
    paths: list[str]


class DexReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str):
        self.paths, self.table, self.pushed = paths, table, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("class_name",), ("path",)):
                self.pushed.append(f)
            else:
                yield f

    def _passes(self, column: str, value: str | None) -> bool:
        for f in self.pushed:
            if f.attribute == (column,):
                ok = value is not None and (value == f.value if isinstance(f, EqualTo) else value in f.value if isinstance(f, In) else value.startswith(f.value))
                if not ok:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Small files are not opened here: their tasks see whether they are DEX files."""
        from fnmatch import fnmatch

        from pyarrow import fs

        out: list[InputPartition] = []
        small, held = [], 0
        for path in self.paths:
            system, at = _system(path)
            pattern = re.search(r"[*?\[]", at)
            root = posixpath.dirname(at[: pattern.start()]) if pattern else at
            info = system.get_file_info(root)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
            prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
            for x in sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path):
                hidden = any(part[0] in "_." for part in posixpath.relpath(x.path, root).split("/") if part not in (".", ".."))
                uri = prefix + x.path
                if hidden or pattern and not fnmatch(x.path, at) or not self._passes("path", uri):
                    continue
                if x.size < 0x70:
                    continue
                if x.size < 32 * CLASSES_PER_TASK:
                    if small and held + x.size > SMALL_PER_TASK:
                        out.append(SmallFiles(small))
                        small, held = [], 0
                    small.append(uri)
                    held += x.size
                    continue
                with system.open_input_file(x.path) as f:
                    head = f.read(0x70)
                if head[:4] != b"dex\n":
                    continue
                n = min(struct.unpack_from("<I", head, 0x60)[0], x.size // 32)
                out += [ClassRange(uri, k, min(n, k + CLASSES_PER_TASK)) for k in range(0, n, CLASSES_PER_TASK)]
        if small:
            out.append(SmallFiles(small))
        return out or [SmallFiles([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, ClassRange):
            yield from self._rows(partition.path, partition.first, partition.last)
            return
        for path in partition.paths:
            yield from self._rows(path, 0, None)

    def _rows(self, path: str, first: int, last: int | None) -> Iterator[tuple]:
        """Rows of a range of a file's classes, or of all of them."""
        from pyarrow import fs

        def rows(data) -> Iterator[tuple]:
            if len(data) >= 0x70 and data[:4] == b"dex\n":
                end = min(struct.unpack_from("<I", data, 0x60)[0], len(data) // 32) if last is None else last
                yield from rows_of(self.table, path, Pools(data), first, end, lambda name: self._passes("class_name", name))

        system, at = _system(path)
        if isinstance(system, fs.LocalFileSystem):
            with open(at, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                yield from rows(data)
            return
        with system.open_input_file(at) as f:
            yield from rows(f.read())


class DexSource(DataSource):
    """Options: table; path or paths (load)."""

    @classmethod
    def name(cls) -> str:
        return "dex"

    def schema(self) -> str:
        table = self.options.get("table", "classes")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> DexReader:
        import json

        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return DexReader(paths, self.options.get("table", "classes"))


@dataclass
class Written(WriterCommitMessage):
    staged: list[tuple[str, str]]  # where a file lies, and the path it is meant for


class TreeWriter(DataSourceWriter):
    """Rows (path, text) to files below a folder: rows of one path follow each other in one task and are a file's lines in their order."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.folder}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, at = _system(self.staging)
        at = f"{at}/{uuid.uuid4().hex}"
        system.create_dir(at, recursive=True)
        done, known, out, last = [], set(), None, None
        try:
            for row in iterator:
                path, text = row[0], row[1]
                if path != last:
                    if out is not None:
                        out.close()
                    if path in known:
                        raise ValueError(f"rows of {path} don't follow each other")
                    parts = path.split("/")
                    if not path or path.startswith("/") or ".." in parts or parts[0].startswith("_staging-"):
                        raise ValueError(f"{path} leaves the folder")
                    done.append((f"{at}/{len(done)}", path))
                    known.add(path)
                    out, last = system.open_output_stream(done[-1][0]), path
                data = bytes(text) if isinstance(text, (bytes, bytearray)) else (text or "").encode() + b"\n"
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages) -> None:
        system, root = _system(self.folder)
        from pyarrow import fs

        files = [x for m in messages if m is not None for x in m.staged]
        if len({p for _, p in files}) < len(files):
            self.abort(messages)
            raise ValueError("two tasks have written one path: repartition by path first")
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if not x.base_name.startswith("_staging-"):
                    system.delete_dir(x.path) if x.type == fs.FileType.Directory else system.delete_file(x.path)
        for folder in {posixpath.dirname(f"{root}/{p}") for _, p in files}:
            system.create_dir(folder, recursive=True)
        for staged, path in files:
            system.move(staged, f"{root}/{path}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, at = _system(self.staging)
        from pyarrow import fs

        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class TreeSink(DataSource):
    """df (path, text) to files: text as a line of its file, or binary as it is. Nothing is visible in the folder before all tasks are done, and
    nothing stays of a job that fails. mode append adds files and replaces those of the same path; overwrite replaces the folder's content."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        kinds = [f.dataType.typeName() for f in schema.fields]
        if len(kinds) != 2 or kinds[0] != "string" or kinds[1] not in ("string", "binary"):
            raise ValueError("a tree is written from a path and a text or binary column")
        return TreeWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats dex and tree known to a session, and let filters reach Python readers."""
    ship(spark)
    spark.dataSource.register(DexSource)
    spark.dataSource.register(TreeSink)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
