"""One walk over a DEX file's byte streams of variable width: class data, code items, tries with their handlers, annotations.

`walked` is a lateral join with a table function: each file's bytes go to Python once, whatever it holds, and what comes back
are rows of numbers and each method's code. Records of fixed width stay column functions (see sources.dex).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from bytelens.runtime import ship

#: Columns of a walk's rows; a part fills its own and leaves the others null.
ROW = (
    "part string, class_idx long, kind string, pos int, idx long, access_flags long, code_off long, registers_size long, ins_size long, tries_size long, insns_off long, insns binary, "
    "try_id int, start long, end long, type_idx long, handler_start long, handler_end long"
)
_NAMES = [c.strip().split(" ")[0] for c in ROW.split(",")]
KINDS = ("static_field", "instance_field", "direct_method", "virtual_method")
NO_INDEX = 0xFFFFFFFF


def leb(data: bytes, at: int, signed: bool = False) -> tuple[int, int]:
    """A LEB128 number and the offset after it; raises IndexError beyond the end."""
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            return (out - (1 << shift) if signed and b & 0x40 else out), at


def members(data: bytes, at: int) -> Iterator[tuple[str, int, int, int, int]]:
    """kind, pos, idx, access_flags, code_off of class data, in its order; what is cut off is left out."""
    try:
        sizes = []
        for _ in KINDS:
            n, at = leb(data, at)
            sizes.append(n)
        for kind, n in zip(KINDS, sizes, strict=True):
            idx = 0
            for pos in range(n):
                step, at = leb(data, at)
                flags, at = leb(data, at)
                code, at = leb(data, at) if kind.endswith("method") else (0, at)
                idx += step
                yield kind, pos, idx, flags, code
    except IndexError:
        return


def handler_lists(data: bytes, base: int) -> dict[int, list[tuple[int | None, int]]]:
    """By its place from base, each list's handlers: type (None for a catch-all) and address in bytes."""
    out: dict[int, list] = {}
    try:
        n, at = leb(data, base)
        for _ in range(n):
            own = out.setdefault(at - base, [])
            size, at = leb(data, at, signed=True)
            for _ in range(abs(size)):
                kind, at = leb(data, at)
                addr, at = leb(data, at)
                own.append((kind, 2 * addr))
            if size <= 0:
                addr, at = leb(data, at)
                own.append((None, 2 * addr))
    except IndexError:
        pass
    return out


def tries(data: bytes, at: int, size: int, count: int) -> Iterator[tuple[int, int, int, int, int | None, int, int]]:
    """try_id, start, end, pos, type, handler start and end of a method whose code of size bytes begins at an offset. A handler ends at
    the next boundary of the method's handlers, or at the code's end."""
    items = at + size + size % 4  # aligned to four bytes
    lists = handler_lists(data, items + 8 * count)
    rows = []
    for i in range(count):
        if items + 8 * i + 8 > len(data):
            break
        first, n, place = struct.unpack_from("<IHH", data, items + 8 * i)
        rows += [(i, 2 * first, 2 * (first + n), pos, kind, addr) for pos, (kind, addr) in enumerate(lists.get(place, ()))]
    bounds = sorted({r[-1] for r in rows})
    after = dict(zip(bounds, [*bounds[1:], size]))
    return ((*r, after[r[-1]]) for r in rows)


def annotation_types(data: bytes, directory: int) -> Iterator[tuple[int, int]]:
    """pos and type of the annotations of a class; entries that are cut off are left out."""
    if directory + 4 > len(data):
        return
    at = struct.unpack_from("<I", data, directory)[0]
    if not at or at + 4 > len(data):
        return
    n = min(struct.unpack_from("<I", data, at)[0], (len(data) - at - 4) // 4)
    for pos, item in enumerate(struct.unpack_from(f"<{n}I", data, at + 4)):
        try:
            yield pos, leb(data, item + 1)[0]  # an item: visibility, then its type
        except IndexError:
            continue


def walk(data: bytes, want: set[str], first: int = 0, last: int | None = None) -> Iterator[dict]:
    """Rows of the parts wanted (member, code, try, annotation) of the class definitions first to last (exclusive)."""
    count, table = struct.unpack_from("<II", data, 0x60)
    count = min(count, max(0, (len(data) - table) // 32))
    for d in range(first, count if last is None else min(last, count)):
        class_idx, _, _, _, _, notes, body = struct.unpack_from("<7I", data, table + 32 * d)
        if "annotation" in want and notes:
            for pos, kind in annotation_types(data, notes):
                yield {"part": "annotation", "class_idx": class_idx, "pos": pos, "type_idx": kind}
        if not body or not want - {"annotation"}:
            continue
        for kind, pos, idx, flags, off in members(data, body):
            own = {"class_idx": class_idx, "kind": kind, "pos": pos, "idx": idx, "access_flags": flags, "code_off": off}
            if "member" in want:
                yield {"part": "member", **own}
            if not off or off + 16 > len(data) or not want & {"code", "try"}:
                continue
            registers, ins, _, n_tries, _, units = struct.unpack_from("<HHHHII", data, off)
            size = min(2 * units, len(data) - off - 16)
            if "code" in want:
                yield {"part": "code", **own, "registers_size": registers, "ins_size": ins, "tries_size": n_tries, "insns_off": off + 16, "insns": data[off + 16 : off + 16 + size]}
            if "try" in want and n_tries:
                for i, start, end, at, type_idx, handler, stop in tries(data, off + 16, size, n_tries):
                    yield {"part": "try", **own, "pos": at, "try_id": i, "start": start, "end": end, "type_idx": type_idx, "handler_start": handler, "handler_end": stop}


@udtf(returnType=ROW)
class WalkFile:
    def eval(self, content, want):
        for row in walk(bytes(content), set(want.split(","))):
            yield tuple(map(row.get, _NAMES))


def walked(dex: DataFrame, *parts: str) -> DataFrame:
    """dex_id and the columns of ROW: the parts wanted of all readable files."""
    spark = ship(dex.sparkSession)
    spark.udtf.register("dex_walk", WalkFile)
    good = dex.where("error is null").select("dex_id", "content")
    return spark.sql("SELECT d.dex_id, w.* FROM {d} AS d, LATERAL dex_walk(d.content, {want}) AS w", d=good, want=",".join(parts))
