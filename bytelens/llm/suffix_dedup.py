"""Suffix-array removal of repeated byte strings across a corpus, partitioned by content.

A byte goes when it is covered by a string of `length` bytes that also starts anywhere else, in the same
document or another. A byte is shared when it is covered by a string of `short` bytes (at most `length`) that also
starts in another document: shorter passages that repeat are told so, not removed. Strings never cross documents.

1. Each string of `short` bytes is named by its minimizer, the smallest hash of its GRAM-byte pieces, so equal
   strings have equal minimizers at equal places. Consecutive starts with one minimizer form a run; its
   context is the bytes from the first start to `length` bytes after the last, or the text's end. Runs travel as
   hashes; those whose minimizer stands nowhere else fall away.
2. Equal contexts are repeated as a whole: counting decides, whatever the number of copies.
3. Minimizers that have several different contexts are decided by suffix arrays: their contexts meet in a task
   (whole groups, about CHUNK bytes at a time), a two-stage sort orders the suffixes to `length` bytes (only
   those smaller than their successors are sorted directly, the rest are induced by bucket scans), and a
   start is repeated where the common prefix with a neighbour reaches `length`, or `short`.
4. A group of more than group_limit contexts is never gathered: its runs are cut, for each of the two sizes by itself, into cells of 64,
   then 16, 4 and 1 starts, regrouped by the hash of the bytes that all strings of the cell share. Groups that have one kind of cell
   only are decided, as are cells whose bytes are equal as a whole: counting does, and one of them goes on for the others to
   meet. So only cells that an edge of what is shared lies in are cut again, a few for each context. Groups that have become small enough go to step 3.

Contexts, and strings that counts decide on, are compared by 128-bit hashes, suffixes by their bytes. Rows are told
apart by keys of their own, so doc_id may be null, may repeat and may be of any type. Null is the empty text; texts
shorter than `short` lose nothing; repeated rows repeat each other; an empty table gives no rows; other columns are not
read. A text of any length is read as a whole, in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytelens.llm import textcore as tc
from bytelens.runtime import KEY, Scratch, keyed, ship

GRAM, CHUNK = 64, 1 << 20
CODE_2 = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)


class Hashes:
    """Hashes of any substring of a buffer."""

    def __init__(self, buf: np.ndarray, code: np.ndarray = tc.BYTE_CODE):
        up, self.down = tc.powers(len(buf) + 1)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(code[buf] * up[: len(buf)], out=self.total[1:])

    def __call__(self, a, b) -> np.ndarray:
        return tc.mix((self.total[b] - self.total[a]) * self.down[a])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (van Herk and Gil-Werman)."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, short: int, length: int):
    """row, first start, number of starts, way from the first start to the minimizer, the context's size, the
    minimizer's hash, two context hashes; places within the row."""
    base = int(offs[lo])
    buf = data[base : offs[hi]]
    empty = np.empty(0, np.int64)
    if len(buf) < short:
        return (empty,) * 8
    h1 = Hashes(buf)
    starts = np.arange(len(buf) - GRAM + 1)
    grams = h1(starts, starts + GRAM)
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    keyed = (grams >> bits << bits) | starts.astype(np.uint64)
    least = window_minima(keyed, short - GRAM + 1)
    cuts = offs[lo : hi + 1] - base
    row = np.repeat(np.arange(hi - lo), np.diff(cuts))[: len(least)]
    inside = np.arange(len(least)) + short <= cuts[row + 1]
    key = np.where(inside, (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1)
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    n = np.diff(np.append(new, len(key)))
    ok = key[new] >= 0
    first, n = new[ok], n[ok]
    place, r = key[first], row[first]
    h2 = Hashes(buf, CODE_2)
    end = np.minimum(first + n - 1 + length, cuts[r + 1])
    # the place of the minimizer, the number of starts and the size belong to the context's name
    extra = (((place - first) * 65_537 + n) * 65_537 + end - first).astype(np.uint64)
    return r + lo, first - cuts[r], n, place - first, end - first, grams[place], tc.mix(h1(first, end) ^ extra * tc.MUL_A), tc.mix(h2(first, end) ^ extra * tc.MUL_B)


def _runs(short: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "first", "n", "lead", "size", "g", "c1", "c2"]
        for batch in batches:
            data, offs = tc.text_bytes(batch.column("text"))
            for lo, hi in tc.chunks(offs):
                r, *facts = runs_of(data, offs, lo, hi, short, length)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(r)) for c in KEY), *(pa.array(np.asarray(x).view(np.int64)) for x in facts)], names=names)

    return run


# ---- two-stage suffix sorting


def two_stage(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of text (values 0 to 255, ended by a unique smallest value is not needed) to `depth`
    bytes: suffixes equal that far stand side by side. wanted marks places: only their suffixes, and those that their
    order is induced from, are sorted and given back."""
    n = len(text)
    t = np.append(text.astype(np.int64) + 1, 0)
    # type S: smaller than the successor. The last character of each stretch of equals decides the stretch.
    less = t[:-1] < t[1:]
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)
    small = less[differs[at]]
    s = np.flatnonzero(small)
    if wanted is not None:  # a suffix that isn't sorted directly needs its successors up to one that is
        need = np.zeros(n + 1, np.int64)
        start = np.flatnonzero(wanted & ~small)
        stop = np.append(s, n - 1)[np.searchsorted(s, start)]
        np.add.at(need, start, 1)
        np.add.at(need, stop + 1, -1)
        wanted = wanted | (np.cumsum(need)[:n] > 0)
        s = s[wanted[s]]
    order_s = _sort_directly(text, s, depth)
    rank = np.zeros(n + 1, np.int64)  # the empty suffix ranks 0; larger is later
    by_char = t[order_s]
    lists: list[np.ndarray] = []
    larger = np.flatnonzero(~small if wanted is None else ~small & wanted)
    by_larger = larger[np.argsort(t[larger], kind="stable")]
    starts_l = np.searchsorted(t[by_larger], np.arange(1, 258))
    starts_s = np.searchsorted(by_char, np.arange(1, 258))
    run = differs[at] - np.arange(n)  # how many equal characters follow
    done = 0
    for c in range(256):  # a bucket holds its L suffixes, shorter stretches first, then its S suffixes
        own = by_larger[starts_l[c] : starts_l[c + 1]]
        if len(own):
            deep = run[own]
            order = np.argsort(deep, kind="stable")
            own, deep = own[order], deep[order]
            cut = np.flatnonzero(np.concatenate(([True], deep[1:] != deep[:-1], [True])))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                level = own[a:b]
                level = level[np.argsort(rank[level + 1], kind="stable")]
                rank[level] = np.arange(done + 1, done + 1 + len(level))
                done += len(level)
                lists.append(level)
        own = order_s[starts_s[c] : starts_s[c + 1]]
        rank[own] = np.arange(done + 1, done + 1 + len(own))
        done += len(own)
        lists.append(own)
    return np.concatenate(lists) if lists else np.empty(0, np.int64)


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first `depth` bytes. Eight bytes order most; of those that tie, suffixes whose
    hashes to `depth` agree go on as one, and a group of ties skips what all its members share (found by hashes too)."""
    if not len(at):
        return at
    depth = -(-depth // 8) * 8
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = lambda p: words[p].copy().view(">u8").ravel().astype(np.uint64)
    w = word(at)
    o = np.argsort(w, kind="stable")
    order, w = at[o], w[o]
    head = np.concatenate(([True], w[1:] != w[:-1]))
    tied = np.flatnonzero(~head | np.append(~head[1:], False))
    if not len(tied):
        return order
    hashes = Hashes(padded)
    group = np.cumsum(head) - 1
    p, g = order[tied], group[tied]
    whole = hashes(p, p + depth)
    o = np.lexsort((whole, g))
    p, g, whole = p[o], g[o], whole[o]
    new = np.concatenate(([True], (whole[1:] != whole[:-1]) | (g[1:] != g[:-1])))
    kind = np.cumsum(new) - 1  # suffixes of one kind are equal to `depth`
    rep, own = p[new], g[new]  # a representative of each kind, and its group
    place = np.arange(len(rep))  # representatives' kinds, in the order found so far
    first = np.concatenate(([True], own[1:] != own[:-1]))
    known = np.full(len(rep), 8)
    while True:
        live = np.flatnonzero(~first | np.append(~first[1:], False))
        if not len(live):
            break
        q = rep[place[live]]
        begin = first[live]
        nth = np.cumsum(begin) - 1
        anchor = q[begin][nth]
        low, high = known[live], np.full(len(live), depth)
        while (low < high).any():  # common prefix with the group's first, in steps of eight
            mid = np.minimum((low + high + 8) // 16 * 8, high)
            mid = np.where(mid <= low, np.minimum(low + 8, high), mid)
            same = hashes(q, q + mid) == hashes(anchor, anchor + mid)
            low, high = np.where(same & (low < high), mid, low), np.where(same, high, np.maximum(low, mid - 8))
        skip = np.minimum.reduceat(low, np.flatnonzero(begin))[nth]
        skip = np.minimum(skip, depth - 1) // 8 * 8
        w = word(q + skip)
        o = np.lexsort((w, nth))
        place[live] = place[live][o]
        w, g = w[o], nth[o]
        first[live] = np.concatenate(([True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])))
        known[live] = np.minimum(skip[o] + 8, depth)
        if (skip + 8 >= depth).all():
            break
    rank = np.empty(len(rep), np.int64)
    rank[place] = np.arange(len(rep))
    order[tied] = p[np.argsort(rank[kind], kind="stable")]
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, to `depth`, and to the ends of either's part
    of the text (ends has a value for each place; the text's end by default)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b, live = order[:-1], order[1:], np.arange(1, len(order))
    room = np.minimum(len(text) - np.maximum(a, b), depth)
    if ends is not None:
        room = np.minimum(room, np.minimum(ends[a] - a, ends[b] - b))
    for d in range(0, depth, 8):
        x = (words[a + d] ^ words[b + d]).view("<u8").ravel()
        same = x == 0
        low = x[~same] & (~x[~same] + np.uint64(1))
        zeros = (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        out[live[~same]] = d + zeros
        out[live[same]] = d + 8
        a, b, live = a[same], b[same], live[same]
        if not len(live):
            break
    out[1:] = np.minimum(out[1:], room)
    return out


def repeated_starts(rows: list[dict], short: int, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context (bytes, n, lo and hi: its least and greatest document, and what: the only size to look for, if not BOTH), which of
    its n starts begin a string of `length` bytes that begins at another start too, and which a string of `short` bytes that another document has."""
    text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    sizes = np.array([len(r["bytes"]) for r in rows], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(rows)), sizes)
    ends, within = at[owner + 1], np.arange(len(text)) - at[owner]
    starts = np.array([r["n"] for r in rows], np.int64)
    lo, hi, what = (np.array([r[c] for r in rows], np.int64) for c in ("lo", "hi", "what"))
    order = two_stage(text, length, within < starts[owner])
    out = []
    for kind, size in ((LONG, length), (SHORT, short)):
        asked = (what == kind) | (what == BOTH)
        own = order[(within[order] < starts[owner[order]]) & (within[order] + size <= sizes[owner[order]]) & asked[owner[order]]]
        hit = np.zeros(len(text), bool)
        if len(own) > 1:
            head = np.flatnonzero(common_prefixes(text, own, size, ends) < size)
            many = np.diff(np.append(head, len(own))) > 1
            if kind == SHORT:
                many &= np.minimum.reduceat(lo[owner[own]], head) != np.maximum.reduceat(hi[owner[own]], head)
            hit[own[np.repeat(many, np.diff(np.append(head, len(own))))]] = True
        out.append([np.flatnonzero(hit[a : a + n]) for a, n in zip(at[:-1].tolist(), starts.tolist(), strict=True)])
    return out[0], out[1]


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        cut = np.flatnonzero(np.concatenate(([True], np.diff(x) != 1, [True])))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(x[a]), int(x[b - 1]) + 1


LONG, SHORT, BOTH = 0, 1, 2  # what a found stretch of starts is, or what a row is searched for


def _sort_groups(short: int, length: int):
    """c1, c2, start from, to (exclusive), what, from rows (key, c1, c2, lo, hi, w0, n, what, bytes) sorted by key."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        got = repeated_starts(rows, short, length)
        out = [(r["c1"], r["c2"], r["w0"] + a, r["w0"] + b, what) for what in (LONG, SHORT) for r, x in zip(rows, got[what], strict=True) for a, b in _stretches(x)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], names=["c1", "c2", "from", "to", "what"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict] = []
        group: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if group and group[0]["key"] != r["key"]:
                    if len(group) > 1:
                        ready += group
                        size += sum(len(x["bytes"]) for x in group)
                    group = []
                    if size >= CHUNK:
                        yield solve(ready)
                        ready, size = [], 0
                group.append(r)
        if len(group) > 1:
            ready += group
        if ready:
            yield solve(ready)

    return run


WORK = ["key", "c1", "c2", "lo", "hi", "w0", "n", "lead", "what"]
WORK_KIND = "key long, c1 long, c2 long, lo long, hi long, w0 long, n long, lead long, what long, bytes binary"


def _work_batch(rows: list[tuple], names: list[str] = WORK) -> pa.RecordBatch:
    kinds = [pa.int64()] * len(names) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in rows], k) for i, k in enumerate(kinds)], names=[*names, "bytes"])


def cells_of(r: dict, cell: int, short: int, length: int) -> Iterator[tuple]:
    """A run cut into cells of `cell` starts, aligned to the minimizer, for each size it is searched for: key, by what all strings of the
    cell share, two hashes of the cell's bytes, first start, number of starts, way to the minimizer, size, bytes."""
    text, lead = r["bytes"], r["lead"]  # lead: from the first start to the minimizer
    salt = r["key"].to_bytes(8, "little", signed=True)
    for what, size in ((LONG, length), (SHORT, short)):
        if r["what"] not in (what, BOTH):
            continue
        s, n = 0, min(r["n"], len(text) - size + 1)
        while s < n:
            d = lead - s  # cells hold d in [cell * j, cell * (j + 1))
            z = min(n, s + d % cell + 1)
            core_a, core_b = lead - d // cell * cell, lead - (d // cell + 1) * cell + 1 + size
            own = text[s : z - 1 + size]
            k = hashlib.blake2b(text[core_a:core_b] + b"%d %d" % (d // cell, what), digest_size=8, key=salt).digest()
            h = hashlib.blake2b(own + b"%d %d %d" % (z - s, d, what), digest_size=16).digest()
            key, s1, s2 = (int.from_bytes(x, "little", signed=True) for x in (k, h[:8], h[8:]))
            yield key, s1, s2, s, z - s, d, what, own
            s = z


def _cells(cell: int, short: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, r["c1"], r["c2"], r["lo"], r["hi"], r["w0"] + s, n, d, what, s1, s2, own) for r in batch.to_pylist() for key, s1, s2, s, n, d, what, own in cells_of(r, cell, short, length)]
            yield _work_batch(out, [*WORK, "s1", "s2"])

    return run


def _decided(s: Scratch, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What cells with equal bytes show, and the rows of the groups that stay open: one for each kind of cell that is decided, all of
    the others (equal cells of one document, when another is asked for)."""
    kinds = cells.groupBy("key", "what", "s1", "s2").agg(F.count("*").alias("m"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.min(F.struct("c1", "c2")).alias("one"))
    kinds = s.write(kinds, "suffix-kinds")
    clear = F.when(F.col("what") == LONG, F.col("m") > 1).otherwise(F.col("least") != F.col("most"))
    done = kinds.where(clear).select("key", "s1", "s2", "least", "most", "one")
    groups = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("what").alias("what"), F.min("least").alias("least"), F.max("most").alias("most"))
    still = groups.where((F.col("kinds") > 1) & ((F.col("what") == LONG) | (F.col("least") != F.col("most")))).select("key")
    found = cells.join(done.select("key", "s1", "s2"), ["key", "s1", "s2"], "left_semi")
    found = s.write(found.select("c1", "c2", F.col("w0").alias("from"), (F.col("w0") + F.col("n")).alias("to"), "what"), "suffix-found")
    left = cells.join(still, "key", "left_semi").join(done, ["key", "s1", "s2"], "left").where("one IS NULL OR one = struct(c1, c2)")
    left = left.withColumns({"lo": F.coalesce("least", "lo"), "hi": F.coalesce("most", "hi")}).select(*WORK, "bytes")
    left = s.write(left, "suffix-work")
    s.drop(kinds)
    return found, left


def _slices(length: int):
    """The contexts' bytes, from rows with a text and the list of its wanted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tc.text_bytes(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = data[offs[i] : offs[i + 1]]
                yield _work_batch([(w["g"], w["c1"], w["c2"], w["lo"], w["hi"], 0, w["n"], w["lead"], BOTH, text[w["first"] : w["first"] + w["size"]].tobytes()) for w in wanted])

    return run


def repeated_spans(s: Scratch, docs: DataFrame, *, short: int, length: int, group_limit: int) -> DataFrame:
    """__file, __at and covers, an array of from, to (exclusive) and what, unsorted and overlapping, for documents that
    have any. docs: __file, __at, text. A table of the scratch."""
    runs = s.write(docs.mapInArrow(_runs(short, length), "__file long, __at long, first long, n long, lead long, size long, g long, c1 long, c2 long"), "suffix-runs")
    again = s.write(runs.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g"), "suffix-again")
    cand = s.write(runs.join(again, "g", "left_semi").withColumn("doc", F.xxhash64(*KEY)), "suffix-candidates")
    s.drop(runs, again)
    name = ["g", "c1", "c2", "n", "lead", "size"]
    contexts = s.write(cand.groupBy(*name).agg(F.count("*").alias("m"), F.min("doc").alias("lo"), F.max("doc").alias("hi")), "suffix-contexts")
    mixed = s.write(contexts.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g"), "suffix-mixed")
    chosen = s.write(contexts.join(mixed, "g", "left_semi").select("c1", "c2", "lo", "hi", F.col("lo").alias("doc")), "suffix-chosen")
    wanted = cand.join(chosen, ["c1", "c2", "doc"]).dropDuplicates(["c1", "c2"])
    wanted = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("g", "c1", "c2", "lo", "hi", "first", "n", "lead", "size")).alias("wanted"))  # one document's runs
    wanted = s.write(wanted, "suffix-wanted")
    work = docs.where(F.octet_length("text") >= short).join(wanted, [*KEY]).select("text", "wanted")
    work = s.write(work.mapInArrow(_slices(length), WORK_KIND), "suffix-work")
    s.drop(mixed, chosen, wanted)
    parts = []
    for cell in (64, 16, 4, 1):  # equal cells of one start decide all that is left
        sizes = work.groupBy("key").agg(F.count("*").alias("size"))
        big = s.write(sizes.where(F.col("size") > group_limit).select("key"), "suffix-big")
        some = big.limit(1).count() > 0
        small = work.join(big, "key", "left_anti") if some else work
        small = small.repartition("key").sortWithinPartitions("key").drop("lead")
        parts.append(s.write(small.mapInArrow(_sort_groups(short, length), "c1 long, c2 long, from long, to long, what long"), "suffix-found"))
        if not some:
            break
        cells = s.write(work.join(big, "key", "left_semi").mapInArrow(_cells(cell, short, length), WORK_KIND.replace("bytes", "s1 long, s2 long, bytes")), "suffix-cells")
        s.drop(work, big)
        decided, work = _decided(s, cells)
        parts.append(decided)
        s.drop(cells)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    zero = F.lit(0).cast("long").alias("from")
    full = F.least("n", F.col("size") - length + 1)
    whole = contexts.where("m > 1").select("c1", "c2", zero, full.alias("to"), F.lit(LONG).cast("long").alias("what")).where("to > 0")
    whole = whole.union(contexts.where("lo != hi").select("c1", "c2", zero, F.col("n").alias("to"), F.lit(SHORT).cast("long").alias("what")))
    found = s.write(whole.union(found), "suffix-hits")
    size = F.when(F.col("what") == LONG, length).otherwise(short)
    hits = cand.select(*KEY, "first", "c1", "c2").join(found, ["c1", "c2"])
    hits = hits.select(*KEY, (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") - 1 + size).alias("to"), "what").distinct()
    return s.write(hits.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to", "what")).alias("covers")), "suffix-covers")  # one document's


def merged(covers: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal ranges that the given ones cover; those that touch are one."""
    spans: list[list[int]] = []
    for a, b in sorted(covers):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tc.text_bytes(batch.column("text"))
        rows = []
        for i, covers in enumerate(batch.column("covers").to_pylist()):
            text = data[offs[i] : offs[i + 1]]
            spans, shared = (merged([(c["from"], c["to"]) for c in covers or [] if c["what"] == what]) for what in (LONG, SHORT))
            kept, at = hashlib.sha256(), 0
            for a, b in [*spans, [len(text), 0]]:
                kept.update(text[at:a].tobytes())
                at = b
            both = [[{"from": a, "to": b} for a, b in x] for x in (spans, shared)]
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), both[0], sum(b - a for a, b in shared), both[1]))
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        kinds = [pa.int64()] * 3 + [pa.string(), span, pa.int64(), span]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_shared", "shared"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])


def remove_repeats(docs: DataFrame, *, length: int = 400, short: int = 256, group_limit: int = 2048) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), n_shared
    (bytes that repeat in another document in strings of `short` bytes; more than is removed) and shared (their ranges)."""
    ship(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text", *(c for c in KEY if c in docs.columns)), "suffix-keyed").withColumn("text", F.coalesce("text", F.lit("")))
    with Scratch(docs.sparkSession) as s:
        covers = s.keep(repeated_spans(s, docs.select(*KEY, "text"), short=short, length=length, group_limit=group_limit), "suffix-covers")
    id_kind, span = docs.schema["doc_id"].dataType.simpleString(), "array<struct<from:long,to:long>>"
    kind = f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span}, n_shared long, shared {span}"
    return docs.join(covers, [*KEY], "left").select("doc_id", "text", "covers").mapInArrow(_remove, kind)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
