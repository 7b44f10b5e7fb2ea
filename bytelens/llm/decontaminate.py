"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is words, a block is two of them. For test strings of m words a shift table over block
hashes says how far the window's end can move without passing an occurrence: a window is looked at only
about every m - 1 words of clean text. Where the shift is 0, the hash of the window picks a bucket of
test strings, and their bytes are compared with the text's. Strings of fewer words have passes of their own.

Null and empty texts have no words and no hits. Equal test strings count for each of their items;
repeated rows are scanned as they come. An empty benchmark leaves everything clean.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bytelens.llm import textcore as tc
from bytelens.llm.blocks import merged, with_keys
from bytelens.runtime import KEY, ship

LANE = 256


class Patterns:
    """Compiled test strings of one length."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.strings = list(strings)
        self.items = [strings[s] for s in self.strings]
        flat = np.array([_word_hash(w) for s in self.strings for w in s], np.uint64).reshape(-1, m)
        self.bits = int(min(22, max(12, math.ceil(math.log2(len(flat) * m + 1)) + 6)))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8 if m < 255 else np.int32)
        for end in range(self.block, m + 1):  # blocks that end there may be the window's end after m - end words
            np.minimum.at(self.shift, self._slot(flat[:, end - self.block], flat[:, end - 1]), m - end)
        h = self._window(flat.T)
        order = np.argsort(h, kind="stable")
        self.hashes, self.order = h[order], order

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a * tc.MUL_A + b * tc.MUL_B) if self.block == 2 else b * tc.MUL_B
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _window(words) -> np.ndarray:
        out = words[0].copy()
        for w in words[1:]:
            out = out * tc.BASE + w
        return tc.mix(out)

    def ends(self, w: np.ndarray) -> np.ndarray:
        """Positions of last words of windows that the shift table can't rule out."""
        m, n = self.m, len(w)
        if n < m:
            return np.empty(0, np.int64)
        at = np.arange(m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        found = []
        while len(at):
            step = self.shift[self._slot(w[at - (self.block - 1)], w[at])].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(at[zero])
                step[zero] = 1
            at = at + step
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def matches(self, words: tc.Words, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position of the first word, number of the string) of each occurrence within a row."""
        m, w = self.m, words.hash
        ends = self.ends(w)
        ends = ends[row[ends] == row[ends - (m - 1)]]
        if not len(ends):
            return
        h = self._window([w[ends - (m - 1 - j)] for j in range(m)])
        lo, hi = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        for e, a, b in zip(ends[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            first = e - m + 1
            text = tuple(words.buf[s:t].tobytes().lower() for s, t in zip(words.start[first : e + 1].tolist(), words.end[first : e + 1].tolist(), strict=True))
            for k in self.order[a:b].tolist():
                if self.strings[k] == text:
                    yield first, k


def _word_hash(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return tc.Words(data, np.array([0, len(data)]), 0, 1, tc.ALNUM).hash[0]


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    w = tc.Words(data, np.array([0, len(data)]), 0, 1, tc.ALNUM)
    return [data[a:b].tobytes().lower() for a, b in zip(w.start, w.end, strict=True)]


def compile_patterns(items: list[tuple[object, str | None]], window: int) -> tuple[list[Patterns], list[str]]:
    """Patterns by length, and the items as strings, in their order."""
    names = sorted({str(i) for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    by_len: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        k = number[str(item)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            s = tuple(words[i : i + window])
            owners = by_len[len(s)][s]
            if k not in owners:
                owners.append(k)
    return [Patterns(dict(v), m) for m, v in sorted(by_len.items())], names


def scan_batch(text: pa.Array, groups: list[Patterns], names: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """For each row: number of words, runs of hit words, items that occur."""
    data, offs = tc.text_bytes(text)
    counts, runs, items = [], [], []
    for lo, hi in tc.chunks(offs):
        words = tc.Words(data, offs, lo, hi, tc.ALNUM)
        row, n = words.row, hi - lo
        counts.append(np.diff(words.bounds))
        cover = np.zeros(len(words.hash) + 1, np.int32)
        seen: dict[int, set[int]] = defaultdict(set)
        for g in groups:
            for first, k in g.matches(words, row):
                cover[first] += 1
                cover[first + g.m] -= 1
                seen[int(row[first])].update(g.items[k])
        own_runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if seen:
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                while a < b:  # hits of neighbouring rows may touch
                    r = int(row[a])
                    z = min(b, int(words.bounds[r + 1]))
                    own_runs[r].append((a - int(words.bounds[r]), z - int(words.bounds[r])))
                    a = z
        runs += own_runs
        items += [sorted(names[k] for k in seen[r]) if r in seen else [] for r in range(n)]
    return np.concatenate(counts) if counts else np.empty(0, np.int64), runs, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 16 << 20, keep_columns: list[str] | None = None) -> DataFrame:
    """Each row's keep_columns (all by default) with n_words, hit_runs (runs of hit words, from and to
    exclusive) and hit_items (items with an occurring window, sorted as strings).

    The benchmark is compiled on the driver in blocks of at most block_bytes of text, each broadcast by
    itself, so what is sent is bounded whatever its size. With more than one block, each scans the texts where they lie and writes the
    hits only, by row key; these are merged and joined to the rows once. Columns of these names in docs are replaced."""
    spark = ship(docs.sparkSession)
    docs = docs.drop("n_words", "hit_runs", "hit_items")
    keep = [c for c in (keep_columns or docs.columns) if c in docs.columns and c not in KEY]
    bench = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).where(F.col("text").isNotNull())
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))

    def sent(b: int):
        part = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        return spark.sparkContext.broadcast(compile_patterns([(r[0], r[1]) for r in part.collect()], window))

    words = T.StructField("n_words", T.LongType())
    if n_blocks == 1:
        kept = T.StructType([*(docs.schema[c] for c in keep), words, _RUNS, _ITEMS])
        return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_scanner(sent(0), keep), kept)
    docs = with_keys(docs)
    keys = [docs.schema[c] for c in KEY]
    texts = docs.select(*KEY, "text")
    hits = (texts.mapInArrow(_scanner(sent(b), list(KEY), True), T.StructType([*keys, words, _RUNS, _ITEMS])).drop("n_words") for b in range(n_blocks))
    none = spark.sparkContext.broadcast(([], []))
    counted = docs.select(*dict.fromkeys([*KEY, *keep, "text"])).mapInArrow(_scanner(none, [*KEY, *keep]), T.StructType([*keys, *(docs.schema[c] for c in keep), words, _RUNS, _ITEMS]))
    out = merged(counted.drop("hit_runs", "hit_items"), hits, hit_runs=_joined, hit_items=lambda x: F.array_sort(F.array_distinct(x)))
    return out.select(*keep, "n_words", "hit_runs", "hit_items")


_RUNS = T.StructField("hit_runs", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])))
_ITEMS = T.StructField("hit_items", T.ArrayType(T.StringType()))


def _scanner(sent, cols: list[str], hits_only: bool = False):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, names = sent.value
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            counts, runs, items = scan_batch(batch.column("text"), groups, names)
            own = [pa.array(counts, pa.int64()), pa.array([[{"from": a, "to": b} for a, b in r] for r in runs], kind), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), *own], names=[*cols, "n_words", "hit_runs", "hit_items"])
            yield out.filter(pa.array([bool(r) for r in runs], pa.bool_())) if hits_only else out

    return scan


def _joined(runs: Column) -> Column:
    """Runs in order, those that touch or overlap as one."""
    none = F.array().cast(_RUNS.dataType)

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))))
        return F.when((F.size(out) > 0) & (x["from"] <= last["to"]), longer).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(runs), none, add)


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of op2."""
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a hit, with docs' columns."""
    cols = docs.columns
    return decontaminate(docs, benchmark, **options).where(F.size("hit_runs") == 0).select(*cols)
