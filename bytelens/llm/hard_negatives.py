"""Hard negatives by bit-sliced integer products.

Vectors become rows of integers. All anchors meet all rows, in blocks: anchors go out in waves of a bounded number, and each task
compares its rows with the wave. In a block the rows' components are taken bit-plane by bit-plane, the most significant (of negative
weight) first. After a plane of weight 2**s a score is known to lie within [S + (2**s - 1) * N, S + (2**s - 1) * P], with S the product so far and
N, P the sums of the anchor's negative and positive components; a candidate whose interval can no longer qualify is dropped, and
once few pairs are left only these go on. What the last plane leaves has exact scores.

A wave takes two scans. The first finds each anchor's positives: a row qualifies if its interval reaches the score that the anchor's
last positive so far has. The second finds negatives for all of an anchor's positives at once: a row qualifies if its interval meets
the range of scores asked for by any positive whose places are not yet taken by better rows. Tasks see rows in the order of ties, so a
row that only ties with a full list is dropped. A task gives no more than its best few for each anchor and positive, and Spark merges these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bytelens.runtime import KEY, Scratch, keyed, ship

ROWS, ANCHORS, SPARSE = 1024, 128, 16
#: Scores are put in order as decimals of so many digits.
_LARGEST = 10**38 - 1


def planes(x: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bits (0, 1) of integer rows by plane, the most significant first, and the planes' weights: two's complement, so
    the first is negative. x: int64, or Python integers where those don't suffice."""
    if x.dtype == object:
        top = max((int(v).bit_length() for v in x.ravel()), default=0)
    else:
        top = int(max(x.max(initial=0), ~x.min(initial=0))).bit_length()
    weights = [-(1 << top), *(1 << s for s in range(top - 1, -1, -1))]
    return [(x >> s) & 1 for s in range(top, -1, -1)], weights


def survivors(x: np.ndarray, a: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs of rows x and anchors a (matrices of integers) with least <= score <= most, for each anchor its own
    bounds, among those allowed. By bit-planes: a pair is dropped as soon as its interval lies outside."""
    bits, weights = planes(x)
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)
    reach = sum(abs(w) for w in weights) * int(max(np.abs(a).sum(1).max(initial=0), 1))
    kind = object if reach >= 1 << 61 else np.float32 if reach < 1 << 22 else np.float64 if reach < 1 << 51 else np.int64
    at = a.astype(kind).T.copy()
    up, down = up.astype(kind), down.astype(kind)
    big = reach + 1  # bounds beyond every score, so that they fit the kind
    bound = lambda v: np.array([min(max(int(b), -big), big) for b in v], kind)
    least, most = bound(least), bound(most)
    score = np.zeros((len(x), len(a)), kind)
    pairs = None
    for plane, weight in zip(bits, weights, strict=True):
        rest = abs(weight) - 1
        if pairs is None:
            score += (plane.astype(kind) @ at) * kind(weight) if kind is not object else plane.dot(at) * weight
            fits = (score >= least - rest * up) & (score <= most - rest * down)
            if allowed is not None:
                fits &= allowed
            n = int(np.count_nonzero(fits))
            if n * SPARSE <= fits.size:
                i, j = np.nonzero(fits)
                pairs, score = (i, j), score[i, j]
        else:
            i, j = pairs
            part = (plane[i].astype(kind) * at.T[j]).sum(1)
            score = score + part * (kind(weight) if kind is not object else weight)
            fits = (score >= least[j] - rest * up[j]) & (score <= most[j] - rest * down[j])
            if not fits.all():
                pairs, score = (i[fits], j[fits]), score[fits]
        if pairs is not None and not len(pairs[0]):
            break
    if pairs is None:
        pairs = np.nonzero(fits)
        score = score[pairs]
    return pairs[0], pairs[1], score if kind is object else score.astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, count: int) -> np.ndarray:
    """Indices of the first count members of each group, by falling score, then tie; sorted by group and place."""
    order = np.lexsort((tie, -score, group)) if score.dtype != object else np.array(sorted(range(len(group)), key=lambda i: (group[i], -score[i], tie[i])), np.int64)
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[place < count]


class Best:
    """The best rows of each group that a task has seen so far, count at most: group, score and the row's number in the task. Rows come in the order
    in which ties are settled."""

    def __init__(self, count: int):
        self.count, self.group, self.score, self.row = count, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        kind = object if object in (score.dtype, self.score.dtype) else np.int64
        group, row = np.concatenate((self.group, group)), np.concatenate((self.row, row))
        score = np.concatenate((self.score.astype(kind), score.astype(kind)))
        keep = best(group, score, row, self.count)
        self.group, self.score, self.row = group[keep], score[keep], row[keep]

    def floors(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups that have all their rows, and the score of the last."""
        full = np.flatnonzero(np.append(self.group[1:] != self.group[:-1], True)) if len(self.group) else np.empty(0, np.int64)
        full = full[(full >= self.count - 1)]
        full = full[self.group[full - self.count + 1] == self.group[full]]
        return self.group[full], self.score[full]


def integers(col: pa.Array, scale: float) -> tuple[list, np.ndarray]:
    """floor(scale * x) of each row's components, each as an array of int64, or of Python integers where one is too large; and which rows
    have finite components only."""
    flat, offs = col.flatten(), col.offsets.to_numpy()
    offs = offs - offs[0]
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null is NaN
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.floor(x * scale)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(y))))
    ok = bad[offs[1:]] == bad[offs[:-1]]
    rows = []
    for i in np.flatnonzero(ok):
        v = y[offs[i] : offs[i + 1]]
        rows.append(v.astype(np.int64) if np.abs(v).max(initial=0) < 2**53 else np.array([int(t) for t in v], object))
    return rows, ok


def _stored(v: np.ndarray) -> bytes:
    """Components as bytes: a byte with their width, then little-endian integers of that width."""
    if v.dtype == object:
        width = max((int(t).bit_length() // 8 + 1 for t in v), default=1)
        width = max(width, 9)
        return bytes([width]) + b"".join(int(t).to_bytes(width, "little", signed=True) for t in v)
    width = next(w for w in (2, 4, 8) if not len(v) or -(1 << 8 * w - 1) <= int(v.min()) and int(v.max()) < 1 << 8 * w - 1)
    return bytes([width]) + v.astype(f"<i{width}").tobytes()


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Stored vectors as rows of one matrix; shorter ones end in zeros."""
    width = [(len(v) - 1) // v[0] for v in vectors]
    dims, kinds = max(width, default=0), {v[0] for v in vectors}
    if len(kinds) == 1 and min(width) == dims and (w := next(iter(kinds))) <= 8:
        return np.frombuffer(b"".join(v[1:] for v in vectors), f"<i{w}").reshape(len(vectors), dims).astype(np.int64)
    out = np.zeros((len(vectors), dims), object if max(kinds, default=0) > 8 else np.int64)
    for i, (v, n) in enumerate(zip(vectors, width, strict=True)):
        w = v[0]
        out[i, :n] = np.frombuffer(v, f"<i{w}", offset=1) if w <= 8 else [int.from_bytes(v[k : k + w], "little", signed=True) for k in range(1, len(v), w)]
    return out


def _prepare(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("embedding")
            rows, ok = integers(col if pa.types.is_list(col.type) else col.cast(pa.list_(col.type.value_type)), scale)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in (*KEY, "vec_id", "label", "anchor")), pa.array(map(_stored, rows), pa.binary())], names=[*KEY, "vec_id", "label", "anchor", "v"])

    return run


class Wave:
    """A bounded number of anchors, as they are sent to tasks: numbers, keys, labels and vectors; after the first scan also the ranges
    of scores asked for, a row for each anchor and a column for each positive (an empty range where there are fewer)."""

    def __init__(self, rows: list):
        self.number = np.array([r["number"] for r in rows], np.int64)
        self.at = {(r["__file"], r["__at"]): i for i, r in enumerate(rows)}
        self.label = [r["label"] for r in rows]
        self.vectors = matrix([bytes(r["v"]) for r in rows])
        self.low = self.high = None


def _scan(sent, positives: int, negatives: int, labels_alike: bool):
    """Best rows of the task for each anchor (labels_alike) or each anchor and positive: number, slot, score, vec_id, and the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Wave = sent.value
        m, slots = len(w.number), 1 if labels_alike else positives
        codes: dict = {}
        own = np.array([codes.setdefault(x, len(codes)) for x in w.label], np.int64)
        kept, got, seen = {}, Best(positives if labels_alike else negatives), 0
        low = np.array([[-(1 << 200)]] * m, object) if labels_alike else w.low
        high = np.array([[1 << 200]] * m, object) if labels_alike else w.high
        need = low.copy()
        ends = high.max(1) if m else np.empty(0, object)

        def block(table: pa.RecordBatch, base: int) -> None:
            x = matrix(table.column("v").to_pylist())
            a = w.vectors
            dims = max(x.shape[1], a.shape[1])
            x, a = (np.pad(t, ((0, 0), (0, dims - t.shape[1]))) if t.shape[1] < dims else t for t in (x, a))
            label = np.array([codes.get(t, -1) for t in table.column("label").to_pylist()], np.int64)
            self_at = np.full(len(x), -1, np.int64)
            for i, k in enumerate(zip(table.column("__file").to_pylist(), table.column("__at").to_pylist(), strict=True)):
                self_at[i] = w.at.get(k, -1)
            found = []
            for lo in range(0, m, ANCHORS):
                js = np.arange(lo, min(lo + ANCHORS, m))
                if labels_alike:  # rows of one label at a time
                    for c in np.unique(own[js]):
                        ii, jj = np.flatnonzero(label == c), js[own[js] == c]
                        if len(ii):
                            i, j, s = survivors(x[ii], a[jj], need[jj, 0], ends[jj])
                            i, j = ii[i], jj[j]
                            other = self_at[i] != j
                            found.append((j[other], s[other], base + i[other]))
                    continue
                asked = js[(high[js] >= low[js]).any(1)]
                if not len(asked):
                    continue
                i, j, s = survivors(x, a[asked], need[asked].min(1), ends[asked], label[:, None] != own[asked][None, :])
                j = asked[j]
                for p in range(slots):
                    fits = (s >= need[j, p]) & (s <= high[j, p])
                    fits = fits.astype(bool)
                    found.append((j[fits] * slots + p, s[fits], base + i[fits]))
            if not any(len(f[0]) for f in found):
                return
            g, s, r = (np.concatenate([f[k] for f in found]) for k in range(3))
            got.add(g, s, r)
            full, floor = got.floors()
            need[full // slots, full % slots] = [int(v) + 1 for v in floor]  # a later row must beat the last: it loses ties
            held = set(got.row.tolist())
            for i in set(r.tolist()) & held:
                kept[i] = tuple(table.column(c)[i - base].as_py() for c in ("vec_id", *KEY))
            if len(kept) > 4 * len(held) + 4096:
                for i in [i for i in kept if i not in held]:
                    del kept[i]

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                if m:
                    block(part, seen)
                seen += part.num_rows
        for lo in range(0, len(got.row), 1 << 16):
            g, rows = got.group[lo : lo + (1 << 16)], [kept[i] for i in got.row[lo : lo + (1 << 16)].tolist()]
            score = [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in got.score[lo : lo + (1 << 16)].tolist()]
            exact = [str(min(max(int(s), -_LARGEST), _LARGEST)) for s in got.score[lo : lo + (1 << 16)].tolist()]
            ids, files, places = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"number": w.number[g // slots], "slot": (g % slots).astype(np.int32), "score": pa.array(score, pa.int64()), "exact": pa.array(exact, pa.string()), "vec_id": pa.array(ids, pa.int64()), "__file": pa.array(files, pa.int64()), "__at": pa.array(places, pa.int64())})

    return run


_FOUND = "number long, slot int, score long, exact string, vec_id long, __file long, __at long"


def mine(rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0, wave: int = 4096, task_rows: int = 65536) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    rows: vec_id (whole number), label, embedding (array of numbers). Components become floor(scale * x), a score is the integer product of two
    rows; where one is longer the other counts as zeros there. Higher scores come first, then smaller vec_id (null is the
    largest), then a row's file and place. Positives of an anchor (rows for which anchor holds) are its first other rows of the same label, negatives of
    an anchor and a positive the first rows of other labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.

    Rows with a null label, a null vector or a null or non-finite component take no part. Rows are told apart by their file and
    place (runtime.file_keys; others are written once), so repeated rows and repeated vec_ids are rows of their own. Empty vectors score 0. Scores of up
    to 38 digits are compared exactly, larger ones as the largest of these; a score beyond 64 bits is given as the nearest that fits. An empty table, or one without anchors, gives no
    rows. Other columns are not read, whatever their names. wave: anchors sent to tasks at a time; task_rows: rows in a task; both bound memory only."""
    spark, ties = ship(rows.sparkSession), [F.col("vec_id").asc_nulls_last(), *KEY]
    own = set(rows.columns)
    rows = rows.withColumn("__anchor", F.coalesce(anchor, F.lit(False)))
    rows = keyed(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.col("__anchor").alias("anchor"), *(c for c in KEY if c in own)), "negatives-keyed")
    label = rows.schema["label"].dataType.simpleString()
    kind = f"__file long, __at long, vec_id long, label {label}, anchor boolean, v binary"
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    with Scratch(spark) as s:
        dealt = s.write(rows.where("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_prepare(scale), kind).repartition(parts, *KEY), "negatives-rows")
        anchors = s.write(dealt.where("anchor").select(F.monotonically_increasing_id().alias("number"), *KEY, "vec_id", "label", "v"), "negatives-anchors")
        dealt, out, last = dealt.sortWithinPartitions(*ties), None, -1
        while True:
            got = anchors.where(F.col("number") > last).orderBy("number").limit(wave).collect()  # at most wave rows
            if not got:
                break
            last = got[-1]["number"]
            w = Wave([r.asDict() for r in got])
            first = spark.sparkContext.broadcast(w)
            first_score = F.col("exact").cast("decimal(38,0)").desc()
            place = F.row_number().over(Window.partitionBy("number").orderBy(first_score, *ties))
            near = dealt.mapInArrow(_scan(first, positives, negatives, True), _FOUND).withColumn("place", place).where(F.col("place") <= positives)
            near = s.write(near.withColumn("slot", F.col("place") - 1), "negatives-positives")
            w.low, w.high = (np.full((len(got), positives), v, object) for v in (1, 0))
            where = {int(x): i for i, x in enumerate(w.number)}
            for r in near.select("number", "slot", "exact").collect():  # at most positives for each anchor of the wave
                score = int(r["exact"])
                w.low[where[r["number"]], r["slot"]] = -(-low_percent * score // 100)
                w.high[where[r["number"]], r["slot"]] = high_percent * score // 100
            first.unpersist()
            second = spark.sparkContext.broadcast(w)
            place = F.row_number().over(Window.partitionBy("number", "slot").orderBy(first_score, *ties))
            far = dealt.mapInArrow(_scan(second, positives, negatives, False), _FOUND).withColumn("rank", place).where(F.col("rank") <= negatives)
            pair = near.select("number", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            rows_out = far.select("number", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pair, ["number", "slot"])
            rows_out = rows_out.join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            done = s.keep(rows_out, "negatives-found")
            s.drop(near)
            second.unpersist()
            out = done if out is None else out.union(done)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
