"""N-gram Jaccard join: a recursive, exact metric-space join.

Two documents link when 100 * |X & Y| >= percent * |X | Y| over their sets of distinct word shingles, that
is, when the Jaccard distance is at most r = 1 - percent/100. Sets are joined in exact steps:

1. Equal sets (distance 0) become one node; its copies are never paired.
2. The shingle space is cut into sub-spaces by hash. In a sub-space the distinct sub-sets are the pivots and
   a document lies in the Voronoi region of the pivot at distance 0. A linked pair differs in at most
   D = floor((1 - t) / (1 + t) * (|X| + |Y|)) shingles, so in at most D sub-spaces: whatever order all regions
   are put in, the first region that both share is among the first D + 1 of either. Regions that a sample of rows
   finds crowded come last in that order, so a passage that a great share of documents hold gathers nobody who has
   other regions. (Whole documents as first-level pivots don't separate texts: unrelated ones are all at distance
   1 from each other, so every window would hold every document. Sub-sets are pivots that do.)
3. The set of least hash in a region is its pivot; the regions of one pivot make its cell. A cell is covered by
   balls: a point is a pivot, the points that may link with it are its ball, and the next point outside all balls
   is the next pivot. Pairs of pivot and point, fewer than the cell has points, are verified on the whole sets,
   and links inside balls join components at once. Cells of more than CELL points are covered in blocks, and
   what many blocks leave, a point for each component, is covered again.
4. Cells that still hold several components are joined recursively: two pivots make Voronoi regions,
   the triangle inequality gives the window of documents replicated into both, down to small leaves. Pairs that the distances of short
   vectors leave are verified on the whole sets, as long as a cell leaves no more than a few for each point.
5. Where it leaves more, as among documents that are just too far apart to link, pairs are never made: the sorted shingles
   of the cell's points, each once, go to a task that counts all their common shingles and gives no more links than join its components.

A pair of texts is so compared in a cell of its own size only, and what travels grows with points, not pairs. Links join components,
which hash-to-min labels find; a point whose component is known to its cell is not compared again. Documents are sets of
shingles; with fewer words than a shingle has, the whole sequence is one
shingle. Shingles and sets are told apart by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bytelens.llm import textcore as tc
from bytelens.llm.components import components
from bytelens.runtime import KEY, Scratch, keyed, ship

BINS, LEAF, FLAT, CELL, BLOCKS, PARTNERS, WEIGHT, BROADCAST, MARKS = 1024, 48, 64, 1024, 8, 8, 1 << 20, 1 << 18, 1 << 14


def shingle_sets(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = tc.Words(data, offs, lo, hi, tc.NONBLANK)
    sh, b = tc.shingles(w.hash, k), w.bounds
    out = []
    for i in range(hi - lo):
        n = int(b[i + 1] - b[i])
        if n >= k:
            x = np.sort(sh[b[i] : b[i + 1] - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(np.array([tc.whole(w.hash[b[i] : b[i + 1]])], np.uint64) if n else np.empty(0, np.uint64))
    return out


def most_apart(a, b, percent: int):
    """Largest symmetric difference that a link of two sets of these sizes allows."""
    return ((100 - percent) * (a + b)) // (100 + percent)


def space_bits(level: int, percent: int) -> int:
    """log2 of the number of sub-spaces of a level: at least a quarter of its largest size, and a fifth more than the
    differences that a link allows a set at the level's upper end or, from the level above, just beyond it."""
    top = 100 * (1 << level) // percent
    d = int(most_apart(top, top * 100 // percent, percent))
    return max(level - 2, (6 * (d + 1) // 5 - 1).bit_length())


def bins_of(x: np.ndarray) -> bytes:
    """Whether the number of a set's shingles is odd, for each bin, by the low bits of their hashes; a bit for each bin."""
    b = max(BINS, 1 << max(0, len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).tobytes()


def bin_matrix(rows: list[bytes]) -> np.ndarray:
    """Bits of all rows, folded to the bins of the row that has fewest: of bins with equal low bits, whether their sum is odd."""
    width = min(map(len, rows))
    if not all(len(r) == width for r in rows):
        rows = [np.bitwise_xor.reduce(np.frombuffer(r, np.uint8).reshape(-1, width), 0).tobytes() for r in rows]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, width // 8)


def apart(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bins in which rows differ from p: at most the symmetric difference of the sets."""
    return np.bitwise_count(v ^ p).sum(1, dtype=np.int64)


def links_at_most(n: int, percent: int) -> int:
    """Differences that a link allows a set of n shingles with the largest partner it may have."""
    return int(most_apart(n, n * 100 // percent, percent))


def all_regions(x: np.ndarray, percent: int, flat: bool = False) -> list[np.ndarray]:
    """Keys of the regions that a set lies in, in the order of their sub-spaces, for each level it takes part in; a level
    holds sets of like sizes, and small sets have single shingles as sub-spaces, as flat asks for all."""
    n = len(x)
    level = 0 if flat or n < FLAT else n.bit_length()
    levels = [level]
    if level and n * percent <= 100 * (1 << (level - 1)):  # a partner may be of the level below
        levels.append(0 if level - 1 < FLAT.bit_length() else level - 1)
    out = []
    for t in levels:
        if t == 0:
            out.append(tc.mix(x + np.uint64(1)))
            continue
        part = x >> np.uint64(64 - space_bits(t, percent))
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(tc.mix(x), cut)
        out.append(tc.mix(sums + part[cut] * tc.MUL_B + np.uint64(t * int(tc.BASE) % (1 << 64))))
    return out


def is_thin(x: np.ndarray, percent: int) -> bool:
    """Whether a set leaves so many sub-spaces empty that the argument of step 2 fails."""
    return any(len(keys) <= links_at_most(len(x), percent) for keys in all_regions(x, percent))


def region_keys(x: np.ndarray, percent: int, crowded: np.ndarray, flat: bool = False) -> np.ndarray:
    """The first D + 1 regions of a set on each of its levels; crowded (sorted keys) are the last in order."""
    d = links_at_most(len(x), percent)
    if d == 0:  # links with equal sets only, and with no set that it is the smaller of
        return np.empty(0, np.int64)
    out = []
    for keys in all_regions(x, percent, flat):
        if len(crowded):
            at = np.minimum(np.searchsorted(crowded, keys), len(crowded) - 1)
            late = crowded[at] == keys
            keys = np.concatenate((keys[~late], np.sort(keys[late])))
        out.append(keys[: d + 1])
    return np.unique(np.concatenate(out)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        data, offs = tc.text_bytes(batch.column("text"))
        for lo, hi in tc.chunks(offs):
            yield batch, lo, hi, shingle_sets(data, offs, lo, hi, k)


def names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, by its size and its shingles."""
    h1 = np.array([np.add.reduce(s) if len(s) else 0 for s in sets], np.uint64)
    n = np.array([len(s) for s in sets], np.uint64)
    h2 = np.array([np.bitwise_xor.reduce(tc.mix(s ^ tc.MUL_A)) if len(s) else 0 for s in sets], np.uint64)
    return tc.mix(h1 + n * tc.BASE).view(np.int64), h2.view(np.int64)


def _describe(k: int, percent: int):
    """Facts of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, sets in _sets(batches, k):
            h1, h2 = names(sets)
            facts = [pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2), pa.array(map(bins_of, sets), pa.binary()), pa.array([is_thin(s, percent) for s in sets], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (*KEY, "doc_id")), *facts], names=[*KEY, "doc_id", "n", "h1", "h2", "bins", "thin"])

    return run


def _seats(k: int, percent: int, crowded, flat: bool = False):
    """(key, h1, pivot) for each region of each distinct set of the task: copies inside it go once, so that a region
    gets no more rows from the copies of one set than there are tasks. A crowded region's pivot is known beforehand: the least set of
    the sample in it; its rows have their set's hash as key, as nothing needs them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (late, pivots), seen = crowded.value, set()
        for _, _, _, sets in _sets(batches, k):
            h1, _ = names(sets)
            keys, owners = [np.empty(0, np.int64)], []
            for h, s in zip(h1.tolist(), sets, strict=True):
                if h not in seen and len(s):
                    seen.add(h)
                    keys.append(region_keys(s, percent, late, flat))
                    owners += [h] * len(keys[-1])
            key, own = np.concatenate(keys), np.array(owners, np.int64)
            pivot, cold = np.zeros(len(key), np.int64), np.ones(len(key), bool)
            if len(late):
                at = np.minimum(np.searchsorted(late, key.view(np.uint64)), len(late) - 1)
                cold = late[at] != key.view(np.uint64)
                pivot = pivots[at]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(cold, key, own)), pa.array(own), pa.array(pivot, mask=cold)], names=["region", "key", "h1", "pivot"])

    return run


def _sampled(k: int, percent: int):
    """All regions of each row's set, and the set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sets in _sets(batches, k):
            got = [(key, np.full(len(key), h)) for s, h in zip(sets, names(sets)[0], strict=True) if len(s) for key in all_regions(s, percent)]
            key, own = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own)], names=["key", "h1"])

    return run


def _verify(k: int, percent: int):
    """(a, b) of the pairs that link, from rows a, b, text_a, text_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            sides = [tc.text_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            keep = np.zeros(len(a), bool)
            for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                both = []
                for node, (data, offs) in ((p, sides[0]), (q, sides[1])):
                    if node not in held:
                        if len(held) >= 256:
                            held.pop(next(iter(held)))
                        held[node] = shingle_sets(data, offs, i, i + 1, k)[0]
                    both.append(held[node])
                x, y = both
                together = np.sort(np.concatenate(both))
                common = int((together[1:] == together[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return run


def star_cover(v: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (pivot, point) of a cell: the first point is a pivot, the points whose distance to it doesn't
    rule out a link are its ball, and the first of those outside all balls so far is the next pivot. Each point is
    in one ball at most, so a cell of m points gives less than m pairs. comp is not used."""
    left = np.arange(len(n))
    while len(left) > 1:
        p, rest = left[0], left[1:]
        near = apart(v[rest], v[p]) <= most_apart(n[p], n[rest], percent)
        if near.any():
            yield np.full(int(near.sum()), p), rest[near]
        left = rest[~near]


def quick_join(v: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different components whose distance doesn't rule out a link. Recursive: two
    pivots, the nearer one's region, and the window of points that may link across the border. A pair comes
    up once or more."""

    def leaf(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in x.tolist():
            js = y[(apart(v[y], v[i]) <= most_apart(n[i], n[y], percent)) & (comp[y] != comp[i])]
            if len(js):
                yield np.minimum(i, js), np.maximum(i, js)

    stack = [np.arange(len(n))]
    while stack:
        x = stack.pop()
        if len(np.unique(comp[x])) < 2:
            continue
        if len(x) <= LEAF:
            yield from leaf(x, x)
            continue
        p = x[0]
        dp = apart(v[x], v[p])
        q = x[int(dp.argmax())]
        dq = apart(v[x], v[q])
        eps = int(most_apart(int(n[x].max()), int(n[x].max()), percent))
        gap = dp - dq  # two points with distance <= eps have gaps within 2 * eps
        left, right = x[gap <= 2 * eps], x[gap > 0]  # pairs within a side, and across the border: left holds gap in (0, 2 eps] too
        if len(left) > 0.9 * len(x) or len(right) > 0.9 * len(x):  # no use splitting: block by block
            for i in range(0, len(x), 512):
                yield from leaf(x[i : i + 512], x)
            continue
        stack += [left, right]


def few_pairs(v: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int, partners: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """What quick_join finds, or None if that is more than so many partners for each point."""
    found, size = [], 0
    for pair in quick_join(v, n, comp, percent):
        found.append(pair)
        size += len(pair[1])
        if size > partners * len(n):
            yield None
            return
    yield from found


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all pairs of sets, as a matrix: shingles that many sets have by a product of bit matrices, the others by
    the sets that have them."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    if not len(owner):
        return out
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare_up_to = max(1, m // 32)
    often = np.flatnonzero(count > rare_up_to)
    column = np.full(len(count), -1)
    column[often] = np.arange(len(often))
    col = column[code]
    for lo in range(0, len(often), 2048):
        here = (col >= lo) & (col < lo + 2048)
        x = np.zeros((m, min(2048, len(often) - lo)), np.float32)
        x[owner[here], col[here] - lo] = 1
        out += x @ x.T
    rare = (col < 0) & (count[code] > 1)
    order = np.argsort(code[rare], kind="stable")
    own, code = owner[rare][order], code[rare][order]
    for d in range(1, rare_up_to):
        same = code[d:] == code[:-d]
        if not same.any():
            break
        pairs = np.bincount(own[:-d][same] * m + own[d:][same], minlength=m * m).reshape(m, m).astype(np.float32)
        out += pairs + pairs.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out


def exact_links(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that link, enough of them to join all components that links join."""
    n, both = np.array([len(x) for x in sets], np.int64), common(sets)
    label = np.unique(comp, return_inverse=True)[1]
    for i in range(len(sets)):
        c = both[i].astype(np.int64)
        js = np.flatnonzero((100 * c >= percent * (n[i] + n - c)) & (label != label[i]))
        if len(js):
            labels, first = np.unique(label[js], return_index=True)
            js = js[first]
            yield np.minimum(i, js), np.maximum(i, js)
            label[np.isin(label, labels)] = label[i]


def _in_cells(search, *options):
    """Pairs (a < b) that search finds in cells, from rows (key, node, comp, and n and bins or shingles) sorted by key; for a
    cell for which search says None, its key as a, without b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x, y = (np.concatenate(side) for side in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, comp = (t.column(c).to_numpy() for c in ("node", "comp"))
            if "bins" in t.column_names:
                n, bins = t.column("n").to_numpy(), t.column("bins").to_pylist()
                points = lambda a, b: (bin_matrix(bins[a:b]), n[a:b])
            else:
                sets = t.column("shingles").to_pylist()
                points = lambda a, b: ([np.frombuffer(x, np.uint64) for x in sets[a:b]],)
            key = t.column("key").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            found, size = [], 0
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for pair in search(*points(a, b), comp[a:b], *options):
                    if pair is None:
                        yield pa.RecordBatch.from_pydict({"a": pa.array([key[a]], pa.int64()), "b": pa.nulls(1, pa.int64())})
                        continue
                    i, j = pair
                    found.append((node[a + i], node[a + j]))
                    size += len(j)
                    if size >= 10_000:
                        yield pairs(found)
                        found, size = [], 0
            if found:
                yield pairs(found)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            held.append(t)
            key = t.column("key").to_numpy()
            start = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if start or (len(held) > 1 and held[-2].column("key")[-1].as_py() != key[0]):
                whole = pa.concat_tables([*held[:-1], t.slice(0, start)])
                held = [t.slice(start)]
                yield from join(whole)
        if held:
            yield from join(pa.concat_tables(held))

    return run


def marked(s: Scratch, docs: DataFrame, keys: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of docs whose KEY is in keys, or those whose is not, left where they lie: the keys are broadcast as bitmaps, a bit for
    each row of a file, 4 KB for each 32,768 rows (2 MB for the documents of 30 GB in large files). More than MARKS bitmaps (64 MB) are not sent: keys are joined by
    shuffle. The bitmaps stay, as the rows are lazy."""
    block, place = F.bitmap_bucket_number("__at"), F.bitmap_bit_position("__at")
    bits = s.keep(keys.groupBy("__file", block.alias("__block")).agg(F.bitmap_construct_agg(place).alias("__bits")), "jaccard-marks")
    if bits.count() > MARKS:
        return docs.join(keys.select(*KEY), [*KEY], "left_semi" if inside else "left_anti")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.bit_get(byte, (place % 8).cast("int")).cast("int"), F.lit(0))
    placed = docs.withColumn("__block", block).join(F.broadcast(bits), ["__file", "__block"], "inner" if inside else "left")
    return placed.where(bit == (1 if inside else 0)).select(docs.columns)


def with_texts(s: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the rows wanted (node and KEY), a written table. Up to BROADCAST rows (about 6 MB) it is broadcast; beyond that
    only texts that are wanted meet it by shuffle, the others stay where they lie."""
    docs = docs.select(*KEY, "text")
    few = wanted.count() <= BROADCAST
    return (docs.join(F.broadcast(wanted), [*KEY]) if few else marked(s, docs, wanted).join(wanted, [*KEY])).select("node", "text")


def join_pairs(s: Scratch, pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links among pairs (a, b) of nodes. The nodes' texts are fetched once. One node
    may be a in a great share of the pairs, but a pair takes part once on either side, so skewed joins can be split."""
    wanted = s.write(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", *KEY), "node"), "jaccard-wanted")
    texts = s.write(with_texts(s, docs, wanted), "jaccard-texts")
    t = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = s.write(t.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), "a long, b long"), "jaccard-links")
    s.drop(wanted, texts)
    return links


def _search(rows: DataFrame, facts: DataFrame, search, *options) -> DataFrame:
    """Distinct candidate pairs that search finds in the groups of rows (key, node, comp)."""
    placed = rows.join(facts, "node").select("key", "node", "comp", "n", "bins")
    return placed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_in_cells(search, *options), "a long, b long").distinct()


def _cover_groups(left: DataFrame) -> DataFrame:
    """(key, node, comp): the points of cells (pivot, node, comp) in blocks of about CELL."""
    sizes = left.groupBy("pivot").agg(F.count("*").alias("size"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CELL))
    return left.join(sizes, "pivot").select(F.xxhash64("pivot", block).alias("key"), "node", "comp")


def _deal(seated: DataFrame) -> DataFrame:
    """(key, node, comp) of the groups that cells (pivot, node, comp) of several components are joined in: a cell of at
    most CELL points is one; a larger one is dealt as pairs of blocks, so that no group has over about twice as many and
    every two points of different components meet in one. Rows are numbers only, and counts come first, so that no task gets a large cell
    whole."""
    comps = seated.groupBy("pivot", "comp").agg(F.count("*").alias("m"))
    cells = comps.groupBy("pivot").agg(F.sum("m").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("m", "comp")).alias("major")).where("kinds > 1 and size > 2")
    cells = cells.select("pivot", "size", F.col("major.comp").alias("major"), F.ceil(F.col("major.m") / CELL).alias("mb"), F.ceil((F.col("size") - F.col("major.m")) / CELL).alias("sb"))
    first = F.col("comp") == F.col("major")
    own = F.pmod(F.xxhash64("node"), F.when(first, F.col("mb")).otherwise(F.col("sb")))
    key = lambda kind, x, y: F.xxhash64("pivot", F.lit(kind), x, y)
    ids = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_major = F.when(first, F.transform(ids(F.col("sb")), lambda t: key("m", own, t))).otherwise(F.transform(ids(F.col("mb")), lambda t: key("m", t, own)))
    others = F.when(first, F.array().cast("array<long>")).otherwise(F.transform(ids(F.col("sb")), lambda t: key("s", F.least(own, t), F.greatest(own, t))))
    keys = F.when(F.col("size") <= CELL, F.array(F.xxhash64("pivot"))).otherwise(F.concat(with_major, others))
    return seated.join(cells, "pivot").select(F.explode(keys).alias("key"), "node", "comp")


def _crowded_links(s: Scratch, keys: DataFrame, dealt: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links in the groups named by keys, of the groups dealt (key, node, comp), that join their components; from the points' sorted
    shingles. A group of more than WEIGHT shingles is dealt as pairs of blocks."""
    held = s.write(dealt.join(keys, "key", "left_semi").join(nodes.select("node", "n"), "node"), "jaccard-crowded")
    blocks = held.groupBy("key").agg(F.ceil(F.sum("n") / WEIGHT).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda t: F.xxhash64("key", F.least(own, t), F.greatest(own, t)))
    rows = held.join(blocks, "key").select(F.explode(pair).alias("key"), "node", "comp")
    wanted = s.write(held.select("node").distinct().join(nodes.select("node", *KEY), "node"), "jaccard-wanted")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    points = s.write(with_texts(s, docs, wanted).mapInArrow(shingles, "node long, shingles binary"), "jaccard-points")
    placed = rows.join(points, "node").select("key", "node", "comp", "shingles")
    links = s.write(placed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_in_cells(exact_links, percent), "a long, b long"), "jaccard-links")
    s.drop(held, wanted, points)
    return links


def _classes(docs: DataFrame, k: int, percent: int, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows has the key, doc_id, n and set's hashes of each row; sets has h1, h2, n and comp, the component, of
    each set that links with another or is a node. docs: __file, __at, doc_id, text. Both are tables that stay."""
    spark = docs.sparkSession
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    with Scratch(spark) as s:
        facts_kind = f"__file long, __at long, doc_id {id_kind}, n long, h1 long, h2 long, bins binary, thin boolean"
        described = s.write(docs.mapInArrow(_describe(k, percent), facts_kind), "jaccard-sets")
        total = described.count()
        # a node stands for all rows with one set; its texts are those of one of them
        nodes = described.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct(*KEY)).alias("at"))
        nodes = s.write(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", "at.*"), "jaccard-nodes")
        part = docs.where(F.pmod(F.xxhash64(F.lit(29), *KEY), F.lit(max(1, total // sample_rows))) == 0)
        crowd = part.select("text").mapInArrow(_sampled(k, percent), "key long, h1 long").groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("pivot"))
        hot = {np.uint64(r[0] % (1 << 64)): r[1] for r in crowd.where(F.col("n") >= max(16, sample_rows // 128)).select("key", "pivot").collect()}
        late = np.array(sorted(hot), np.uint64)
        crowded = spark.sparkContext.broadcast((late, np.array([hot[x] for x in late], np.int64)))
        kind = "region long, key long, h1 long, pivot long"
        seats = docs.select("text").mapInArrow(_seats(k, percent, crowded), kind)
        if described.where("thin").limit(1).count():  # thin sets against all, by single shingles
            thin = docs.join(described.where("thin").select(*KEY), [*KEY], "left_semi").select("text")
            flat = s.write(thin.mapInArrow(_seats(k, percent, crowded, True), kind), "jaccard-thin")
            seats = seats.union(docs.select("text").mapInArrow(_seats(k, percent, crowded, True), kind).join(flat.select("region").distinct(), "region", "left_semi"))
        region = Window.partitionBy("key")
        shared = seats.select("h1", "pivot", F.min("h1").over(region).alias("lo"), F.max("h1").over(region).alias("hi")).where("pivot IS NOT NULL OR lo != hi").select("h1", F.coalesce("pivot", "lo").alias("lo"))
        # the cell of a pivot: all nodes that share a region whose least set it is
        cells = s.write(shared.select("lo", "h1").distinct().join(nodes.select("h1", "node"), "h1").select(F.col("lo").alias("pivot"), "node").distinct(), "jaccard-cells")
        inside = s.write(nodes.join(cells.select("node").distinct(), "node", "left_semi").select("node", *KEY), "jaccard-inside")
        facts = s.write(described.select(*KEY, "n", "bins").join(inside, [*KEY]).select("node", "n", "bins"), "jaccard-facts")
        s.drop(inside)
        links, comp, tested, left, rounds = None, None, None, cells.withColumn("comp", F.col("node")), 0
        while True:  # a second round only where a cell would be dealt in many blocks
            balls = s.write(_search(_cover_groups(left), facts, star_cover, percent), "jaccard-balls")
            found = join_pairs(s, balls, nodes, docs, k, percent)
            tested = balls if tested is None else tested.union(balls)
            links = found if links is None else links.union(found)
            comp = components(s, links)
            seated = cells.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            before, rounds = left, rounds + 1
            left = s.write(seated.groupBy("pivot", "comp").agg(F.min("node").alias("node")).select("pivot", "node", "comp"), "jaccard-left")
            large = left.groupBy("pivot").count().where(F.col("count") > BLOCKS * CELL)
            if not large.limit(1).count() or (rounds > 1 and left.count() > 0.9 * before.count()):
                break
        dealt = s.write(_deal(seated), "jaccard-dealt")
        got = s.write(_search(dealt, facts, few_pairs, percent, PARTNERS), "jaccard-near")
        more = s.write(got.where("b IS NOT NULL").join(tested, ["a", "b"], "left_anti"), "jaccard-more")
        if more.limit(1).count():
            links = links.union(join_pairs(s, more, nodes, docs, k, percent))
        crowds = got.where("b IS NULL").select(F.col("a").alias("key"))
        if crowds.limit(1).count():
            links = links.union(_crowded_links(s, crowds, dealt, nodes, docs, k, percent))
        comp = components(s, links)
        sets = s.keep(nodes.join(comp, "node", "left").select("h1", "h2", "n", F.coalesce("comp", "node").alias("comp")), "jaccard-classes")
        rows = s.keep(described.select(*KEY, "doc_id", "n", "h1", "h2"), "jaccard-rows")
    return rows, sets


def jaccard_components(docs: DataFrame, *, k: int = 4, percent: int = 85, sample_rows: int = 8192) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), one row for
    each row of docs. Rows are told apart by keys of their own and sets by their content, so doc_id may be null (a
    component of nulls only has none), may repeat with equal or different texts, and may be of any type with an order.
    Empty tables give no rows; columns of docs other than doc_id and text are not read. sample_rows: about how many rows
    are looked at for crowded regions, which changes the order of the work only."""
    ship(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text", *(c for c in KEY if c in docs.columns)), "jaccard-keyed")
    rows, sets = _classes(docs, k, percent, sample_rows)
    same = ["h1", "h2", "n"]
    least = rows.groupBy(*same).agg(F.min("doc_id").alias("least")).join(sets, same).groupBy("comp").agg(F.min("least").alias("component_id"))
    named = Scratch(docs.sparkSession).keep(sets.join(least, "comp").select(*same, "component_id"), "jaccard-named")
    out = rows.join(named, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80, sample_rows: int = 8192) -> DataFrame:
    """One row of each component, that of its smallest doc_id (null is the largest); docs' columns. Documents without words
    all stay. Rows have keys of their own, so doc_id may be null, may repeat and may be of any type that has an order. An empty table
    stays empty; other columns pass through whatever their names."""
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c not in KEY]
    docs = keyed(docs, "jaccard-keyed")
    rows, sets = _classes(docs.select(*KEY, "doc_id", "text"), k, percent, sample_rows)
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("place")
    best = rows.where("n > 0").groupBy("h1", "h2", "n").agg(place)  # of each set, then of each component
    best = best.join(sets, ["h1", "h2", "n"]).groupBy("comp").agg(F.min("place").alias("place"))
    kept = best.select(*(F.col(f"place.{c}").alias(c) for c in KEY)).union(rows.where("n = 0").select(*KEY))
    with Scratch(docs.sparkSession) as s:
        kept = s.write(kept, "jaccard-kept")
        gone = s.keep(rows.select(*KEY).join(kept, [*KEY], "left_anti"), "jaccard-gone")
        return marked(s, docs, gone, inside=False).select(*columns)  # texts stay where they lie
