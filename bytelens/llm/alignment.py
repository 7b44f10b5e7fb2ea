"""Cross-tokenizer alignment by a group dictionary.

Two tokenizers, A and B, cut the same bytes. Offsets where tokens of both end cut a text into groups; a group is a sequence of A ids
and one of B ids. Groups repeat, so work is done once for each distinct one:

1. A task encodes its documents and interns groups: in a unit, a bounded number of documents in a row, each distinct group has
   a number. A document keeps its groups' numbers with their frequencies; the unit's dictionary is a table of distinct groups.
2. Dictionaries are merged by group key. The links of a distinct group, pairs of tokens that end together, are expanded once
   and multiplied by the group's frequency, which gives each id pair's count and each B id's highest.
3. What a group's links are worth goes back by group key to the units' dictionaries, then by unit to the documents, which sum
   worth times frequency. No document's groups are ever shuffled one by one.

Every token has at least one byte, so the links of a group are its last A token with its last B token: one for each group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bytelens.llm import textcore as tc
from bytelens.llm.encoding import ByteBpe, in_worker
from bytelens.runtime import Scratch, ship

UNIT_GROUPS, UNIT_BYTES, PART = 250_000, 64 << 20, 1 << 20


class PlainBpe(ByteBpe):
    def __init__(self, path: str):
        super().__init__(path, plain_specials=True)


class Pieces:
    """The second tokenizer: a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def id_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            out.append(bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode())
        return out


def sequences(ids: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A hash of each of the sequences ids[start:end]; code has a random number for each id."""
    up, down = tc.powers(len(ids) + 1)
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(code[ids] * up[: len(ids)], out=total[1:])
    return tc.mix((total[end] - total[start]) * down[start])


class Aligner:
    """Aligns texts with two tokenizers of given id bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (a_bytes, b_bytes)
        self.lens = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        r = np.random.Generator(np.random.PCG64(13))
        self.codes = [tuple(r.integers(1, 2**63, len(side), dtype=np.uint64) for side in self.bytes) for _ in range(2)]
        self.words = tuple([str(i) for i in range(len(side))] for side in self.bytes)

    def same(self, whole: bytes, ids: tuple[list[int], list[int]]) -> bool:
        return all(b"".join(map(table.__getitem__, x)) == whole for table, x in zip(self.bytes, ids, strict=True))

    def groups(self, a: np.ndarray, b: np.ndarray):
        """Of token ids of the same bytes: bounds of groups in a and in b, two hashes of each, and its last ids."""
        end_a, end_b = np.cumsum(self.lens[0][a]), np.cumsum(self.lens[1][b])
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)
        last_b = at[last_a]
        bounds = tuple((np.concatenate(([0], x[:-1] + 1)), x + 1) for x in (last_a, last_b))
        h = [sequences(a, *bounds[0], c[0]) * tc.MUL_A + sequences(b, *bounds[1], c[1]) for c in self.codes]
        return bounds, tc.mix(h[0]), tc.mix(h[1]), a[last_a], b[last_b]

    def text(self, a: np.ndarray, b: np.ndarray) -> str:
        return ",".join(map(self.words[0].__getitem__, a.tolist())) + "|" + ",".join(map(self.words[1].__getitem__, b.tolist()))


class Unit:
    """Distinct groups of some documents in a row: numbers by hash, texts, frequencies, link pairs."""

    def __init__(self):
        self.number: dict[int | tuple[int, int], int] = {}  # by the first hash, or by both where another group has it
        self.second: list[int] = []
        self.texts: list[str] = []
        self.size = 0
        self.g, self.pair, self.freq = (np.empty(0, np.int64) for _ in range(3))

    def intern(self, al: Aligner, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each group of the token ids, and where its A ids end."""
        bounds, h1, h2, la, lb = al.groups(a, b)
        _, first, inverse, count = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
        if not (h2[first][inverse] == h2).all():  # two groups of one hash
            _, first, inverse, count = np.unique(np.stack((h1, h2), 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            inverse = inverse.ravel()
        (sa, ea), (sb, eb) = bounds
        own, known, new = np.empty(len(first), np.int64), self.number, []
        for k, (x, y) in enumerate(zip(h1[first].tolist(), h2[first].tolist(), strict=True)):
            n = known.get(x)
            if n is not None and self.second[n] != y:
                x = (x, y)
                n = known.get(x)
            if n is None:
                n = known[x] = len(self.second)
                self.second.append(y)
                new.append(k)
            own[k] = n
        if new:
            i = first[new]
            for s, e, t, u in zip(sa[i].tolist(), ea[i].tolist(), sb[i].tolist(), eb[i].tolist(), strict=True):
                self.texts.append(al.text(a[s:e], b[t:u]))
            self.g = np.concatenate((self.g, h1[i].view(np.int64)))
            self.pair = np.concatenate((self.pair, la[i].astype(np.int64) << 32 | lb[i].astype(np.int64)))
            self.freq = np.concatenate((self.freq, np.zeros(len(new), np.int64)))
        self.freq[own] += count
        return own[inverse], ea


def _encode(sent_a, sent_b, id_kind: pa.DataType, with_text: bool):
    """Rows of documents (at: place in the unit) and, after those of a unit, of its dictionary (no: number of the group)."""
    names = ["unit", "at", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "nos", "freqs", "no", "g", "pair", "freq", "groups"]
    kinds = [pa.int64(), pa.int32(), id_kind, *[pa.int64()] * 3, pa.string(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 3, pa.string()]

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(columns["unit"])
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, second = in_worker(sent_a.value, ".json", PlainBpe), in_worker(sent_b.value, ".model", Pieces)
        al = _aligner(first, second)
        base, serial, unit, at = TaskContext.get().partitionId() << 32, 0, Unit(), 0

        def documents(own: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal at
            n = len(texts)
            n_a, n_b, n_groups = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            shas, nos, freqs = [""] * n, [b""] * n, [b""] * n
            asked = [i for i in range(n) if texts[i]]
            a_ids = {i: np.frombuffer(first.encode(" " + texts[i]), first.kind).astype(np.int64) for i in asked}
            b_ids = dict(zip(asked, second.encode([texts[i] for i in asked]), strict=True)) if asked else {}
            good = [i for i in asked if al.same(b" " + texts[i].encode(), (a_ids[i].tolist(), b_ids[i]))]
            if good:
                sides = [np.concatenate([np.asarray(x[i], np.int64) for i in good]) for x in (a_ids, b_ids)]
                number, stop = unit.intern(al, *sides)
                n_a[good], n_b[good] = [len(a_ids[i]) for i in good], [len(b_ids[i]) for i in good]
                cuts = np.concatenate(([0], np.searchsorted(stop, np.cumsum(n_a[good]), "right")))  # groups don't cross documents
                n_groups[good] = np.diff(cuts)
                doc = np.repeat(np.arange(len(good)), np.diff(cuts))
                key, count = np.unique(doc << 32 | number, return_counts=True)
                stops = np.searchsorted(key, np.arange(len(good) + 1) << 32)
                no, count, flat = (key & 0xFFFFFFFF).astype("<u4"), count.astype("<u4"), number.tolist()
                for k, i in enumerate(good):
                    shas[i] = hashlib.sha256(";".join(map(unit.texts.__getitem__, flat[cuts[k] : cuts[k + 1]])).encode()).hexdigest()
                    nos[i], freqs[i] = no[stops[k] : stops[k + 1]].tobytes(), count[stops[k] : stops[k + 1]].tobytes()
            at += n
            return batch_of(unit=[base + serial] * n, at=list(range(at - n, at)), doc_id=own, n_a=n_a, n_b=n_b, n_groups=n_groups, groups_sha256=shas, nos=nos, freqs=freqs)

        def dictionary() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(unit.g), 1 << 16):
                n = len(unit.g[lo : lo + (1 << 16)])
                more = {"groups": unit.texts[lo : lo + n]} if with_text else {}
                yield batch_of(unit=[base + serial] * n, no=np.arange(lo, lo + n, dtype=np.int32), g=unit.g[lo : lo + n], pair=unit.pair[lo : lo + n], freq=unit.freq[lo : lo + n], **more)

        for batch in batches:
            _, offs = tc.text_bytes(batch.column("text"))
            for lo, hi in tc.chunks(offs, PART):
                part = batch.slice(lo, hi - lo)
                yield documents(part.column("doc_id"), [x or "" for x in part.column("text").to_pylist()])
                unit.size += int(offs[hi] - offs[lo])
                if len(unit.g) >= UNIT_GROUPS or unit.size >= UNIT_BYTES:
                    yield from dictionary()
                    serial, unit, at = serial + 1, Unit(), 0
        yield from dictionary()

    return run


_aligners: dict[tuple[int, int], Aligner] = {}


def _aligner(first: ByteBpe, second: Pieces) -> Aligner:
    key = id(first), id(second)
    if key not in _aligners:
        _aligners[key] = Aligner(first.id_bytes(), second.id_bytes())
    return _aligners[key]


def _sum(key, docs: pa.Table, worth: pa.Table) -> pa.Table:
    """Documents of a unit with the sums of their groups' worth times frequency."""
    size = worth.num_rows
    best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    no = worth.column("no").to_numpy()
    best[no], total[no] = worth.column("n_best").to_numpy(), worth.column("count_sum").to_numpy()
    out = ([], [])
    for nos, freqs in zip(docs.column("nos").to_pylist(), docs.column("freqs").to_pylist(), strict=True):
        x, f = np.frombuffer(nos, "<u4"), np.frombuffer(freqs, "<u4").astype(np.int64)
        out[0].append(int((best[x] * f).sum()))
        out[1].append(int((total[x] * f).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
    return kept.append_column("n_links", docs.column("n_groups")).append_column("n_best", pa.array(out[0], pa.int64())).append_column("count_sum", pa.array(out[1], pa.int64()))


def align(docs: DataFrame, a_path: str, b_path: str, *, dictionary: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, pairs, groups) of docs (doc_id, text). A encodes a blank and the text by the tokenizers file a_path, B the text by the sentencepiece
    model b_path, both whole and without special tokens, whose strings in a text are plain text.

    documents, a row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's highest count, ties included),
    count_sum (sum of the links' counts), groups_sha256. pairs: a_id, b_id, count (links of all documents), best. groups, if dictionary is set: groups
    (`a1,a2|b1`), freq.

    A text that is null or empty, or whose tokens' bytes are not the blank and the text, has no tokens: zeros and the empty
    string. Rows are counted one by one, so repeated rows and repeated or null doc_ids are documents of their own. Long texts are taken whole: a unit
    has one at least, and else at most UNIT_BYTES bytes and about UNIT_GROUPS distinct groups. An empty table gives empty results. Other columns
    are not read, whatever their names."""
    spark = ship(docs.sparkSession)
    sent = []
    for p in (a_path, b_path):
        with open(p, "rb") as f:
            sent.append(spark.sparkContext.broadcast(f.read()))
    docs = docs.select("doc_id", "text")
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    facts = "n_a long, n_b long, n_groups long, groups_sha256 string"
    kind = f"unit long, at int, doc_id {id_kind}, {facts}, nos binary, freqs binary, no int, g long, pair long, freq long, groups string"
    with Scratch(spark) as s:
        table = s.write(docs.mapInArrow(_encode(*sent, to_arrow_type(docs.schema["doc_id"].dataType), dictionary), kind), "align-units")
        entries, key = table.where("no IS NOT NULL"), ["g", "pair"]
        distinct = s.write(entries.groupBy(*key).agg(F.sum("freq").alias("freq"), F.first("groups").alias("groups")), "align-groups")
        links = distinct.select("pair", "freq")  # the one link of each distinct group
        pairs = links.groupBy("pair").agg(F.sum("freq").alias("count")).select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "count")
        highest = pairs.groupBy("b_id").agg(F.max("count").alias("most"))
        pairs = s.keep(pairs.join(highest, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best")), "align-pairs")
        worth = distinct.select(*key).join(pairs.select("pair", F.col("best").cast("long").alias("n_best"), F.col("count").alias("count_sum")), "pair")
        back = entries.select("unit", "no", *key).join(worth, key).select("unit", "no", "n_best", "count_sum")
        own = table.where("at IS NOT NULL").select(F.col("unit").alias("of"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "nos", "freqs")
        out = own.groupBy("of").cogroup(back.groupBy("unit")).applyInArrow(_sum, f"doc_id {id_kind}, {facts}, n_links long, n_best long, count_sum long")
        out = s.keep(out, "align-documents")
        groups = s.keep(distinct.select("groups", "freq"), "align-dictionary") if dictionary else None
    return out, pairs.drop("pair"), groups


def digest(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
