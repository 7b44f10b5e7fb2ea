"""Personal data: base patterns, and a linear-chain conditional random field over word-shape features.

The field is trained on the driver from a small labelled table and decoded by Viterbi in numpy batches.
Its spans are added where they meet no base span; base spans always stay. Labels: o, email, phone, secret
(base kinds ip and card have rules a shape can't learn).

Every word's label scores are computed. A word at which no label beats `o` by more than the transitions
could ever give is `o` in every best path, so the chain falls into stretches between such words, and
only those stretches are decoded, padded to batches of equal length: the result is that of whole texts.

Null and empty texts have no spans; an empty table gives no rows; repeated rows, and rows whose doc_id is null or
repeats, are searched one by one. Texts of any length are searched whole. Offsets are code points.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.llm import textcore as tc
from bytelens.runtime import ship

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("o", "email", "phone", "secret")
TABLE = 1 << 14

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a start inside a run of digits matches only if the run's first digit does, hence the look-behind
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Lines without personal data, invented.
PLAIN = [
    "tirondea.*** belonewar.$$$ and sumtirond.### then halowent.&&& moritane.%%%",
    "Belonewa.*** Moritane,$$$ halowentis.### over sumtirondeal.*** walde.&&&",
    "größtemil.*** vérodante.$$$ ñumarale.%%% wo brindelhaft,### Teloria.*** ist",
    "falomerint.*** by calorwint.*** to dunmarelo.$$$ sev.*** Ormaline.&&&",
    'the quick brown fox jumps over the lazy dog',
    'it was on the table, and they went home.',
    'She said that it is fine, or not.',
    'a token of thanks for the work',
    'the key to the house is lost',
    'token = none was set here',
    'the secret = a word they kept',
    'his password: he forgot it',
    'Élan vital et déjà vu dans la forêt, où été',
    'Über die Brücke ging er, und zurück.',
    'que no está en el año más frío',
    'call me when the phone is on the desk',
    'the password was lost at sea',
    "les êtres où l'on était, ça va là",
    'größer als die Straße, schön über Fluß',
    'mañana será otro día, señor Ibáñez',
    'in 1999 there were 23904 of them',
    'page 12 of 340, volume 7',
    'numbers 9807915762804490 and 4845168114407329 stay',
    'version 2.0 and 3.11 of it',
    'at 10:30 on 2024-01-05 it rained',
    'a sum of 12345678 or 87654321 units',
    'row 10.0.0.1 and 192.168.7.9 answer',
    'THIS IS ALL UPPER CASE!! REALLY!! YES!!',
    'SOME!! WORDS!! HERE!! AND!! THERE!!',
    'noise*** here%%% and### there$$$ with&&& it***',
    'the&&& on%%% of*** to### is$$$ a***',
    'a | b | c | 12 | d | 34',
    'one, | two | three. | four |',
    '| - | = | + | * | # |',
    'x = 5 and y = 7 in the list',
    'ratio: 3 to 4, see (1) and [2]',
    'see http://site.sample/path?x=1 for more',
    '\'quoted\' words and "others" too',
    'Licensed under CC BY-NC 4.0.',
    'Released under the MIT License.',
    'Copyright (c) 2019, 2021 by the authors.',
    'at the end of the day, dot by dot',
    'well-known state-of-the-art (mostly) things',
    'the sum is 1,234.50 today',
    'items 12-15 and 3-4 (see 7)',
    'on 5 and 55 and 555 days',
    'code A1 and B22 or C-3',
    'an mp3 of the B52 in sha256 form',
    'COVID19 and ISO8601 are names, utf8 too',
    'chapter3 to chapter12 of book2',
    'to to to to to to to to to to',
    'So, So, So, So, So, So,',
    'Wulen. Wulen. Wulen. Wulen. Wulen.',
    'Nómúr. Nómúr. Nómúr. Nómúr.',
    'tirondéa ob ze tirondéa ob ze',
    'of,*** on.%%% The&&& in.### By%%% it.&&& was***',
    'is.&&& no,&&& LOUD,!! NOW.!! AND!!',
    'on was the of it is and or in to',
    'Éa bim, çor. Öd über, Ñan. ßu.',
]
#: Forms of personal data: {w5} is five small letters, n digits, h hex digits, x letters and digits, X capitals and digits.
FORMS = {
    "email": ["{w5}@{w5}", "{w4}.{w4}@{w6}.{w3}", "{w6}@{w5}.{w3}", "<{w4}@{w5}.{w2}>", "({w6}@{w4})", "{w5}_{w1}@{w4}.{w2}.{w2}", "{w4}+{w2}@{w5}.{w3},", "{w3}{n2}@{w5}.", "mailto:{w4}@{w7}.{w4}", "{w5}@{w6},", "{w4}{n3}@{w6}", "{w3}@{w4}{n1}"],
    "phone": ["({n3}) {n3}-{n4}", "0{n3} {n6}", "0{n2} {n4} {n4}", "0{n2} {n6}", "0{n4} {n3} {n4}", "{n3}-{n3}-{n4}", "({n3}) {n3}-{n4},", "0{n3}-{n6}", "{n3}-{n4}", "{n3}-{n4}."],
    "secret": [
        'api_key = |"{h32}"', "password: |{x12}{n2}", 'secret = |"{h20}"', "key: |AKIA{X16}", "|ghp_{x36}", "client_secret: |'{x32}'", "AWS_SECRET= |{x40}", "|sk_live_{x24}", "hash |{h40}", 'auth = |"{h40}"###', "|glpat-{x20},", "bearer |{x30}_{x10}",
        'private: |"{h64}"', "pwd= |{x10}{n2}", "|{w4}-{n11}-{x24}", "id |AKIA{X16}.", "access_key |{x28}", 'pass |"{x14}{n2}"!!!', 'cert = |"{h40}",', "|npm_{x36}",
    ],
}
CONTEXTS = ["please use @ before noon", "it is @ and so on", "he wrote @ there", "see @ for more", "où est @ été là"]
_CHARS = {"w": "abcdefghijklmnopqrstuvwxyz", "n": "123456789", "h": "0123456789abcdef", "x": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}


def labelled_lines(each: int = 4, seed: int = 11) -> list[str]:
    """A labelled table; [kind|words] marks a span. Values are drawn at random, so none stands in any data. What names a
    value (hash, bearer, key:) is part of its line, not of the span."""
    r = random.Random(seed)
    out = list(PLAIN)
    for kind, forms in FORMS.items():
        for form in forms * each:
            lead, _, value = form.rpartition("|")
            value = re.sub(r"\{(.)(\d+)\}", lambda m: "".join(r.choice(_CHARS[m[1]]) for _ in range(int(m[2]))), value)
            out.append(r.choice(CONTEXTS).replace("@", f"{lead}[{kind}|{value}]"))
    return out


LABELLED = labelled_lines()

# classes of bytes: each is a bit of a word's shape mask
_CLASS = np.full(256, 11, np.int64)
for _n, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"@", b".", b"-_", b"+", b"()[]", b"\"'", b",;:", b"=/&?#%"]):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 0
_BIT = (1 << _CLASS).astype(np.int64)
_CLASS_CODE = tc.BYTE_CODE[_CLASS]


def features(w: tc.Words) -> np.ndarray:
    """Eight hashed features of each word: mask; mask and length; collapsed shape; word before; masks beside; how often
    classes change, with length and whether letters and digits mix;
    whether it has an @, with length."""
    n = len(w.start)
    if not n:
        return np.empty((0, 8), np.int64)
    buf = w.buf
    mask = np.bitwise_or.reduceat(np.where(tc.NONBLANK[buf], _BIT[buf], 0), w.start)
    length = w.end - w.start
    cls = _CLASS[buf]
    turn = np.concatenate(([True], cls[1:] != cls[:-1]))
    turn[w.start] = True
    nth = np.cumsum(turn)
    up, down = tc.powers(len(buf) + 2)
    total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(turn, _CLASS_CODE[buf] * up[nth], np.uint64(0)))])
    shape = (total[w.end] - total[w.start]) * down[nth[w.start]]
    first_of_row = np.zeros(n, bool)
    heads = w.bounds[:-1][w.bounds[:-1] < n]
    first_of_row[heads] = True
    before = np.where(first_of_row, np.uint64(1), np.roll(w.hash, 1))
    mask_before = np.where(first_of_row, 1 << 13, np.roll(mask, 1))
    last_of_row = np.roll(first_of_row, -1)
    last_of_row[-1] = True
    mask_after = np.where(last_of_row, 1 << 13, np.roll(mask, -1))
    size = np.minimum(length, 48) // 4
    turns = np.minimum(nth[w.end - 1] - nth[w.start], 31) // 3
    mixed = ((mask & 3) > 0) & ((mask & 4) > 0)
    cols = [mask.astype(np.uint64), (mask * 64 + size).astype(np.uint64), shape, before, mask_before.astype(np.uint64), mask_after.astype(np.uint64), ((turns * 16 + size) * 2 + mixed).astype(np.uint64), ((mask >> 3 & 1) * 64 + size).astype(np.uint64)]
    return np.stack([(tc.mix(c * np.uint64(8) + np.uint64(k)) % np.uint64(TABLE)).astype(np.int64) for k, c in enumerate(cols)], 1)


class Field:
    """Weights (features by labels) and transitions (labels by labels)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        # if a word's label y loses to o between any two neighbours, no best path gives it y
        n = len(LABELS)
        m = moves
        self.lift = np.array([max(m[p, y] + m[y, q] - m[p, 0] - m[0, q] for p in range(n) for q in range(n)) for y in range(1, n)])

    def decode(self, scores: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Best labels; fresh: where rows begin. Stretches run between words that are surely o."""
        n = len(scores)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        gain = (scores[:, 1:] - scores[:, :1] + self.lift).max(1)
        open_ = gain >= 0
        if not open_.any():
            return out
        start = np.flatnonzero(open_ & (np.concatenate(([True], ~open_[:-1])) | fresh))
        stop_at = np.flatnonzero(open_ & (np.concatenate((~open_[1:], [True])) | np.concatenate((fresh[1:], [True])))) + 1
        size = stop_at - start
        # a stretch stands between o's; at a row's ends a virtual o stands, as in training
        for group in np.split(np.argsort(size, kind="stable"), np.flatnonzero(np.diff(np.sort(size))) + 1):
            m = int(size[group[0]])
            for i in range(0, len(group), max(1, 200_000 // m)):
                g = group[i : i + max(1, 200_000 // m)]
                at = start[g][:, None] + np.arange(m)
                e = scores[at]
                best = e[:, 0] + self.moves[0]
                back = np.empty((len(g), m, len(LABELS)), np.int8)
                for k in range(1, m):
                    cand = best[:, :, None] + self.moves
                    back[:, k] = cand.argmax(1)
                    best = cand.max(1) + e[:, k]
                y = (best + self.moves[:, 0]).argmax(1)
                for k in range(m - 1, -1, -1):
                    out[at[:, k]] = y
                    if k:
                        y = back[np.arange(len(g)), k, y]
        return out


def parse_labelled(line: str) -> tuple[str, list[int]]:
    """The text and its words' labels."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|phone|secret)\|(.*?)\](?=[\s.,]|$)(?![^\[|]*\] )", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), LABELS.index(m[1])))
        text += m[2]
        at = m.end()
    text += line[at:]
    labels = [next((k for a, b, k in spans if a <= m.start() < b), 0) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return text, labels


def train(lines: list[str], *, rounds: int = 120, rate: float = 0.3, shrink: float = 0.0004) -> Field:
    """Maximum likelihood by forward-backward and AdaGrad; the same table gives the same weights."""
    n = len(LABELS)
    weights, moves = np.zeros((TABLE, n)), np.zeros((n, n))
    gw, gm = np.full((TABLE, n), 1e-6), np.full((n, n), 1e-6)
    data = []
    for line in lines:
        text, y = parse_labelled(line)
        raw = np.frombuffer(text.encode(), np.uint8)
        data.append((features(tc.Words(raw, np.array([0, len(raw)]), 0, 1, tc.NONBLANK)), np.array(y)))
    for _ in range(rounds):
        dw, dm = np.zeros_like(weights), np.zeros_like(moves)
        for f, y in data:
            e = weights[f].sum(1)
            m = len(y)
            fwd, bwd = np.empty((m, n)), np.empty((m, n))
            fwd[0] = moves[0] + e[0]
            for k in range(1, m):
                fwd[k] = np.logaddexp.reduce(fwd[k - 1][:, None] + moves, 0) + e[k]
            bwd[-1] = moves[:, 0]
            for k in range(m - 2, -1, -1):
                bwd[k] = np.logaddexp.reduce(moves + e[k + 1] + bwd[k + 1], 1)
            z = np.logaddexp.reduce(fwd[-1] + bwd[-1])
            g = -np.exp(fwd + bwd - z)
            g[np.arange(m), y] += 1
            np.add.at(dw, f.ravel(), np.repeat(g, f.shape[1], 0))
            path = np.concatenate(([0], y, [0]))
            np.add.at(dm, (path[:-1], path[1:]), 1)
            for k in range(1, m):
                dm -= np.exp(fwd[k - 1][:, None] + moves + e[k] + bwd[k] - z)
            dm[0] -= np.exp(moves[0] + e[0] + bwd[0] - z)
            dm[:, 0] -= np.exp(fwd[-1] + moves[:, 0] - z)
        dw -= shrink * len(data) * weights
        dm -= shrink * len(data) * moves
        gw += dw**2
        gm += dm**2
        weights += rate * dw / np.sqrt(gw)
        moves += rate * dm / np.sqrt(gm)
    return Field(weights.astype(np.float32), moves)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ matches from the left, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at)):
            a = at
            while a > done and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def field_spans(field: Field, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> dict[int, list[tuple[int, int, int]]]:
    """Row to (start, number of the kind, end) in bytes: runs of words of one label, without outer blanks."""
    w = tc.Words(data, offs, lo, hi, tc.NONBLANK)
    f = features(w)
    n = len(f)
    if not n:
        return {}
    scores = field.weights[f[:, 0]].copy()
    for k in range(1, f.shape[1]):
        scores += field.weights[f[:, k]]
    fresh = np.zeros(n, bool)
    fresh[w.bounds[:-1][w.bounds[:-1] < n]] = True
    y = field.decode(scores, fresh)
    out: dict[int, list[tuple[int, int, int]]] = {}
    hit = np.flatnonzero(y)
    row = np.searchsorted(w.bounds, hit, "right") - 1
    cuts = offs[lo : hi + 1] - offs[lo]
    last = None
    for i, r in zip(hit.tolist(), row.tolist(), strict=True):
        kind = KINDS.index(LABELS[y[i]])
        a, b = int(w.start[i] - cuts[r]), int(w.end[i] - cuts[r])
        if last is not None and last == (i - 1, r, kind):
            s = out[lo + r][-1]
            out[lo + r][-1] = (s[0], kind, b)
        else:
            out.setdefault(lo + r, []).append((a, kind, b))
        last = (i, r, kind)
    return out


def code_points(raw: np.ndarray, places: list[int]) -> list[int]:
    """Code points before each byte place; the text is walked once."""
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return upto[places].tolist()


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(LABELLED)], "line_id long, marked string")


def find_pii(docs: DataFrame, labelled: DataFrame | None = None, *, most_lines: int = 2000) -> DataFrame:
    """doc_id and spans: array of kind, start, end (code points), base (found by a base pattern), by start,
    then kind in the order of KINDS. labelled: line_id, marked; at most most_lines lines train the field
    (the first by line_id). A row for each row; other columns are not read, so their names don't matter."""
    spark = ship(docs.sparkSession)
    lines = LABELLED if labelled is None else [r[0] for r in labelled.orderBy("line_id").select("marked").limit(most_lines).collect()]
    sent = spark.sparkContext.broadcast(train(lines))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text")
            data, offs = tc.text_bytes(col)
            for lo, hi in tc.chunks(offs):
                more = field_spans(sent.value, data, offs, lo, hi)
                rows = []
                for i, text in enumerate(col.slice(lo, hi - lo).to_pylist(), lo):
                    spans = [(a, k, b, True) for a, k, b in base_spans(text or "")]
                    if i in more:
                        taken = [(a, b) for a, _, b, _ in spans]
                        place = code_points(data[offs[i] : offs[i + 1]], [x for a, _, b in more[i] for x in (a, b)])
                        for (_, k, _), a, b in zip(more[i], place[::2], place[1::2], strict=True):
                            at = bisect.bisect_left(taken, (a, a))  # base spans are sorted; those of one kind don't overlap
                            if all(b <= x or a >= z for x, z in taken[max(0, at - len(KINDS)) : at + 1]) and (at >= len(taken) or b <= taken[at][0]):
                                spans.append((a, k, b, False))
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": z} for a, k, b, z in sorted(spans)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, kind)], names=["doc_id", "spans"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_field"))

