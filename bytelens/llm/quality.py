"""Quality classifier from weak labels: expectation-maximisation over overlapping heuristic labellers, then a
hashed linear scorer.

1. Each labeller looks at one statistic and votes good, bad or abstains; several see the same faults, and each errs
   on some documents of either class. Vote patterns are counted over all documents by
   Spark; there are at most 3 ** len(LABELLERS) patterns, whatever the input.
2. EM on the pattern counts estimates the share of good documents and each labeller's vote probabilities in
   either class (its accuracy) from how votes agree, starting from two labellers that say bad, as a fault shows to some of them only; it gives each pattern a
   posterior. Nothing bounds the estimates but a count of one that each outcome starts with.
3. A logistic scorer on hashed shape features learns the posteriors from at most train_rows documents, the
   first by a hash of doc_id and text: the documented bound of what the driver fits on. Everything else covers all rows.
4. All documents are scored; a document is accepted from a score of 0.5.

No ground truth is read. Null and empty texts get no votes but abstentions and the prior; they are scored as texts
without words and accepted, as nothing speaks against them. Repeated rows are scored as they come, as are rows whose
doc_id is null or repeats. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from bytelens.llm import textcore as tc
from bytelens.runtime import ship

DIM = 1024

_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LOWERS = ((_B >= 97) & (_B <= 122)) | (_B >= 128)
DIGIT = (_B >= 48) & (_B <= 57)
SYMBOL = np.isin(_B, list(b"#$%&*+/<=>@[\\]^_`{|}~!"))

#: A labeller for each statistic: its name, bad from, good up to; between them it abstains.
FAULTS = (
    ("symbols", 0.02, 0.01),
    ("capitals", 0.10, 0.05),
    ("digits", 0.03, 0.02),
    ("repetition", 0.62, 0.50),
    ("one word", 0.12, 0.09),
    ("marked words", 0.04, 0.02),
    ("bare symbols", 0.01, 0.005),
    ("repeated pairs", 0.20, 0.08),
)
LABELLERS = tuple(f[0] for f in FAULTS)
BAD_FROM, GOOD_TO = np.array([f[1] for f in FAULTS]), np.array([f[2] for f in FAULTS])
#: Words a text needs before labellers of word statistics vote.
LEAST_WORDS = 20


def statistics(w: tc.Words) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' statistics of each row, and its number of words."""
    buf, n_rows = w.buf, len(w.bounds) - 1
    row, n = w.row, np.diff(w.bounds)
    out = np.zeros((n_rows, len(FAULTS)))
    length = w.end - w.start
    nonblank = np.maximum(np.bincount(row, length, n_rows), 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[buf])])
        return total[w.end] - total[w.start]

    symbols, capitals, lowers, digits = map(per_word, (SYMBOL, UPPER, LOWERS, DIGIT))
    out[:, 0] = np.bincount(row, symbols, n_rows) / nonblank
    out[:, 1] = np.bincount(row, capitals, n_rows) / np.maximum(np.bincount(row, capitals + lowers, n_rows), 1)
    out[:, 2] = np.bincount(row, digits, n_rows) / nonblank
    marked = (symbols > 0) & (symbols < length)
    out[:, 5] = np.bincount(row, marked, n_rows) / np.maximum(n, 1)
    out[:, 6] = np.bincount(row, symbols == length, n_rows) / np.maximum(n, 1)
    pairs = tc.shingles(w.hash, 2)
    for i in range(n_rows):
        p = np.sort(pairs[w.bounds[i] : max(w.bounds[i], w.bounds[i + 1] - 1)])
        if len(p):
            out[i, 7] = (p[1:] == p[:-1]).mean() if len(p) > 1 else 0.0
        h = np.sort(w.hash[w.bounds[i] : w.bounds[i + 1]])
        if len(h):
            cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            # long texts repeat words anyway: distinct words against the square root-like growth of vocabularies
            out[i, 3] = 1 - (len(cut) - 1) / len(h) ** 0.9 if len(h) > 100 else 1 - (len(cut) - 1) / len(h)
            out[i, 4] = np.diff(cut).max() / len(h)
    return out, n


def votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1 good, 2 bad, 0 abstains; a column for each labeller."""
    v = np.where(stats >= BAD_FROM, 2, np.where(stats <= GOOD_TO, 1, 0))
    v[n < LEAST_WORDS] = 0
    return v


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def features(w: tc.Words, stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashed shape features of each row, as a share of its words, and its statistics in steps."""
    n_rows = len(n)
    bit = np.zeros(256, np.int64)
    for k, m in enumerate((UPPER, LOWERS, DIGIT, SYMBOL)):
        bit[m] = 1 << k
    bit[(bit == 0) & (_B > 32)] = 16
    x = np.zeros((n_rows, DIM), np.float32)
    if len(w.start):
        mask = np.bitwise_or.reduceat(np.where(tc.NONBLANK[w.buf], bit[w.buf], 0), w.start)
        size = np.minimum(w.end - w.start, 24) // 4
        shape = mask * 8 + size
        same = np.concatenate(([0], (w.hash[1:] == w.hash[:-1]).astype(np.int64)))
        pair = np.concatenate(([0], shape[:-1])) * 512 + shape
        for k, c in enumerate((shape, pair, same + 4096)):
            slot = (tc.mix((c * 4 + k).astype(np.uint64)) % np.uint64(DIM)).astype(np.int64)
            x += np.bincount(w.row * DIM + slot, minlength=n_rows * DIM).reshape(n_rows, DIM)
    x /= np.maximum(n, 1)[:, None]
    steps = np.minimum((stats * 20).astype(np.int64), 20)
    for k in range(stats.shape[1]):
        slot = (tc.mix((steps[:, k] * 64 + k + 100_000).astype(np.uint64)) % np.uint64(DIM)).astype(np.int64)
        x[np.arange(n_rows), slot] += np.where(n >= LEAST_WORDS, 1.0, 0.0)
    return x


def fit_votes(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each pattern, P(vote | class) (good and bad, labellers, votes) and the prior, by EM; an
    abstention is an outcome like a vote."""
    m = len(LABELLERS)
    codes = np.array(sorted(k for k in counts if k), np.int64)  # where no labeller speaks, the prior stands
    if not len(codes):
        return {}, np.full((2, m, 3), 1 / 3), 0.5
    c = np.array([counts[k] for k in codes.tolist()], float)
    v = codes[:, None] // 3 ** np.arange(m) % 3
    post = np.where((v == 2).sum(1) > 1, 0.1, 0.9)
    for _ in range(rounds):
        good, bad = c * post, c * (1 - post)
        prior = (good.sum() + 1) / (c.sum() + 2)
        p = np.array([[[w[v[:, k] == x].sum() for x in range(3)] for k in range(m)] for w in (good, bad)]) + 1.0
        p /= p.sum(2, keepdims=True)
        ll = np.stack([np.log(p[y][np.arange(m), v]).sum(1) for y in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(ll[1] - ll[0] + np.log((1 - prior) / prior), -50, 50)))
    return dict(zip(codes.tolist(), post.tolist(), strict=True)), p, float(prior)


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    if not len(x):
        return np.zeros(DIM, np.float32), 2.0
    w, b, vw, vb, y = np.zeros(DIM, np.float32), 0.0, np.zeros(DIM, np.float32), 0.0, y.astype(np.float32)
    rate = np.float32(4.0) / np.float32(max(1.0, float(np.einsum('ij,ij->i', x, x).mean()) + 1))
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ (w + np.float32(0.9) * vw) + np.float32(b + 0.9 * vb), -50, 50))) - y
        vw = np.float32(0.9) * vw - rate * (g @ x / np.float32(len(x)) + np.float32(shrink) * w)
        vb = 0.9 * vb - float(rate) * float(g.mean())
        w, b = w + vw, b + vb
    return w.astype(np.float32), float(b)


def _per_chunk(batch: pa.RecordBatch, col: str = "text"):
    data, offs = tc.text_bytes(batch.column(col))
    for lo, hi in tc.chunks(offs):
        w = tc.Words(data, offs, lo, hi, tc.NONBLANK)
        yield lo, hi, w, *statistics(w)


def count_votes(docs: DataFrame) -> dict[int, int]:
    """How many documents have each pattern of votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, stats, n in _per_chunk(batch):
                code, count = np.unique(pattern(votes(stats, n)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])

    ship(docs.sparkSession)
    return {r[0]: r[1] for r in docs.select("text").mapInArrow(vote, "code long, n long").groupBy("code").agg(F.sum("n")).collect()}


def classify(docs: DataFrame, *, train_rows: int = 6000, keep_columns: list[str] | None = None) -> DataFrame:
    """Rows of docs (keep_columns, all by default) with n_words, votes (a code), posterior (of good, by the
    labellers), score (of good, by the scorer) and accept. Columns of these names in docs are replaced."""
    spark = ship(docs.sparkSession)
    own = [T.StructField("n_words", T.LongType()), T.StructField("votes", T.LongType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("accept", T.BooleanType())]
    keep = [c for c in (keep_columns or docs.columns) if c not in {f.name for f in own}]

    counts = count_votes(docs)
    posterior, _, prior = fit_votes(counts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("h")
            for lo, hi, w, stats, n in _per_chunk(batch):
                x = features(w, stats, n).astype(np.float16)
                yield pa.RecordBatch.from_arrays([at.slice(lo, hi - lo), pa.array(pattern(votes(stats, n))), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "code", "x"])

    rows = sum(counts.values())
    # about twice the bound by the hash's own range, made features where they lie, then the first train_rows of them
    near = F.xxhash64(F.lit(3), "doc_id", "text")
    most = -(2**63) + int(2**64 * min(1.0, 2 * train_rows / max(1, rows))) - 1
    chosen = docs.where(near <= most).select("text", near.alias("h")).mapInArrow(sample, "h long, code long, x binary")
    got = chosen.orderBy("h", "code").limit(train_rows).select("code", "x").collect()
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float16).reshape(-1, DIM).astype(np.float32)
    model = spark.sparkContext.broadcast((posterior, prior, *fit_scorer(x, np.array([posterior.get(r[0], prior) for r in got]))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, prior, weights, bias = model.value
        for batch in batches:
            for lo, hi, w, stats, n in _per_chunk(batch):
                code = pattern(votes(stats, n))
                s = 1 / (1 + np.exp(-np.clip(features(w, stats, n) @ weights + bias, -50, 50).astype(np.float64)))
                accept = (s >= 0.5) | (n == 0)
                cols = [pa.array(n.astype(np.int64)), pa.array(code), pa.array([post.get(c, prior) for c in code.tolist()], pa.float64()), pa.array(s), pa.array(accept)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keep), *cols], names=[*keep, *(f.name for f in own)])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, T.StructType([*(docs.schema[c] for c in keep), *own]))
