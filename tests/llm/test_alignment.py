"""Alignment of two tokenizers against plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from bytelens.llm import alignment
from bytelens.llm.encoding import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, unit string, n_a int, groups_sha256 string"


def brute(texts):
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    back = {chr(v): k for k, v in byte_letters().items()}
    piece = lambda i: bytes([int(p[3:5], 16)]) if len(p := model.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, count = [], collections.Counter()
    for x in texts:
        a, b = (tok.encode(" " + x, add_special_tokens=False).ids, model.encode(x)) if x else ([], [])
        cut_a, cut_b = [bytes(back[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not x or b"".join(cut_a) != (" " + x).encode() or b"".join(cut_b) != (" " + x).encode():
            rows.append(None)
            continue
        ends = [{e: k for k, e in enumerate(np.cumsum([len(t) for t in side]).tolist())} for side in (cut_a, cut_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0][e]], b[ends[1][e]]) for e in both]
        groups, p, q = [], 0, 0
        for e in both:
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            p, q = i, j
        count.update(links)
        rows.append((len(a), len(b), links, groups))
    best = collections.Counter()
    for (_, y), c in count.items():
        best[y] = max(best[y], c)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = r
            out.append((n_a, n_b, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, count, collections.Counter(g for r in rows if r for g in r[3])


def test_align(spark, monkeypatch):
    r = random.Random(6)
    pool = list("aäb z059.,\n\t") + ["the", " and", "ing", "  ", "漢", "🙂", "<|endoftext|>", "</s>", "<0x41>", "é"]
    texts = [None, "", " ", "▁a", "\x00", *("".join(r.choice(pool) for _ in range(r.randint(1, 80))) for _ in range(400)), "tall tree, " * 120_000]
    texts += texts[5:25]
    table = spark.createDataFrame([(i if i % 50 else None, x, "clash", 1, "clash") for i, x in enumerate(texts)], KIND)
    documents, pairs, groups = alignment.align(table, A, B, dictionary=True)
    want, count, freq = brute(texts)
    got = alignment.digest(documents).collect()
    assert sorted(tuple(x)[1:] for x in got) == sorted(want)
    for x in got:
        if x.doc_id is not None:
            assert tuple(x)[1:] == want[x.doc_id]
    assert {(x.a_id, x.b_id): x["count"] for x in pairs.collect()} == dict(count)
    assert {x.groups: x.freq for x in groups.collect()} == dict(freq)


def test_none(spark):
    documents, pairs, _ = alignment.align(spark.createDataFrame([], KIND), A, B)
    assert documents.count() == pairs.count() == 0
    documents, pairs, _ = alignment.align(spark.createDataFrame([(1, None, "", 0, ""), (2, "", "", 0, "")], KIND), A, B)
    assert sorted(map(tuple, alignment.digest(documents).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert pairs.count() == 0


def test_units():
    """Numbers and frequencies stay right across parts of a unit, and where two groups have one hash."""
    sides = [[b"a", b"b", b"ab", b"c"], [b"a", b"bc", b"b", b"c", b"ab"]]
    al = alignment.Aligner(*sides)
    a, b = np.array([0, 1, 3, 2, 3]), np.array([0, 1, 4, 3])
    unit, other = alignment.Unit(), alignment.Unit()
    n, stop = unit.intern(al, a, b)
    assert [unit.texts[i] for i in n] == ["0|0", "1,3|1", "2|4", "3|3"] and stop.tolist() == [1, 3, 4, 5]
    assert unit.intern(al, a, b)[0].tolist() == n.tolist() and unit.freq.tolist() == [2] * 4
    groups = al.groups
    al.groups = lambda *x: (lambda f, h1, *rest: (f, h1 * np.uint64(0), *rest))(*groups(*x))
    n, _ = other.intern(al, a, b)
    n2, _ = other.intern(al, a, b)
    assert [other.texts[i] for i in n] == ["0|0", "1,3|1", "2|4", "3|3"] and n.tolist() == n2.tolist() and other.freq.tolist() == [2] * 4
