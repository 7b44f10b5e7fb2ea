"""Suffix sorting, and removal of repeats against plain Python, with rows told apart by keys of their own."""

import collections
import hashlib
import random

import numpy as np
import pytest

from bytelens.llm import suffix_dedup


@pytest.mark.parametrize("seed,depth", [(1, 50), (2, 400), (3, 8), (4, 123)])
def test_order_of_suffixes(seed, depth):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab") for _ in range(600))
    text = b"".join(base[: r.randrange(600)] + bytes(r.choice(b"abc\x00\xff") for _ in range(r.randrange(40))) for _ in range(12)) + b"a" * 900
    order = suffix_dedup.two_stage(np.frombuffer(text, np.uint8), depth).tolist()
    assert sorted(order) == list(range(len(text)))
    cut = [text[p : p + depth] for p in order]
    # equal to the depth side by side, and in order but for what lies beyond it
    assert cut == sorted(cut)
    wanted = np.zeros(len(text), bool)
    wanted[r.sample(range(len(text)), len(text) // 7)] = True
    some = suffix_dedup.two_stage(np.frombuffer(text, np.uint8), depth, wanted).tolist()
    cut = [text[p : p + depth] for p in some]
    assert set(np.flatnonzero(wanted).tolist()) <= set(some) and cut == sorted(cut)


def brute(rows, short, length):
    """(n_bytes, n_removed, n_spans, kept_sha256, n_shared) of each text."""
    data = [(x or "").encode() for x in rows]
    seen, owners = collections.Counter(), collections.defaultdict(set)
    for i, x in enumerate(data):
        seen.update(x[p : p + length] for p in range(len(x) - length + 1))
        for p in range(len(x) - short + 1):
            owners[x[p : p + short]].add(i)
    out = []
    for x in data:
        gone, shared = np.zeros(len(x) + 1, bool), np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        for p in range(len(x) - short + 1):
            if len(owners[x[p : p + short]]) > 1:
                shared[p : p + short] = True
        kept = bytes(c for c, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest(), int(shared.sum())))
    return out


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("limit", [2048, 2])
def test_repeats_of_all_kinds(spark, limit):
    """Whole copies, near copies, passages of 300 and of 500 bytes, repeats inside one text, endings, ties and nulls."""
    r = random.Random(7)
    long, mid, tail = prose(r, 110), prose(r, 62), prose(r, 70)
    own = [prose(r, 120) for _ in range(8)]
    rows = [None, "", "short", own[0], own[0], own[1], own[1][:300] + "X" + own[1][300:], own[2] + long + own[3], long + own[4], own[5] + mid, mid + own[6], own[6] + " " + own[6], own[7] + tail, tail, "ab" * 700, "ab" * 500, "x" * 399, "x" * 400, "x" * 401]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, group_limit=limit)).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == brute(rows, 256, 400)


def test_one_id_with_two_texts(spark):
    r = random.Random(8)
    a, b = prose(r, 150), prose(r, 150)
    rows = [("1", a), ("1", b), ("2", b + " x"), (None, a[:50] + b[60:]), (None, None)]
    docs = spark.createDataFrame([(*x, 5, 6) for x in rows], "doc_id string, text string, first long, key long")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute([x for _, x in rows], 256, 400), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_groups_are_cut_into_few_cells(spark, monkeypatch):
    """Many near copies, a passage with many endings and beginnings, and many near copies in one document only: results are those of
    plain Python, and cells are a few for each context, not one for each start."""
    r = random.Random(11)
    base, passage, inner = prose(r, 130), prose(r, 100), prose(r, 70)
    near = []
    for i in range(40):
        cut = r.randrange(len(base))
        near.append(base[:cut] + f"<{i}>" + base[cut + 3 :])
    rows = [*near, *(f"{prose(r, 30)} {passage} {prose(r, 30)}" for _ in range(40)), " ".join(inner[:c] + f"[{i}]" + inner[c:] for i in range(30) for c in [r.randrange(len(inner))]), None, base, near[3]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(3)
    made, decided = [], suffix_dedup._decided

    def counted(s, cells):
        made.append(cells.count())
        return decided(s, cells)

    monkeypatch.setattr(suffix_dedup, "_decided", counted)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, group_limit=2)).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == brute(rows, 256, 400)
    assert len(made) == 4 and sum(made) < 8_000
