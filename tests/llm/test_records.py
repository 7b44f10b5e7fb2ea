"""Token records: round trips against the library, offsets, damage, retries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bytelens.llm import records as rec
from bytelens.llm.encoding import ByteBpe
from bytelens.runtime import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id {}, text string, ids string, start int"


def write(spark, rows, kind="long", **options):
    return rec.Records.write(spark.createDataFrame([(i, x, "clash", 0) for i, x in rows], KIND.format(kind)), fresh_path(spark, "records-test"), PATH, **options)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    pool = list("aAbz059 \t\n\r.,'!_-é ß漢字🙂  　\x1c\x1f\x85\x00​́") + ["'s", "'ll", "  ", "\n\n", " \n", " word", "Hello", "<|endoftext|>", "٣", "Ⅷ"]
    return [None, "", " ", "\n", *("".join(r.choice(pool) for _ in range(r.randint(1, 60))) for _ in range(1500)), "word " * 400_000, "x" * 3000]


@pytest.mark.parametrize("plain", [False, True])
def test_encode(texts, plain):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = plain
    bpe = ByteBpe(PATH, plain, table_limit=500)
    for x in texts:
        assert np.frombuffer(bpe.encode(x or ""), bpe.kind).tolist() == tok.encode(x or "", add_special_tokens=False).ids
    table = bpe.id_bytes()
    assert b"".join(table[i] for i in np.frombuffer(bpe.encode("né <x> \n"), bpe.kind)) == "né <x> \n".encode()


def test_read(spark, texts):
    tok = Tokenizer.from_file(PATH)
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    rows = [(3 * i - 50, texts[i]) for i in order] + [(10**12, "again"), (10**12, "again"), (None, "none")]
    got = write(spark, rows)
    ids = {x: tok.encode(x or "", add_special_tokens=False).ids + [0] for _, x in rows}
    at, want = 0, []
    for i, x in sorted(rows, key=lambda t: (t[0] is None, t[0] or 0)):
        want.append((i, at, len(ids[x]), zlib.crc32(np.array(ids[x], "<u4").tobytes())))
        at += len(ids[x])
    assert sorted(map(tuple, rec.digest(got.read()).collect()), key=lambda t: t[1]) == want
    one, two = ([tuple(r) for r in rec.digest(got.read_shuffled(s)).collect()] for s in (1, 2))
    assert one != two and sorted(one, key=str) == sorted(two, key=str) == sorted(want, key=str)
    assert [tuple(r) for r in rec.digest(got.read_shuffled(1)).collect()] == one
    assert sum(r.tokens for r in got.index().collect()) == at


def test_kinds(spark):
    got = write(spark, [("b", "x"), ("a", "y"), (None, None), ("é", "z")], "string", end_id=None)
    assert [(r.doc_id, len(r.ids)) for r in sorted(got.read().collect(), key=lambda r: (r.start, r.doc_id is None))] == [("a", 4), ("b", 4), ("é", 4), (None, 0)]
    none = write(spark, [])
    assert none.read().count() == none.index().count() == none.read_shuffled(0).count() == 0
    assert write(spark, [(1, None), (2, "")]).read().count() == 2


def test_frames(tmp_path):
    """The frame is what the docstring says, and a changed bit is told."""
    data = rec.frame(b"payload")
    turned = lambda x: ((((c := zlib.crc32(x)) >> 15 | c << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF
    assert data == struct.pack("<Q", 7) + struct.pack("<I", turned(struct.pack("<Q", 7))) + b"payload" + struct.pack("<I", turned(b"payload"))
    for bit in range(8 * len(data)):
        bad = bytearray(data)
        bad[bit // 8] ^= 1 << bit % 8
        (tmp_path / "f").write_bytes(bad)
        with open(tmp_path / "f", "rb") as f, pytest.raises(rec.Broken):
            rec.read_frame(f)
    for own in (None, -5, "é"):
        back, ids = rec.unpack(rec.pack(own, np.array([1, 70], "<u2").tobytes(), 2))
        assert (back, ids.tolist()) == (own, [1, 70])


def test_orphans(spark, tmp_path):
    """Files of attempts that the manifest doesn't name are not read, and go when a set is written."""
    got = write(spark, [(1, "a b"), (2, "c")])
    folder = got.path.removeprefix("file://") + "/data"
    with open(f"{folder}/00000000-dead.rec", "wb") as f:
        f.write(b"half")
    assert got.read().count() == 2
    got._sweep()
    import os

    assert not [n for n in os.listdir(folder) if "dead" in n]
