"""Every operator on an empty table, on one text of over 1 MiB, on repeated rows, and on columns of its own names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytelens.llm import alignment, decontaminate, jaccard_join, media, mixing, records, suffix_dedup, token_counts

KIND = "doc_id long, text string, source string, n_bytes string, size string, key string, n_words int"
WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def table(spark, rows):
    return spark.createDataFrame([(i, x, "s", "clash", "clash", "clash", 1) for i, x in rows], KIND)


@pytest.fixture(scope="module")
def long():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefé") for _ in range(r.randint(1, 9))) for _ in range(30_000)]
    return " ".join(r.choice(words) for _ in range(220_000))


def test_long_text_and_repeats(spark, long, tmp_path):
    assert len(long.encode()) > 1 << 20
    rows = [(1, long), (2, "short one"), (2, "short one"), (None, None), (3, long[:700_000] + " tail")]
    docs = table(spark, rows)
    texts = [x or "" for _, x in rows]

    tok = Tokenizer.from_file(WORD)
    got = token_counts.digest(token_counts.count_tokens(docs.select("doc_id", "text"), WORD)).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(x.encode()), len(tok.encode(x, add_special_tokens=False).ids)) for x in texts)

    piece = " ".join(long.split()[1000:1010])
    bench = spark.createDataFrame([(7, piece), (8, "nothing of it here at all")], "item_id long, text string")
    hit = {r.doc_id: (r.n_items, r.contaminated) for r in decontaminate.digest(decontaminate.decontaminate(docs, bench, keep_columns=["doc_id"])).collect()}
    assert hit == {1: (1, True), 2: (0, False), None: (0, False), 3: (1, True)}

    got = sorted(suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect(), key=lambda r: (r.n_bytes, r.n_removed))
    shared = len(long[:700_000].encode())
    assert [(r.n_bytes, r.n_removed) for r in got] == [(0, 0), (9, 0), (9, 0), (shared + 5, shared), (len(long.encode()), shared)]

    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.n_shingles, str(r.component_id)) for r in got)[:3] == [(0, "None"), (1, "2"), (1, "2")] and len({r.component_id for r in got if r.n_shingles > 1}) == 2

    got = {r.payload_bytes: r for r in media.digest(docs).collect()}
    n = len(long.encode())
    padded = long.encode() + b"\0" * (-n % 64)
    assert got[len(padded)].payload_sha256 == hashlib.sha256(padded).hexdigest() and len(got) == 3  # empty and short texts have 64 bytes

    taken = mixing.digest(mixing.mix(docs)).collect()
    assert sorted(r.size for r in taken) == sorted(len(x.split()) for x in texts) and all(r.taken <= 2 * r["size"] for r in taken)

    own = Tokenizer.from_file(BYTE)
    got = records.digest(records.Records.write(docs, f"file://{tmp_path}/records", BYTE).read()).collect()
    ids = [own.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)

    got = alignment.digest(alignment.align(docs, BYTE, PIECE)[0]).collect()
    assert sorted(r.n_a for r in got)[:3] == [0, 2, 2] and max(r.n_a for r in got) == len(own.encode(" " + long, add_special_tokens=False).ids)


def test_empty_tables(spark, tmp_path):
    none = table(spark, [])
    assert token_counts.count_tokens(none, WORD).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(none)).count() == 0
    assert jaccard_join.jaccard_components(none).count() == jaccard_join.keep_one(none).count() == 0
    assert media.digest(none).count() == 0 and mixing.digest(mixing.mix(none)).count() == 0
    assert records.Records.write(none, f"file://{tmp_path}/none", BYTE).read().count() == 0
    assert alignment.align(none, BYTE, PIECE)[0].count() == 0


def test_blocks_of_a_benchmark(spark):
    """A benchmark in many blocks: whole rows come through, and hits that touch across blocks are one run."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words), 5), (1, " ".join(words), 5), (None, "w1 w2", 6), (2, None, 7)], "doc_id long, text string, hit_runs int")
    bench = spark.createDataFrame([(i, " ".join(words[a : a + 10])) for i, a in enumerate((0, 5, 15, 40))], "item_id long, text string")
    one, many = (decontaminate.decontaminate(docs, bench, block_bytes=b) for b in (1 << 20, 30))
    assert one.columns == many.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert [[tuple(x) for x in r.hit_runs] for r in many.where("doc_id = 1").collect()] == [[(0, 25), (40, 50)]] * 2
    assert decontaminate.clean(docs.select("doc_id", "text"), bench, block_bytes=30).agg(F.count("*")).first()[0] == 2
