"""Stages of the pipeline on rows whose doc_id is null or repeats, and the whole of it against plain Python."""

import random
import re

import pytest

from bytelens.llm import stages

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    r = random.Random(seed)
    words = "the of and on is it was for with river house tree stone field light water road".split()
    return " ".join(r.choice(words) + r.choice(["", "", ".", "a", "en", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Null ids twice, one id with two texts, one id with the same text twice, copies under two ids, null and empty texts."""
    a, b = prose(1), prose(2)
    texts = [(None, prose(3)), (None, prose(4)), (7, prose(5)), (7, prose(6)), (8, a), (8, a), (5, b), (4, b), (None, b), (None, None), (9, ""), (None, "")]
    return [(i, x, None if i == 9 else "en", None if i is None else "s", len(x or "")) for i, x in texts]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(0, prose(5)), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_quality_keeps_rows_without_id(spark, rows, folder):
    assert plain(stages.quality_classifier(spark, spark.createDataFrame(rows, KIND), folder).collect()) == plain(rows)


def test_scorer_is_trained_without_ids(spark):
    from bytelens.llm import quality

    good, bad = [prose(i) for i in range(150)], [f"spam{i} " * (80 + i) for i in range(12)] + [f"BUY NOW{i}!! " * (30 + i) for i in range(12)]
    docs = spark.createDataFrame([(None, x, "en", "s", 1) for x in good + bad], KIND)
    got = quality.classify(docs, train_rows=40).collect()
    assert sum(r.accept for r in got if r.text in set(good)) >= 140 and sum(r.accept for r in got if r.text not in set(good)) <= 4


def test_jaccard_keeps_one_of_each_group(spark, rows, folder):
    got = stages.ngram_jaccard(spark, spark.createDataFrame(rows, KIND), folder).collect()
    assert plain(got) == plain([x for k, x in enumerate(rows) if k not in (5, 6, 8)])


def test_decontamination_keeps_rows_without_id(spark, rows, folder):
    got = stages.decontamination(spark, spark.createDataFrame(rows, KIND), folder).collect()
    assert plain(got) == plain([x for k, x in enumerate(rows) if k != 2])


def test_mixing_loses_no_row(spark, rows, folder):
    docs = spark.createDataFrame(rows, KIND)
    got = stages.mixing_sources(spark, docs, folder).collect()
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    # two sources of 6 (s, weight 3) and 3 (null, weight 1) texts of 60 words: 1.5 x 540 = 810, of which 607.5 and 202.5
    total = {s: sum(words(x[1]) for x in rows if x[3] == s) for s in ("s", None)}
    assert total == {"s": 360, None: 180}
    taken = {s: sum(words(r.text) for r in got if r.source == s) for s in total}
    assert abs(taken["s"] - 607.5) <= 1 and abs(taken[None] - 202.5) <= 1
    assert {r[:2] for r in map(tuple, got) if words(r[1]) == 60} == {x[:2] for x in rows if x[1]}


def test_sharding_keeps_all_rows(spark, rows, folder):
    got = stages.sharding(spark, spark.createDataFrame(rows, KIND), folder).drop("shard", "version").collect()
    assert plain(got) == plain(rows)


def test_whole_pipeline(spark, rows, folder):
    import corpus_pipeline

    spark.createDataFrame(rows, KIND).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # all pass the classifier; 5, 6 and 8 are copies, 2 is a benchmark passage; null and empty texts have no words to mix
    left = [rows[k] for k in (0, 1, 3, 4, 7)]
    assert all(any(r.doc_id == x[0] and r.source == x[3] and x[1].startswith(r.text) for x in left) for r in got)
    assert {r.text for r in got if r.source == "s" and len(r.text.split()) == 60} == {x[1] for x in left if x[3] == "s"}
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in ("s", None)}
    assert abs(words["s"] - 337.5) <= 1 and abs(words[None] - 112.5) <= 1  # 1.5 x 300 words, by weights 3 and 1
    assert all(r.n_chars == len(r.text) and r.lang == "en" and r.shard and r.version >= 1 for r in got)
