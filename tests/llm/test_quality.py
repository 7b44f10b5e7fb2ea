"""The weak-label model: what EM estimates without truth against what labels say, and the scorer on rows it was not fitted on."""

import numpy as np
import pytest

from bytelens.llm import quality, textcore as tc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, {r.doc_id: r.quality for r in labels.collect()}


def test_accuracies_are_those_of_the_labels(labelled):
    docs, truth = labelled
    _, p, prior = quality.fit_votes(quality.count_votes(docs))
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    stats, n = quality.statistics(tc.Words(np.frombuffer(b"".join(raw), np.uint8), offs, 0, len(raw), tc.NONBLANK))
    v = quality.votes(stats, n)
    for y, want in ((0, 1), (1, 0)):  # good, bad
        own = np.array([truth.get(r.doc_id) == want for r in rows]) & (v != 0).any(1)
        for k, name in enumerate(quality.LABELLERS):
            real = (v[own, k] == 2).mean()
            assert abs(p[y, k, 2] - real) < 0.12, (name, want, p[y, k, 2], real)
    assert abs(prior - np.mean([q == 1 for q in truth.values()])) < 0.05
    assert all(p[1, k, 2] > 0.15 > p[0, k, 2] for k, name in enumerate(quality.LABELLERS) if name != "digits")


def test_any_start_finds_the_same(labelled, monkeypatch):
    counts = quality.count_votes(labelled[0])
    first, _, _ = quality.fit_votes(counts)
    again, _, _ = quality.fit_votes(dict(reversed(counts.items())), rounds=1200)
    assert all((first[k] >= 0.5) == (again[k] >= 0.5) for k in first)


def test_scorer_on_rows_it_has_not_seen(labelled):
    docs, truth = labelled
    got = quality.classify(docs, train_rows=400, keep_columns=["doc_id"]).collect()
    bad, good = ([r.accept for r in got if truth.get(r.doc_id) == q] for q in (0, 1))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_defined_results(spark):
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, None), (None, ""), (1, " "), (1, "a b"), (1, "word " * 300_000)]
    got = quality.classify(spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, votes string, score double")).collect()
    assert len(got) == 5 and [r.n_words for r in got] == [0, 0, 0, 2, 300_000] and all(r.accept for r in got[:3])
