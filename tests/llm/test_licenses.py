"""License scans against plain Python, every place of a notice, short templates and odd rows."""

import random

from bytelens.llm import decontaminate, license_scan


def test_against_brute_force(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        name, notice = r.choice(license_scan.TEMPLATES)
        w = notice.split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join([*r.choices(words, k=r.randrange(60)), *w, *r.choices(words, k=r.randrange(60))]))
    got = {x.doc_id: {m.template for m in x.matches} for x in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    missed = wrong = total = 0
    for i, text in enumerate(texts):
        w = decontaminate.words_of(text)
        have = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for name, notice in license_scan.TEMPLATES:
            t = decontaminate.words_of(notice)
            want = {tuple(t[j : j + 5]) for j in range(len(t) - 4)}
            share = len(want & have) / len(want)
            total += share >= 0.8
            missed += share >= 0.8 and name not in got[i]
            wrong += share < 0.8 and name in got[i]
    assert total > 20 and wrong == 0 and missed <= 0.02 * total


def test_every_place_and_short_templates(spark):
    line = dict(license_scan.TEMPLATES)["Apache-2.0-line"]
    templates = spark.createDataFrame([("a", line), ("two", "Public Domain"), ("none", "..."), ("null", None)], "template_id string, text string")
    docs = spark.createDataFrame([(1, f"x {line} and more of it {line} public domain"), (1, "in the PUBLIC domain, public"), (None, None), (None, ""), (2, "w " * 400_000 + line)], "doc_id long, text string")
    got = sorted(((x.doc_id, sorted((m.template, m["from"], m["to"]) for m in x.matches)) for x in license_scan.scan_licenses(docs, templates).collect()), key=str)
    n = len(decontaminate.words_of(line))
    assert got == sorted([(1, [("a", 1, 1 + n), ("a", 5 + n, 5 + 2 * n), ("two", 5 + 2 * n, 7 + 2 * n)]), (1, [("two", 2, 4)]), (None, []), (None, []), (2, [("a", 400_000, 400_000 + n)])], key=str)
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_templates_in_blocks(spark):
    """More templates than are sent at once: the same matches, whatever the blocks."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    notices = [(f"t{i}", " ".join(r.choices(words, k=r.choice([3, 8, 30])))) for i in range(40)]
    docs = [(i if i % 9 else None, " ".join([*r.choices(words, k=20), r.choice(notices)[1], *r.choices(words, k=9), r.choice(notices)[1]])) for i in range(50)] + [(7, None), (8, "")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(notices, "template_id string, text string")
    rows = lambda **o: sorted(((x.doc_id, sorted(map(tuple, x.matches))) for x in license_scan.scan_licenses(d, t, **o).collect()), key=str)
    assert rows(block_templates=7) == rows() and sum(bool(m) for _, m in rows()) >= 50
