"""The random field on lines it was not trained on: recall and precision by kind, and nothing found in plain text."""

import random
import string

import numpy as np
import pytest

from bytelens.llm import pii, textcore as tc


def held_out(seed=5, n=60):
    """(text, kind, start, end): forms and values that LABELLED doesn't have."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, letters, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    forms = {
        "secret": [lambda: f'token = "{pick(hexes, 40)}"', lambda: f"my_key: {pick(letters, 28)}4k", lambda: f"xoxb-{pick(digits, 11)}-{pick(letters, 24)}", lambda: f'api_key = "AKIA{pick(string.ascii_uppercase + digits, 16)}"', lambda: f"ghp_{pick(letters, 36)}"],
        "phone": [lambda: f"({pick('23456789', 3)}) 555-{pick(digits, 4)}", lambda: f"0{pick('123456789', 2)} {pick(digits, 7)}", lambda: f"555-{pick(digits, 4)}", lambda: f"0{pick('123456789', 3)} {pick(digits, 3)} {pick(digits, 4)}"],
        "email": [lambda: f"{pick(string.ascii_lowercase, 5)}@{pick(string.ascii_lowercase, 6)}", lambda: f"{pick(string.ascii_lowercase, 3)}.{pick(string.ascii_lowercase, 4)}@{pick(string.ascii_lowercase, 5)}.edu", lambda: f"{pick(string.ascii_lowercase, 4)}{pick(digits, 2)}@host"],
    }
    words = "and the book of rain is where they went on a road by some river stone light".split()
    out = []
    for kind, made in forms.items():
        for i in range(n):
            value = made[i % len(made)]()
            lead = " ".join(r.choice(words) for _ in range(r.randrange(3, 9)))
            text = f"{lead} {value} {' '.join(r.choice(words) for _ in range(6))}"
            out.append((text, kind, len(lead) + 1, len(lead) + 1 + len(value)))
    return out


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.LABELLED)


def found(field, texts):
    raw = [x.encode() for x in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return pii.field_spans(field, np.frombuffer(b"".join(raw), np.uint8), offs, 0, len(raw))


@pytest.mark.parametrize("kind", ["secret", "phone", "email"])
def test_recall_and_precision(field, kind):
    cases = [c for c in held_out() if c[1] == kind]
    got = found(field, [c[0] for c in cases])
    hit = sum(any(pii.KINDS[k] == kind and a < z and b > s for a, k, b in got.get(i, [])) for i, (_, _, s, z) in enumerate(cases))
    right = sum(pii.KINDS[k] == kind and a < z and b > s for i, (_, _, s, z) in enumerate(cases) for a, k, b in got.get(i, []))
    assert hit >= 0.9 * len(cases), f"recall {hit / len(cases)}"
    assert right >= 0.9 * sum(map(len, got.values())), f"precision {right / sum(map(len, got.values()))}"


def test_plain_documents_have_none(spark, field):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    plain = [r.text for r in rows if r.text and not pii.base_spans(r.text) and " = " not in r.text and "@" not in r.text]
    got = found(field, plain)
    assert len(plain) > 800 and len(got) <= 0.01 * len(plain)


def test_every_secret_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    want = [r.doc_id for r in docs.where("text rlike 'token = \"[0-9a-f]{40}\"'").collect()]
    assert len(want) >= 10 and all("secret" in got[d].spans and got[d].n_field >= 1 for d in want)


def test_defined_results(spark):
    docs = spark.createDataFrame([(None, None), (None, ""), (7, "é " * 700_000 + "a.b@c.de, ghp_Qw3rTy8uIoPaSdFgHjKlZxCvBnM1234567 é"), (7, "é"), (7, "é")], "doc_id long, text string")
    got = sorted(map(tuple, pii.digest(pii.find_pii(docs)).select("doc_id", "n_email", "n_spans", "spans").collect()), key=str)
    assert [x[:2] for x in got] == [(7, 0), (7, 0), (7, 1), (None, 0), (None, 0)]
    at = 1_400_000
    assert got[2][3].startswith(f"email:{at}:{at + 8}") and got[2][2] == 2
    assert pii.find_pii(spark.createDataFrame([], "doc_id string, text string")).collect() == []
