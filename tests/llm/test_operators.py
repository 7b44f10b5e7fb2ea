"""Operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bytelens.llm import decontaminate, jaccard_join, license_scan, media, mixing, pii, quality, suffix_dedup, token_counts
from bytelens.llm.sharding import Dataset
from bytelens.runtime import fresh_path

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans int"


def table(spark, texts, sources=None):
    return spark.createDataFrame([(i, x, "en", (sources or ["s"] * len(texts))[i], len(x or ""), "clash", 1) for i, x in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 30, 200]))) for _ in range(60)]
    long = " ".join(r.choice(words) for _ in range(3000))
    near = base[5:9] + [" ".join(w if r.random() > 0.01 else "x" for w in long.split()) for _ in range(6)]
    return [None, "", "  \t\n", *base, long, long, *near, long[3000:6000] + "Z" + long[9000:12000]]


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, texts, block_bytes):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [texts[40], (texts[-1] or "")[100:400].upper(), "", None, "abc", "one two"]
    docs = [*texts, "Some ABC here", "one, TWO three one two", "abc"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.decontaminate(table(spark, docs), bench, block_bytes=block_bytes)).collect()}
    pats = [(i, tuple(w[k : k + 10])) for i, x in enumerate(items) for w in [rx.findall((x or "").translate(LOW))] for k in range(max(1, len(w) - 9) if w else 0)]
    for i, x in enumerate(docs):
        w, hit, own = rx.findall((x or "").translate(LOW)), set(), set()
        for item, p in pats:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    own.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(own), bool(hit))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


def test_decontaminate_empty(spark, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(table(spark, texts), none).count() == len(texts)
    assert decontaminate.clean(table(spark, []), none).count() == 0


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, texts, k, percent):
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(table(spark, texts), k=k, percent=percent).collect()}
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in comp:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, comp, strict=True)]


def test_quick_join_loses_no_pair():
    r = np.random.Generator(np.random.PCG64(2))
    base = r.integers(0, 2**63, (40, 16), dtype=np.uint64)
    noise = np.packbits(r.random((12, 40, 1024)) < 0.04).view(np.uint64).reshape(12, 40, 16)
    v = (base ^ noise).reshape(-1, 16)
    n, comp = r.integers(300, 420, len(v)), np.arange(len(v))
    got = {(int(a), int(b)) for i, j in jaccard_join.quick_join(v, n, comp, 85) for a, b in zip(i, j, strict=True)}
    far = [jaccard_join.apart(v, x) for x in v]
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if far[i][j] <= jaccard_join.most_apart(int(n[i]), int(n[j]), 85)}
    assert got == want and want
    assert list(jaccard_join.few_pairs(v, n, comp, 85, 0)) == [None]  # more than asked for: the cell says so
    few = {(int(a), int(b)) for i, j in jaccard_join.few_pairs(v, n, comp, 85, 10**6) for a, b in zip(i, j, strict=True)}
    assert few == want


@pytest.mark.parametrize("limit", [2048, 1])
def test_suffix_dedup(spark, texts, limit):
    docs = [*texts, "ab" * 500]
    rows, length = [(x or "").encode() for x in docs], 400
    seen = collections.Counter(x[p : p + length] for x in rows for p in range(len(x) - length + 1))
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, docs), group_limit=limit)).collect()}
    for i, x in enumerate(rows):
        m = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                m[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), m.sum(), spans, kept)


def test_two_stage_order():
    r = random.Random(1)
    for n, letters in ((1, 1), (60, 1), (80, 2), (900, 3)):
        b = bytes(r.randrange(97, 97 + letters) for _ in range(n))
        assert suffix_dedup.two_stage(np.frombuffer(b, np.uint8), 2 * n).tolist() == sorted(range(n), key=lambda i: b[i:])


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [*texts, "İstanbul ΣΑΣ é don't <|endoftext|>x<|startoftext|> 3.5!! <|nope|>", "ǅ ﬁ Å 漢字 🙂   a​b"]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([x or "" for x in docs], add_special_tokens=False)]
    got = {r.doc_id: r for r in token_counts.digest(token_counts.count_tokens(table(spark, docs), path, table_limit=500)).collect()}
    assert [got[i].n_tokens for i in range(len(docs))] == want
    assert [got[i].n_bytes for i in range(len(docs))] == [len((x or "").encode()) for x in docs]


def test_mixing(spark, texts):
    sources = [random.Random(i).choice(["a", "b", "c", None]) for i in range(len(texts))]
    docs = table(spark, texts, sources)
    placed, pieces = mixing.mix(docs, block_words=16, shard_words=512, bucket_rows=8)
    got = mixing.digest((placed, pieces)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in texts]
    names = sorted({s for s in sources if s is not None}) + [None] * (None in sources)
    total = {s: sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in names}
    weight, want, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(size)
    open_ = set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * total[s]}
        if not over:
            want |= part
            break
        for s in over:
            want[s] = 2 * total[s]
            left -= want[s]
        open_ -= over
    for r in got:
        assert r["size"] == size[r.doc_id] and r.taken <= 2 * r["size"] and abs(r.target - want[sources[r.doc_id]]) < 1e-6 * max(1, r.target)
    for s in names:
        assert abs(sum(r.taken for r in got if sources[r.doc_id] == s) - want[s]) <= 1
    again = {(r.doc_id, r.taken) for r in mixing.digest(mixing.mix(docs, block_words=16, shard_words=512, bucket_rows=8)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    rows = pieces.collect()
    assert len({((r["__file"], r["__at"]), r.copy, r.first_word) for r in rows}) == len(rows) and len({(r.shard, r.pos) for r in rows}) == len(rows) and len({r.shard for r in rows}) > 2
    mixed = mixing.mixed_documents(docs, block_words=16, shard_words=512, bucket_rows=8)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.digest(mixing.mix(table(spark, []))).count() == 0


def test_tree_draws_keep_quotas(spark):
    q = spark.createDataFrame([(0, 40), (1, 0), (2, 7)], "rank long, blocks long")
    rows = mixing.split_tree(q, 8, 3).collect()
    assert {k: sum(r.quota for r in rows if r.rank == k) for k in (0, 1, 2)} == {0: 40, 1: 0, 2: 7}
    assert all(5 <= sum(r.quota for r in rows if r.shard == s) <= 6 for s in range(8))


def test_pii(spark, texts):
    docs = [*texts, "é mail a.b@c.de, x@y z@@q.r +1 (212) 555-0100 is 4539 1488 0343 6467 or 1.2.3.4 or 1.2.3.400.5", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "9" * 3000 + "." + "@" * 50]
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    found = pii.digest(pii.find_pii(table(spark, docs).drop("spans"))).collect()
    for r in found:
        x = docs[r.doc_id] or ""
        base = [(m.start(), 0, m.end()) for m in email.finditer(x)]
        base += [(m.start(), 1, m.end()) for m in ip.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(d)]
        base += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert "secret:8:50" in next(r.spans for r in found if r.doc_id == len(docs) - 2)


def test_field_decodes_as_whole_chain():
    field, r = pii.train(pii.LABELLED[:20], rounds=30), np.random.Generator(np.random.PCG64(4))
    scores = r.normal(0, 2, (60, len(pii.LABELS)))
    got = field.decode(scores, np.arange(60) == 0)
    best, back = scores[0] + field.moves[0], []
    for e in scores[1:]:
        c = best[:, None] + field.moves
        back.append(c.argmax(0))
        best = c.max(0) + e
    y = [int((best + field.moves[:, 0]).argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    assert got.tolist() == y[::-1]


def test_quality(spark, texts):
    r = random.Random(2)
    good = [" ".join(r.choice("the of and on is it was for with river house tree".split()) + r.choice(["", "", ".", "a", "en"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(w + r.choice(["***", "&&&", "%%%"]) for w in x.split()) for x in good[:12]] + ["spam " * 80] * 12 + ["BUY NOW!! " * 30] * 12
    got = {x.doc_id: x for x in quality.classify(table(spark, [*good, *bad, None, ""]), train_rows=100).collect()}
    assert sum(got[i].accept for i in range(len(good))) >= 0.97 * len(good)
    assert sum(got[len(good) + i].accept for i in range(len(bad))) <= 0.1 * len(bad)
    assert got[len(good) + len(bad)].accept
    assert quality.classify(table(spark, [])).count() == 0


def test_license(spark, texts):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    words = mit.split()
    docs = [*texts, "x y " + mit.upper() + " z", " ".join(words[:-8]), " ".join(words[: len(words) // 2]), "a. Released under the MIT License. b", "long " * 5000 + mit]
    got = {r.doc_id: {m.template for m in r.matches} for r in license_scan.scan_licenses(table(spark, docs)).collect()}
    n = len(texts)
    assert [got[i] for i in range(n, n + 5)] == [{"MIT"}, {"MIT"}, set(), {"MIT-line"}, {"MIT"}]
    assert not any(got[i] for i in range(n))


def test_media(spark, texts):
    rows = media.digest(table(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        payload = text + b"\0" * (-len(text) % 64 if text else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        png = media.encode_png(payload)
        assert media.decode_png(png) == payload and (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
    page = '<p>one <b>two</b></p><script>x</script><figure><img src="sha256:ab" alt="alt"><figcaption>cap &amp; t</figcaption></figure>tail<img src="/u.png">'
    assert [(s["pos"], s["kind"], s["text"], s["digest"], s["caption"]) for s in media.parse_html(page)] == [(0, "text", "one two", None, None), (1, "media", None, "ab", "cap & t"), (2, "text", "tail", None, None), (3, "media", None, None, None)]
    assert media.parse_html(None) == []


def test_sharding(spark, texts):
    docs = table(spark, texts)
    ds = Dataset(spark, fresh_path(spark, "t"), target_bytes=40_000, fan_in=2, keep=2)
    ds.append(docs.repartition(7))
    first = ds.manifest()
    ds.append(docs.limit(0))
    stale = ds.manifest()
    m = ds.compact(everything=True)
    assert m["version"] == 3 and len(m["files"]) < len(first["files"])
    rows = sorted((tuple(r) for r in ds.read().collect()), key=str)
    assert rows == sorted((tuple(r) for r in docs.collect()), key=str)
    assert not ds.commit({"version": stale["version"]}, stale["schema"], stale["files"])  # another writer was first
    assert ds.read(2).count() == len(texts)
