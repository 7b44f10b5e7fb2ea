"""Regions of shingle sub-sets, cells that are dealt in blocks, and rows told apart by keys of their own."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from bytelens.llm import jaccard_join
from bytelens.runtime import KEY, Scratch, file_keys


def brute(rows, k, percent):
    """n_shingles and component_id of each (doc_id, text), as a sorted list."""
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, kind="long", **options):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    return sorted(map(tuple, jaccard_join.jaccard_components(docs, **options).collect()), key=str)


def corpus(seed, sizes, shared=""):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(4)) for _ in range(400)]
    texts = []
    for n in sizes:
        base = [r.choice(words) for _ in range(n)]
        texts += [" ".join(w if r.random() > p else "x" for w in base) + shared for p in (0, 0.01, 0.02, 0.03)]
        texts += [" ".join(base[: int(n * c)]) + shared for c in (0.8, 0.85, 0.9)]
    return list(enumerate(texts))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_ordinary_sets_are_not_thin(percent):
    r = np.random.Generator(np.random.PCG64(6))
    for n in [*range(64, 330, 3), 511, 512, 513, 600, 640, 641, 1023, 1024, 1279, 1280, 4095, 4096, 5000]:
        assert not jaccard_join.is_thin(np.sort(r.integers(0, 2**64, n, dtype=np.uint64)), percent)


@pytest.mark.parametrize("level", range(7, 24))
def test_sub_spaces_of_85_percent_stay(level):
    assert jaccard_join.space_bits(level, 85) == level - 2 and jaccard_join.space_bits(level, 80) == level - 1


@pytest.mark.parametrize("k,percent", [(5, 80), (4, 85)])
def test_links_of_all_sizes(spark, k, percent):
    rows = corpus(3, (6, 20, 40, 63, 70, 100, 127, 128, 140, 200, 256, 300, 1500))
    want = brute(rows, k, percent)
    assert got(spark, rows, k=k, percent=percent) == want and len({c for _, _, c in want}) < len(rows)


@pytest.mark.parametrize("blocks", [1, 8])
def test_cells_in_blocks(spark, monkeypatch, blocks):
    """Cells of more than CELL points: blocks, representatives and pairs of blocks lose no link."""
    monkeypatch.setattr(jaccard_join, "CELL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCKS", blocks)
    rows = corpus(4, (12, 14, 30, 30, 50, 90, 90, 200), " and this one passage stands at the end of each of them")
    assert got(spark, rows, k=5, percent=80) == brute(rows, 5, 80)


@pytest.mark.parametrize("weight", [1 << 20, 300])
def test_crowded_cells(spark, monkeypatch, weight):
    """Cells that leave more pairs than asked for are joined by their points' shingles, in blocks where these are many."""
    monkeypatch.setattr(jaccard_join, "PARTNERS", 0)
    monkeypatch.setattr(jaccard_join, "WEIGHT", weight)
    rows = corpus(7, (12, 14, 30, 30, 50, 90, 90, 200), " and this one passage stands at the end of each of them")
    assert got(spark, rows, k=5, percent=80) == brute(rows, 5, 80)


def test_near_misses_make_few_pairs(spark, monkeypatch):
    """300 documents of 600 common and 58 own words, none of which link: no text is compared with all others."""
    r = random.Random(8)
    common = [f"w{r.randrange(10**6)}" for _ in range(600)]
    rows = [(i, " ".join(common + [f"o{r.randrange(10**6)}" for _ in range(58)])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace("o", "q", 3)) for i in range(5)]
    made, join = [], jaccard_join.join_pairs

    def counted(s, pairs, *rest):
        made.append(pairs.count())
        return join(s, pairs, *rest)

    monkeypatch.setattr(jaccard_join, "join_pairs", counted)
    assert got(spark, rows, k=4, percent=85) == brute(rows, 4, 85)
    assert sum(made) < 3000


@pytest.mark.parametrize("percent", [80, 85])
def test_exact_links(percent):
    """Components by the links that exact_links gives are those of all links, for cells of few and of many points."""
    r = np.random.Generator(np.random.PCG64(11))
    for m, n in ((1, 5), (7, 40), (150, 60), (300, 20)):
        base = r.integers(0, 2**64, (6, n), dtype=np.uint64)
        sets = [np.unique(np.concatenate((b[r.random(n) > 0.08], r.integers(0, 2**64, 3, dtype=np.uint64)))) for b in base[r.integers(0, 6, m)]]
        want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
        assert (jaccard_join.common(sets) == want).all()
        size = np.array([len(s) for s in sets])
        link = 100 * want >= percent * (size[:, None] + size[None, :] - want)
        comp = np.arange(m) // 2

        few = [(int(a), int(b)) for i, j in jaccard_join.exact_links(sets, comp, percent) for a, b in zip(np.broadcast_to(i, len(j)), j)]
        assert all(link[i, j] for i, j in few) and len(few) < max(1, len(set(comp.tolist())))

        def groups(pairs):
            root = {int(c): int(c) for c in comp}

            def find(c):
                while root[c] != c:
                    c = root[c]
                return c

            for i, j in pairs:
                root[find(int(comp[i]))] = find(int(comp[j]))
            return [[find(int(c)) == find(int(d)) for d in set(comp.tolist())] for c in set(comp.tolist())]

        assert groups(few) == groups(zip(*np.nonzero(link)))


def test_crowded_regions_come_last(spark):
    """A passage that all rows share: the regions it makes are found in the sample, and links stay whole."""
    rows = corpus(5, (20, 25, 30, 35, 40, 45, 50, 55, 60) * 3, " and this one passage of a dozen words stands at the end of each")
    assert got(spark, rows, k=5, percent=80, sample_rows=64) == brute(rows, 5, 80)


def test_thin_sets_are_joined_by_single_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "is_thin", lambda x, percent: len(x) % 3 == 0)
    rows = corpus(6, (70, 71, 72, 100, 130, 200))
    assert got(spark, rows, k=4, percent=85) == brute(rows, 4, 85)


def test_one_id_with_two_texts(spark):
    """Identity is the row's: each text links on its own, whatever its doc_id."""
    r = random.Random(9)
    a, b = (" ".join(r.choice(["of", "sea", "hill", "tree", "stone", "wood"]) + str(i % 7) for i in range(80)) for _ in range(2))
    rows = [(1, a), (1, b), (2, b + " q"), (3, a + " q"), (4, None), (4, ""), (5, a), (5, a), (None, b), (None, "of it")]
    assert got(spark, rows) == brute(rows, 4, 85)
    text = [(None if d is None else f"id{d}", x) for d, x in rows]
    assert got(spark, text, kind="string") == brute(text, 4, 85)


def test_empty_table_and_clashing_names(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8, "k"), (2, "a b c d e", 1, 2, "k")], "doc_id long, text string, n long, comp long, key string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
    assert [tuple(r) for r in jaccard_join.keep_one(docs).collect()] == [(1, "a b c d e", 7, 8, "k")]


def test_bins_bound_the_difference():
    r = np.random.Generator(np.random.PCG64(8))
    pool = np.unique(r.integers(0, 2**64, 9000, dtype=np.uint64))
    for n in (60, 256, 257, 1024, 4000, 8000):
        x, y = np.sort(pool[:n]), np.sort(pool[n // 10 : n + n // 20])
        m = jaccard_join.bin_matrix([jaccard_join.bins_of(x), jaccard_join.bins_of(y)])
        real = len(np.setxor1d(x, y))
        assert 0.75 * real - 4 < jaccard_join.apart(m[:1], m[1])[0] <= real


def test_texts_stay_where_they_lie(spark, tmp_path, monkeypatch):
    """However many keys there are, only texts that are wanted are shuffled, and none of those that stay."""
    at = [0, 1, 2, 7, 8, 32_766, 32_767, 32_768, 32_769, 65_536, 65_537, 1 << 33, (1 << 33) + 1]
    docs = spark.createDataFrame([(f, p, f"{f} {p}") for f in (-5, 0, 9) for p in at], "__file long, __at long, text string")
    keys = docs.where("pmod(xxhash64(__file, __at), 3) = 0").select(*KEY)
    want = {tuple(r) for r in keys.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(jaccard_join, "BROADCAST", 0)
    try:
        with Scratch(spark) as s:
            for most in (1 << 14, 0):  # with bitmaps, and beyond the size they are sent to
                monkeypatch.setattr(jaccard_join, "MARKS", most)
                for inside in (True, False):
                    got = [tuple(r)[:2] for r in jaccard_join.marked(s, docs, keys, inside).collect()]
                    assert len(got) == len(set(got)) and set(got) == {(f, p) for f in (-5, 0, 9) for p in at if ((f, p) in want) == inside}
            monkeypatch.setattr(jaccard_join, "MARKS", 1 << 14)
            wanted = s.write(keys.withColumn("node", F.monotonically_increasing_id()), "wanted")
            texts = jaccard_join.with_texts(s, docs, wanted)
            assert texts.count() == len(want)
            plan = texts._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
        path = f"file://{tmp_path}/docs"
        spark.createDataFrame([(i, f"w{i // 2} a b c d e f g h", i) for i in range(40)], "doc_id long, text string, more long").repartition(3).write.parquet(path)
        kept = jaccard_join.keep_one(file_keys(spark.read.parquet(path)))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()
        assert sorted(map(tuple, kept.collect())) == [(i, f"w{i // 2} a b c d e f g h", i) for i in range(0, 40, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
