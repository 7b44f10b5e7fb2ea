"""Tiers over several arrivals, writers at the same time, and what a dead writer leaves."""

import collections
import os
import threading

import pytest

from bytelens.llm.sharding import Dataset


def rows_of(ds):
    return collections.Counter(map(tuple, ds.read().collect()))


def test_tiers_over_several_arrivals(spark, tmp_path):
    """Small shards of like size are merged as they come; files and rows agree with the manifest at each version."""
    ds = Dataset(spark, f"file://{tmp_path}/d", target_bytes=40_000, fan_in=3, keep=2)
    want, merged = collections.Counter(), 0
    for k in range(7):
        arrival = [(i, None if i % 7 == 0 else f"text {i * 7919 % 10007} " * 20, "x") for i in range(k * 300, k * 300 + 300)] + [(None, None, None)] * 2
        ds.append(spark.createDataFrame(arrival, "doc_id long, text string, path string").repartition(2))
        want.update(arrival)
        before = len(ds.manifest()["files"])
        m = ds.compact()
        merged += len(m["files"]) < before
        assert rows_of(ds) == want
        assert sum(f["rows"] for f in m["files"]) == sum(want.values())
        assert all(os.path.getsize(f"{tmp_path}/d/{f['path']}") == f["bytes"] for f in m["files"])
        tiers = collections.Counter(f["tier"] for f in m["files"])
        assert all(n < 3 * 3 for t, n in tiers.items() if t)
    assert merged >= 2
    m = ds.compact(everything=True)
    assert rows_of(ds) == want and sum(1 for f in m["files"] if f["tier"]) <= 1
    assert len(os.listdir(f"{tmp_path}/d/_manifests")) <= 2 * 2  # the last versions and their checksums


@pytest.mark.parametrize("how", ["rename", "create"])
def test_two_writers(spark, tmp_path, how):
    """Writers that commit at the same time all succeed, one after the other, and no rows are lost."""
    path = f"file://{tmp_path}/d"
    frames = [spark.createDataFrame([(k * 10 + i, f"t{k}") for i in range(4)], "doc_id long, text string").coalesce(1) for k in range(6)]
    errors = []

    def work(own):
        try:
            ds = Dataset(spark, path, keep=100, commit=how)
            for f in own:
                ds.append(f)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(frames[k::2],)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ds = Dataset(spark, path)
    assert not errors and ds.version() == 6
    assert sorted(r.doc_id for r in ds.read().collect()) == sorted(k * 10 + i for k in range(6) for i in range(4))


def test_second_commit_of_a_version_is_refused(spark, tmp_path):
    for how in ("rename", "create"):
        ds = Dataset(spark, f"file://{tmp_path}/{how}", commit=how)
        base = ds.manifest()
        assert ds.commit(base, None, []) and not ds.commit(base, None, [{"path": "x", "bytes": 1, "rows": 1, "tier": 1}])
        assert ds.manifest()["files"] == []


def test_files_of_a_dead_writer(spark, tmp_path):
    ds = Dataset(spark, f"file://{tmp_path}/d")
    ds.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    spark.createDataFrame([(2, "b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d/data/dead")
    assert ds.clean() == 0 and ds.clean(older_than_s=-5) >= 1
    assert [tuple(r) for r in ds.read().collect()] == [(1, "a")] and not os.path.exists(f"{tmp_path}/d/data/dead")


def test_empty_arrivals(spark, tmp_path):
    ds = Dataset(spark, f"file://{tmp_path}/d")
    for _ in range(2):
        ds.append(spark.createDataFrame([], "doc_id long, text string"))
    ds.compact(everything=True)
    assert ds.read().collect() == [] and ds.version() == 2


def test_compacting_writers_and_an_open_reader(spark, tmp_path):
    """At the default, a reader that has taken a version reads it to the end while two writers append and merge."""
    path = f"file://{tmp_path}/d"
    frames = [spark.createDataFrame([(k * 10 + i, f"t{k}") for i in range(4)], "doc_id long, text string").coalesce(1) for k in range(8)]
    first = Dataset(spark, path, target_bytes=40_000, fan_in=2)
    first.append(frames[0])
    first.append(frames[1])
    reader, errors = first.read(), []

    def work(own):
        try:
            ds = Dataset(spark, path, target_bytes=40_000, fan_in=2)
            for f in own:
                ds.append(f)
                ds.compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(frames[2 + k :: 2],)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted(r.doc_id for r in reader.collect()) == sorted(k * 10 + i for k in range(2) for i in range(4))
    first.compact(everything=True)
    assert sorted(r.doc_id for r in first.read().collect()) == sorted(k * 10 + i for k in range(8) for i in range(4))


def test_a_merge_whose_files_are_gone_plans_again(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    ds, other = (Dataset(spark, path, target_bytes=40_000, fan_in=2, keep=1) for _ in range(2))
    for k in range(4):
        ds.append(spark.createDataFrame([(k, "t")], "doc_id long, text string").coalesce(1))
    plan, done = ds.plan, []

    def late(files, everything=False):
        out = plan(files, everything)
        if not done:
            done.append(other.compact(everything=True))  # removes what this plan is about to read
        return out

    ds.plan = late
    ds.compact(everything=True)
    assert done and sorted(r.doc_id for r in ds.read().collect()) == [0, 1, 2, 3]


def test_old_versions_go_by_age(spark, tmp_path):
    ds = Dataset(spark, f"file://{tmp_path}/d", retain_s=-5)  # all that is out of date is old
    for k in range(3):
        ds.append(spark.createDataFrame([(k, "t")], "doc_id long, text string").coalesce(1))
    assert [n for n in os.listdir(f"{tmp_path}/d/_manifests") if n.startswith("v")] == ["v00000003.json"]
    assert ds.read().count() == 3
