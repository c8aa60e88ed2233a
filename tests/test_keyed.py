"""Tables in buckets: what a batch rewrites, what survives a lost job, and rows that do not depend on how runs are cut."""

import os
import random

import pytest
from pyspark.sql import functions as F

from carelake.sources import keyed

SCHEMA = "k string, a string, b string, created_at string, updated_at string"
VERSION = "k string, a string, b string, ordinal struct<landed:int,page:int>"


def make(spark, path, rows, buckets=8):
    keyed.create(spark.createDataFrame(rows, SCHEMA), path, ["k"], buckets)


def merge(spark, path, versions, cycle="one", now="new", **options):
    batch = spark.createDataFrame(versions, VERSION).repartition(2).cache()
    return keyed.merge(spark, path, batch, ["k"], ["a"], "ordinal", F.lit(now), cycle, **options)


def rows_of(spark, path):
    return sorted(tuple(r) for r in keyed.table(spark, path).collect())


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def test_one_key_rewrites_one_bucket(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path, [(f"k{i}", "a", "b", "old", "old") for i in range(200)])
    before, rows = files_of(path), {r["bucket"]: r["version"] for r in keyed.manifest(spark, path)[1]}
    assert set(rows.values()) == {0} and len(rows) == 8
    touched = merge(spark, path, [("k7", "changed", "b", (1, 1))])
    after = files_of(path)
    assert len(touched) == 1 and {f: t for f, t in after.items() if f in before} == before
    assert len({os.path.dirname(f) for f in after if f not in before}) == 1
    now = {r["bucket"]: r["version"] for r in keyed.manifest(spark, path)[1]}
    assert {b for b, v in now.items() if v == 1} == set(touched) and {b for b in now if now[b] != rows[b]} == set(touched)
    got = rows_of(spark, path)
    assert len(got) == 200 and [r for r in got if r[0] == "k7"] == [("k7", "changed", "b", "old", "new")]
    assert keyed.table(spark, path, version=0).where("a = 'changed'").count() == 0


def test_vacuum_keeps_what_a_kept_manifest_names(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path, [(f"k{i}", "a", "b", "old", "old") for i in range(50)])
    for n in range(3):
        merge(spark, path, [("k7", f"a{n}", "b", (n, 1))])
    held = rows_of(spark, path)
    assert keyed.vacuum(spark, path, keep=2) == 2  # the bucket's versions 0 and 1
    assert rows_of(spark, path) == held and keyed.table(spark, path, version=2).where("a = 'a1'").count() == 1
    assert keyed.vacuum(spark, path) == 1 and keyed.vacuum(spark, path) == 0
    assert rows_of(spark, path) == held


def test_a_lost_commit_is_not_there_and_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    make(spark, path, [(f"k{i}", "a", "b", "old", "old") for i in range(20)])
    before = rows_of(spark, path)

    def lost(*_):
        raise OSError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(keyed, "write_snapshot", lost)
        with pytest.raises(OSError):
            merge(spark, path, [("k1", "x", "y", (1, 1)), ("new", "x", "y", (1, 1))])
    assert rows_of(spark, path) == before and keyed.vacuum(spark, path) == 0
    merge(spark, path, [("k1", "x", "y", (1, 1)), ("new", "x", "y", (1, 1))])
    once = rows_of(spark, path)
    merge(spark, path, [("k1", "x", "y", (1, 1)), ("new", "x", "y", (1, 1))])  # and once more
    assert rows_of(spark, path) == once and ("new", "x", "y", "new", "new") in once and len(once) == 21


def test_rows_do_not_depend_on_order_or_cut(spark, tmp_path):
    rng = random.Random(4)
    versions = [(f"k{rng.randrange(12)}", rng.choice("xyz"), f"b{n}", (rng.randrange(6), n)) for n in range(60)]
    versions += [("", "x", "no key", (9, 1)), (None, "x", "no key", (9, 2)), versions[3], versions[4]]
    start = [(f"k{i}", rng.choice(["x", "y", None]), "first", "old", "old") for i in range(6)]
    newest = {}
    for v in versions:
        if v[0] and (v[0] not in newest or v[3] > newest[v[0]][3]):
            newest[v[0]] = v
    want = []
    for k in sorted({r[0] for r in start} | set(newest)):
        row, v = next((r for r in start if r[0] == k), None), newest.get(k)
        want.append(row if v is None or row and row[1] == v[1] else (k, v[1], v[2], "old" if row else "new", "new"))
    for n, batches in enumerate((1, 3, 9)):
        path = str(tmp_path / str(n))
        make(spark, path, start, buckets=3)
        order = versions[:]
        rng.shuffle(order)
        for i in range(batches):
            merge(spark, path, order[i::batches])
        assert rows_of(spark, path) == sorted(want)
        counts = {r.action: r.n for r in keyed.outcomes(spark, path, "one").collect()}
        assert counts == {a: c for a, c in (
            ("saved", sum(k not in {r[0] for r in start} for k in newest)),
            ("updated", sum(r[0] in newest and newest[r[0]][1] != r[1] for r in start)),
            ("skipped", sum(r[0] in newest and newest[r[0]][1] == r[1] for r in start))) if c}


def test_the_next_cycle_compares_with_what_the_last_one_left(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path, [("k", "a", "first", "old", "old")], buckets=1)
    merge(spark, path, [("k", "b", "second", (1, 1))], "one", "n1")
    merge(spark, path, [("k", "a", "third", (2, 1))], "one", "n1")  # as before the cycle: nothing has changed
    assert rows_of(spark, path) == [("k", "a", "first", "old", "old")]
    merge(spark, path, [("k", "b", "fourth", (3, 1))], "two", "n2")
    merge(spark, path, [("k", "b", "fifth", (4, 1))], "three", "n3")  # not compared: b alone
    assert rows_of(spark, path) == [("k", "b", "fourth", "old", "n2")]
    merge(spark, path, [("k", "z", "late", (3, 9))], "four", "n4")  # older than what decided the row
    assert rows_of(spark, path) == [("k", "b", "fourth", "old", "n2")]
    merge(spark, path, [("k", "b", "forced", (5, 1))], "five", "n5", force=True)
    assert rows_of(spark, path) == [("k", "b", "forced", "old", "n5")]


def test_empty_tables_batches_and_refresh(spark, tmp_path):
    path = str(tmp_path)
    make(spark, path, [], buckets=4)
    assert rows_of(spark, path) == [] and merge(spark, path, []) == []
    merge(spark, path, [("k", "a", None, (1, 1))])
    keyed.delete(spark, path, spark.createDataFrame([("k",), ("unknown",), ("unknown",)], "k string"), ["k"])
    assert rows_of(spark, path) == []
    make(spark, path, [("it's", "a", "b", "old", "old")], buckets=4)
    assert rows_of(spark, path) == [("it's", "a", "b", "old", "old")]
    with pytest.raises(ValueError):
        keyed.table(spark, f"{path}/nothing")
