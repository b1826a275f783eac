"""Tables in buckets: what a change leaves alone, what a reader sees, what goes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skyreel.operators.catalog import upsert_documents
from skyreel.sources import buckets, snapshots

SCHEMA = "id string, at long, name string"


def put(held, new):
    return upsert_documents(new, held, "at")


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def files(root):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def held(spark, root):
    return sorted(tuple(r) for r in buckets.read(spark, root).collect())


@pytest.fixture
def table(tmp_path):
    return buckets.Table(f"{tmp_path}/table", ("id",), 8)


def test_one_changed_row_leaves_other_buckets_alone(spark, table):
    first = [(str(k), 1, f"n{k}") for k in range(200)]
    assert buckets.update(rows(spark, first), table, put) == 1
    before = files(table.root)
    assert buckets.update(rows(spark, [("7", 2, "new"), ("7", 1, "older")]), table, put) == 2
    after = files(table.root)
    assert set(before.items()) <= set(after.items())  # nothing was written over
    place = buckets.manifest(spark, table.root)["places"]
    changed = [b for b, p in place.items() if p != buckets.manifest(spark, table.root, 2)["places"][b]]
    assert len(place) == 8 and len(changed) == 1
    assert held(spark, table.root) == sorted([r for r in first if r[0] != "7"] + [("7", 2, "new")])
    assert [tuple(r) for r in buckets.read_keys(rows(spark, [("7", 0, ""), ("x", 0, "")]), table).collect()] == [("7", 2, "new")]


def test_a_step_that_is_run_again_repeats_nothing(spark, table):
    buckets.update(rows(spark, [("a", 1, "x")]), table, put, number=1)
    add = lambda held, new: held.unionByName(new)
    buckets.update(rows(spark, [("a", 2, "y")]), table, add, number=2)
    buckets.update(rows(spark, [("a", 2, "y")]), table, add, number=2)
    assert held(spark, table.root) == [("a", 1, "x"), ("a", 2, "y")]


def test_a_step_that_died_before_its_manifest(spark, table, monkeypatch):
    buckets.update(rows(spark, [(str(k), 1, "x") for k in range(50)]), table, put, number=1)
    with monkeypatch.context() as m:
        m.setattr(buckets._Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            buckets.update(rows(spark, [("3", 2, "y"), ("4", 2, "y")]), table, put, number=2)
    assert ("3", 1, "x") in held(spark, table.root)  # readers see the old version whole
    buckets.update(rows(spark, [("3", 2, "y")]), table, put, number=2)
    assert ("3", 2, "y") in held(spark, table.root) and ("4", 1, "x") in held(spark, table.root)


def test_old_versions_go_and_what_is_named_stays(spark, table):
    buckets.update(rows(spark, [(str(k), 1, "x") for k in range(100)]), table, put)
    for step in range(5):
        buckets.update(rows(spark, [("1", 2 + step, "y")]), table, put, kept=2)
    assert buckets.versions(spark, table.root) == [5, 6]
    named = {p for v in (6, 7) for p in buckets.manifest(spark, table.root, v)["places"].values()}
    assert {os.path.relpath(os.path.dirname(f), table.root) for f in files(table.root)} == named
    assert len(held(spark, table.root)) == 100 and buckets.read(spark, table.root, 6) is not None


def test_emptied_buckets_and_empty_changes(spark, table):
    buckets.update(rows(spark, []), table, put)
    assert held(spark, table.root) == [] and buckets.read(spark, table.root).schema == rows(spark, []).schema
    buckets.update(rows(spark, [("a", 1, "x"), ("b", 1, None), (None, 1, "null key")]), table, put)
    drop = lambda held, new: held.join(new, "id", "left_anti")
    buckets.update(rows(spark, [("a", 0, "")]), table, drop)
    assert buckets.update(rows(spark, []), table, put) == 3
    assert {r[0] for r in buckets.read(spark, table.root).collect()} == {"b", None}
    assert buckets.read(spark, f"{table.root}/nowhere") is None


def test_rows_of_other_buckets_are_refused(spark, table):
    with pytest.raises(ValueError):
        buckets.update(rows(spark, [("a", 1, "x")]), table, lambda held, new: new.unionByName(rows(spark, [(str(k), 1, "") for k in range(50)])))
    assert buckets.versions(spark, table.root) == []


def test_more_buckets_for_a_table_that_has_grown(spark, table):
    first = [(str(k), 1, f"n{k}") for k in range(100)] + [(None, 1, "null key")]
    buckets.update(rows(spark, first), table, put)
    assert buckets.rebucketed(spark, table, 32) == 2
    assert buckets.manifest(spark, table.root)["buckets"] == 32 and len(buckets.manifest(spark, table.root)["places"]) > 8
    buckets.update(rows(spark, [("5", 2, "new")]), table, put)
    assert {tuple(r) for r in buckets.read(spark, table.root).collect()} == {r for r in first if r[0] != "5"} | {("5", 2, "new")}


def test_manifest_is_plain_json(spark, table):
    buckets.update(rows(spark, [("a", 1, "x")]), table, put)
    told = json.load(open(f"{table.root}/manifests/000000000001.json"))
    assert told["buckets"] == 8 and list(told["places"].values())[0].startswith("data/000000000001/")


def test_whole_snapshots_expire(spark, tmp_path):
    for k in range(5):
        snapshots.write_version(spark.range(k + 1), f"{tmp_path}/whole", kept=2)
    assert sorted(n for n in os.listdir(f"{tmp_path}/whole") if n.startswith("v-")) == ["v-000000000004", "v-000000000005"]
    assert snapshots.read_latest(spark, f"{tmp_path}/whole").agg(F.max("id")).first()[0] == 4
