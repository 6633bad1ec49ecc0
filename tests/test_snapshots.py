"""Snapshots change together or not at all, and merges touch only their buckets."""

import pytest
from pyspark.sql import functions as F

from siltloom.sources.snapshots import Conflict, Snapshots
from siltloom.sources.tables import upsert_edges, upsert_nodes

SCHEMA = "repo string, branch string, id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_slices_change_together(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    a = [("o/r", "x", 1, "a"), ("o/r", "y", 2, "a"), ("p/q", "x", 3, "a"), ("1", "007", 4, "a")]
    t = lambda data: spark.createDataFrame(data, SCHEMA)
    assert s.version() == 0 and s.manifest().count() == 0
    assert s.replace({"chunks": t(a), "nodes": t(a[:2])}, t(a), dim=3) == 1
    assert rows(s.read("chunks")) == sorted(a, key=repr) and rows(s.read("nodes")) == sorted(a[:2], key=repr)
    b = [("o/r", "x", 9, "b")]
    assert s.replace({"chunks": t(b), "nodes": t([])}, t([("o/r", None, 0, "")])) == 2  # all branches of o/r
    assert rows(s.read("chunks")) == sorted([*b, *a[2:]], key=repr) and rows(s.read("nodes")) == []
    assert rows(s.read("chunks", 1)) == sorted(a, key=repr)  # the version before is still there
    assert {(r.table, r.repo, r.branch, r.n) for r in s.manifest().collect()} == {("chunks", "o/r", "x", 1), ("chunks", "p/q", "x", 1), ("chunks", "1", "007", 1)}


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    old = spark.createDataFrame([("r", "b", 1, "old")], SCHEMA)
    s.replace({"chunks": old, "nodes": old}, old)
    new = spark.createDataFrame([("r", "b", 2, "new")], SCHEMA)
    killed = new.withColumn("v", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        s.replace({"chunks": new, "nodes": killed}, new)  # chunks are written when nodes fail
    assert s.version() == 1 and rows(s.read("chunks")) == rows(s.read("nodes")) == rows(old)
    s.replace({"chunks": new, "nodes": new}, new)
    assert rows(s.read("chunks")) == rows(s.read("nodes")) == rows(new)
    assert s.vacuum() == 3 and rows(s.read("chunks")) == rows(new)  # two old runs and one of the failed write


def test_the_second_of_two_writers_fails(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    d = spark.createDataFrame([("r", "b", 1, "x")], SCHEMA)
    s.replace({"chunks": d}, d)
    with pytest.raises(Conflict):
        s._switch(0, s.manifest(), s.facts())
    assert s.version() == 1 and rows(s.read("chunks")) == rows(d)


def test_another_dimension_drops_the_vectors(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    one, two = (spark.createDataFrame([(r, "b", i, "x")], SCHEMA) for i, r in enumerate("rs"))
    s.replace({"chunks": one}, one, dim=4)
    assert not s.ensure_dim(4)
    s.replace({"chunks": two}, two, dim=4)
    assert s.read("chunks").count() == 2
    s.replace({"chunks": two}, two, dim=8)
    assert rows(s.read("chunks")) == rows(two) and s.facts()["dim"] == 8
    assert s.ensure_dim(4) and s.read("chunks").count() == 0 and s.facts()["dim"] == 4


def test_merges_rewrite_the_buckets_they_touch(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    t = lambda ids, v: spark.createDataFrame([("r", "b", i, v) for i in ids], SCHEMA)
    first, second = t(range(200), "old"), t([3, 250], "new")
    s.merge("nodes", first, ["id"], buckets=16)
    runs = {r.part: r.run for r in s.manifest().collect()}
    s.merge("nodes", second, ["id"], buckets=99)
    assert rows(s.read("nodes")) == rows(upsert_nodes(first, second).select(*first.columns))
    now = {r.part: r.run for r in s.manifest().collect()}
    assert set(now) == {str(i) for i in range(16)} and 1 <= sum(now[p] != runs[p] for p in now) <= 2
    s.merge("nodes", t([3, 251], "newer"), ["id"], new_wins=False)
    assert {r.id: r.v for r in s.read("nodes").where("id in (3, 250, 251, 5)").collect()} == {3: "new", 250: "new", 251: "newer", 5: "old"}
    e = lambda rows: spark.createDataFrame(rows, "src_id string, rel_type string, dst_id string, p int")
    old, new = e([("a", "CALLS", "b", 1), ("a", "CALLS", "c", 1)]), e([("a", "CALLS", "b", 2), ("b", "CALLS", "c", 2)])
    key = ["src_id", "rel_type", "dst_id"]
    s.merge("edges", old, key, new_wins=False, buckets=4)
    s.merge("edges", new, key, new_wins=False)
    assert rows(s.read("edges")) == rows(upsert_edges(old, new)) and s.read("nodes").count() == 202
