"""Loads rewrite the buckets that change, and no others."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.buckets import BucketTable

KIND = "k long, v string, n long, seen int"


@pytest.fixture
def table(spark, tmp_path):
    made = BucketTable(spark, f"file://{tmp_path}/table", KIND, ["k"], 8)
    rows = spark.range(200).selectExpr("id as k", "cast(id as string) as v", "if(id % 2 = 0, null, id) as n", "0 as seen")
    assert len(made.upsert(rows, ["n"])) == 8
    return made


def files(table):
    return {os.path.join(d, f) for d, _, names in os.walk(table.path[7:] + "/data") for f in names if f.endswith(".parquet")}


def rows(table):
    return {r["k"]: (r["v"], r["n"], r["seen"]) for r in table.read().collect()}


def test_only_buckets_with_changes_are_written(spark, table):
    before, old = files(table), table.manifest()
    moved = table.upsert(spark.createDataFrame([(3, "new", 3, 0), (500, "more", None, 0)], KIND), ["n"])
    now = table.manifest()
    assert 1 <= len(moved) <= 2 and files(table) >= before and len(files(table) - before) == len(moved)
    assert {b for b in now["folders"] if now["folders"][b] != old["folders"].get(b)} == set(map(str, moved))
    got = rows(table)
    assert got[3] == ("new", 3, 0) and got[500] == ("more", None, 0) and len(got) == 201


def test_the_same_load_again_writes_nothing(spark, table):
    new = spark.createDataFrame([(3, "new", 3, 0)], KIND)
    assert len(table.upsert(new, ["n"])) == 1
    before, number = files(table), table.manifest()["number"]
    assert table.upsert(new, ["n"]) == [] and table.insert_absent(new, ["n"]) == [] and table.fill_null(new, ["v", "n", "seen"]) == []
    assert table.load(new.limit(0), lambda old, more: old) == []
    assert files(table) == before and table.manifest()["number"] == number


def test_merges_are_those_of_whole_tables(spark, table):
    new = spark.createDataFrame([(2, "x", 22, 9), (3, "x", 33, 9), (700, "x", 70, 9)], KIND)
    table.fill_null(new, ["v", "n", "seen"])
    got = rows(table)
    assert (got[2], got[3], got[700]) == (("2", 22, 0), ("3", 3, 0), ("x", 70, 9))
    table.insert_absent(new.withColumn("v", F.lit("y")), ["n"])
    assert rows(table) == got
    same = spark.createDataFrame([(2, "2", 22, 1), (4, "4", 5, 1), (9999, "z", 1, 1)], KIND)
    moved = table.update_changed(same, ["v", "n"], "seen", F.lit(7))
    now = rows(table)
    assert len(moved) == 1 and now[4] == ("4", 5, 7) and now[2] == got[2] and 9999 not in now


def test_a_load_that_dies_changes_nothing(spark, table):
    before = rows(table)

    def broken(old, new):
        return old.withColumn("v", F.raise_error(F.lit("in the middle")).cast("string"))

    with pytest.raises(Exception, match="in the middle"):
        table.load(spark.createDataFrame([(1, "a", 1, 0)], KIND), broken)
    assert rows(table) == before
    # Another load that put its manifest down meanwhile isn't written over.
    late = dict(table.manifest())
    table.upsert(spark.createDataFrame([(1, "b", 1, 0)], KIND), ["n"])
    with pytest.raises(RuntimeError, match="another load"):
        table._put({"number": late["number"] + 1, "folders": late["folders"]})


def test_old_versions_go(spark, table):
    for i in range(3):
        table.upsert(spark.createDataFrame([(1, f"v{i}", 1, 0)], KIND), ["n"])
    want = rows(table)
    assert table.vacuum() == 3 and table.vacuum() == 0 and rows(table) == want
    assert table.read([]).count() == 0


def test_null_keys_and_emptied_buckets(spark, tmp_path):
    made = BucketTable(spark, f"file://{tmp_path}/t", KIND, ["k"], 4)
    assert made.read().count() == 0
    made.upsert(spark.createDataFrame([(None, "a", 1, 0), (1, "b", 1, 0)], KIND), ["n"])
    made.upsert(spark.createDataFrame([(None, "c", 2, 0)], KIND), ["n"])
    assert rows(made) == {None: ("c", 2, 0), 1: ("b", 1, 0)}
    made.update_changed(spark.createDataFrame([(None, "d", 2, 0)], KIND), ["v"], "seen", F.lit(3))
    assert rows(made)[None] == ("d", 2, 3)
    made.load(spark.createDataFrame([(1, "x", 1, 0)], KIND), lambda old, new: old.join(new, "k", "left_anti"))
    assert rows(made) == {None: ("d", 2, 3)}
