"""Captures as a data source: batch and stream alike, damage is told, what was killed isn't seen."""

import gzip
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.sources import replay

ROWS = "provider string, captured_at timestamp, pages array<string>"


@pytest.fixture
def folder(spark, tmp_path):
    replay.register(spark)
    return f"file://{tmp_path}/captures"


def captured(spark, n, first=0):
    rows = [(f"p{i % 3}", datetime(2026, 8, 5, tzinfo=timezone.utc), [f"{i}-{k} é" for k in range(i % 4)] + [None]) for i in range(first, first + n)]
    return spark.createDataFrame(rows, ROWS).repartition(4)


def test_what_was_recorded_is_replayed(spark, folder):
    captured(spark, 20).write.format("captures").mode("append").save(folder)
    captured(spark, 5, 20).write.format("captures").mode("append").save(folder)
    got = spark.read.format("captures").load(folder)
    assert got.rdd.getNumPartitions() == 25 and got.filter("error is not null").count() == 0
    want = {(p, i, b) for p, _, pages in map(tuple, captured(spark, 25).collect()) for i, b in enumerate(pages)}
    assert {(r["provider"], r["page"], r["body"]) for r in got.collect()} == want and got.count() == sum(i % 4 + 1 for i in range(25))
    assert {r["captured_at"] for r in got.select("captured_at").distinct().collect()} == {datetime(2026, 8, 5)}
    assert not [n for n in os.listdir(folder[7:]) if n.startswith(".")]


def test_damaged_captures_are_told(spark, folder):
    captured(spark, 4).write.format("captures").mode("append").save(folder)
    whole = gzip.compress(json.dumps({"schema_version": 9, "provider": "x", "captured_at": "2026-08-05T00:00:00+00:00", "pages": []}).encode())
    odd = {"a": whole[:20], "b": b"plain", "c": gzip.compress(b"{"), "d": whole, "e": gzip.compress(b"[]"), "f": gzip.compress(b'{"schema_version": 1, "provider": "x", "captured_at": "2026-08-05T00:00:00", "pages": []}')}
    for name, data in odd.items():
        with open(f"{folder[7:]}/{name}{replay.ENDING}", "wb") as out:
            out.write(data)
    got = spark.read.format("captures").load(folder)
    assert sorted(r["file"][0] for r in got.filter("error is not null").collect()) == sorted(odd)
    assert got.filter("error is null").select("file").distinct().count() == 4
    assert spark.read.format("captures").option("version", 9).load(folder).filter("error is null and file like 'd%'").count() == 0


def test_a_stream_goes_on_behind_its_last_file(spark, folder, tmp_path):
    for first in (0, 10):
        captured(spark, 10, first).write.format("captures").mode("append").save(folder)
        stream = spark.readStream.format("captures").option("path", folder).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    batch = sorted(map(str, spark.read.format("captures").load(folder).collect()))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select("file", "provider", "captured_at", "page", "body", "error").collect())) == batch


def test_a_task_that_dies_leaves_nothing(spark, folder):
    captured(spark, 3).write.format("captures").mode("append").save(folder)
    before = sorted(os.listdir(folder[7:]))

    @F.udf("array<string>")
    def broken(pages):
        if pages[0] and pages[0].startswith("7"):
            raise RuntimeError("killed in the middle")
        return pages

    with pytest.raises(Exception, match="killed"):
        captured(spark, 12).repartition(1).withColumn("pages", broken("pages")).write.format("captures").mode("append").save(folder)
    assert sorted(os.listdir(folder[7:])) == before
    with pytest.raises(Exception, match="time at which"):
        captured(spark, 2).withColumn("captured_at", F.lit(None).cast("timestamp")).write.format("captures").mode("append").save(folder)
    assert sorted(os.listdir(folder[7:])) == before


def test_nothing_there(spark, folder):
    assert spark.read.format("captures").load(folder).count() == 0


def test_many_small_captures_are_few_tasks(spark, folder):
    taken = spark.range(300).selectExpr("cast(id as string) provider", "timestamp_seconds(id) captured_at", "array(cast(id as string), 'x') pages").coalesce(2)
    taken.write.format("captures").mode("append").save(folder)
    read = spark.read.format("captures").load(folder)
    assert read.rdd.getNumPartitions() <= 64
    assert sorted((r["provider"], r["page"], r["body"]) for r in read.collect()) == sorted((str(i), k, b) for i in range(300) for k, b in enumerate([str(i), "x"]))
