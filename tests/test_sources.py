"""Sources, exports and windows of streams."""

import gzip
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dml
from tidemark.plans.provenance import StepContractError, UndeclaredProvenanceError
from tidemark.sources import tables
from tidemark.streaming import incremental as inc

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def test_tables_as_of_an_instant(spark, tmp_path):
    rows = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, None)], "i int, h int").withColumn("seen", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), "h", F.lit(0), F.lit(0)))
    for name in ("log", "now", "bios"):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    source = tables.ParquetSource(spark, str(tmp_path), frozenset({"now"}), {"log": "seen"})
    assert sorted(r["i"] for r in source.as_of("log", NOON).collect()) == [1, 2]
    assert "PushedFilters: [IsNotNull(seen), LessThanOrEqual(seen" in source.as_of("log", NOON)._jdf.queryExecution().toString()
    for wrong in (lambda: source.table("log"), lambda: source.table("now"), lambda: source.as_of("now", NOON, "seen"), lambda: source.as_of("bios", NOON), lambda: source.as_of("log", NOON.replace(tzinfo=None))):
        with pytest.raises(StepContractError):
            wrong()
    assert source.time_invariant("bios", "birth dates don't change").count() == 4
    with pytest.raises(UndeclaredProvenanceError):
        source.time_invariant("bios", " ")


def test_static_rows_aren_t_filtered(spark):
    rows = tables.literal(spark, [(1, "a")], "i int, v string")
    assert tables.StaticSource({"t": rows}).table("t").count() == 1
    assert [r["id"] for r in tables.requested(spark, [3, 1], "id").collect()] == [3, 1]


def test_captures(spark, tmp_path):
    good = {"schema_version": 1, "provider": "x", "captured_at": "2024-01-01T00:00:00Z", "pages": ["a", "b"]}
    (tmp_path / "one.json").write_text(json.dumps(good))
    (tmp_path / "two.json.gz").write_bytes(gzip.compress(json.dumps(good | {"provider": "y", "pages": ["c"]}).encode()))
    (tmp_path / "old.json").write_text(json.dumps(good | {"schema_version": 0}))
    (tmp_path / "broken.json").write_text('{"schema_version": 1, "pag')
    got = sorted((r["provider"], r["page"], r["body"]) for r in tables.captures(spark, str(tmp_path)).collect())
    assert got == [("x", 0, "a"), ("x", 1, "b"), ("y", 0, "c")]


def test_csv_has_the_declared_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b", NOON)], "i int, v string, at timestamp")
    dml.write_csv(rows.coalesce(1), f"{tmp_path}/out", ["at", "v"])
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text().splitlines() == ["at,v", '2024-01-01T12:00:00.000Z,"a,b"']


def test_only_changes_update(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, None)], "i int, v string, n int").alias("o")
    new = spark.createDataFrame([(1, "a", 7), (2, "b", 5), (3, None, None)], "i int, v string, n int").alias("n")
    differs = dml.changed({c: F.col(f"o.{c}") for c in "vn"}, {c: F.col(f"n.{c}") for c in "vn"})
    assert [r["i"] for r in old.join(new, F.col("o.i") == F.col("n.i")).filter(differs).select("o.i").collect()] == [1]


def run(stream, tmp_path, spark, schema):
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    return spark.read.schema(schema).parquet(f"{tmp_path}/out")


@pytest.fixture
def fills(spark, tmp_path):
    # The last row is there to move the watermark on.
    rows = [("a", 0, 1.0, 2.0, 1), ("a", 240, 3.0, 2.0, 2), ("a", 700, 5.0, 0.0, 3), ("b", 90_000, 1.0, 1.0, 4)]
    df = spark.createDataFrame(rows, "k string, s long, price double, size double, i long").withColumn("at", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return inc.landed(spark, f"{tmp_path}/in", df.schema)


def test_sliding_prices(spark, tmp_path, fills):
    got = run(inc.sliding_vwap(fills, ["k"], "at", "price", "size", "10 minutes", "5 minutes", "1 minute"), tmp_path, spark, "k string, at timestamp, vwap double, volume double")
    assert sorted((r["k"], int(r["at"].timestamp()), r["vwap"], r["volume"]) for r in got.collect()) == [("a", 300, 2.0, 4.0), ("a", 600, 2.0, 4.0), ("a", 900, None, 0.0), ("a", 1200, None, 0.0)]


def test_sessions(spark, tmp_path, fills):
    got = run(inc.sessions(fills, ["k"], "at", "5 minutes", "1 minute"), tmp_path, spark, "k string, start timestamp, end timestamp, events long")
    assert sorted((r["k"], int(r["start"].timestamp()), int(r["end"].timestamp()), r["events"]) for r in got.collect()) == [("a", 0, 540, 2), ("a", 700, 1000, 1)]
