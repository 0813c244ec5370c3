"""Streams give what the batch operators give."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.streaming import incremental as inc


def test_redelivered_rows_are_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0), (1, 10, 1.0)], "id long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = inc.once(inc.landed(spark, f"{tmp_path}/in", rows.schema), ["id"], "ts", "1 hour")
    inc.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_appending_again_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    for name in ("first", "again"):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        inc.append_new(inc.landed(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/marks-{name}", ["id"]).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_high_water_mark(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "t long")
    assert sorted(r["t"] for r in inc.high_water(rows, rows.filter("t < 3"), "t").collect()) == [3]
    assert inc.high_water(rows, rows.filter("t < 0"), "t").count() == inc.high_water(rows, rows, "t", True).count() == 3


def test_latest_values_are_kept(spark, tmp_path):
    kind = "game long, vendor string, at timestamp, price double, tie long"
    seen = {}

    def take(batch, _):
        for r in batch.collect():
            seen[r["game"], r["vendor"]] = r["value"]

    def land(rows):
        spark.createDataFrame([(g, v, datetime(2024, 1, 1, h), p, t) for g, v, h, p, t in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        latest = inc.latest_values(inc.landed(spark, f"{tmp_path}/in", kind), ["game"], "vendor", "at", "price", "tie")
        latest.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    land([(1, "x", 10, 5.0, 1), (1, "y", 10, 6.0, 2), (1, "y", 11, None, 3)])
    land([(1, "x", 9, 9.0, 4), (1, "y", 12, 7.0, 5)])
    assert seen == {(1, "x"): 5.0, (1, "y"): 7.0}
