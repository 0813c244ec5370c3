"""Reports over small tables of their own."""

from pyspark.sql import functions as F

from tidemark.queries.catalog import QUERIES
from tidemark.queries import desk  # noqa: F401


def test_a_mean_half_way_between_two_tenths_goes_up(spark, tmp_path):
    """67.15, whose sum in doubles falls short of it."""
    rows = [(i, 7, "click", v, "2024-01-02") for i, v in enumerate([46.83, 98.57, 56.05])] + [(9, 7, "view", 1.0, "2024-01-28")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, day string")
    events.select("event_id", F.col("day").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit('{"k": 3}').alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["injury_impact"](spark, str(tmp_path)).collect()
    assert [(r["player"], r["games"], r["points"]) for r in got] == [(7, 3, 67.2)]
