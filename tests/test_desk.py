"""Desk queries where rounding decides."""

import random
from datetime import datetime
from functools import reduce
from operator import add

import duckdb

from tidemark.registry import ORACLE_SQL, QUERIES

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def season(values, user, first):
    """A user's games and, later, a report."""
    rows = [(first + i, datetime(2024, 1, 2, 0, i), user, "click", v, '{"k": 1}') for i, v in enumerate(values)]
    return [*rows, (first + 99, datetime(2024, 1, 28), user, "view", 1.0, '{"k": 1}')]


def test_means_half_way_between_tenths_go_where_those_of_sql_go(spark, tmp_path):
    rng, rows, halves = random.Random(5), [], 0
    for user in range(1000):
        cents = [rng.randrange(15_000) for _ in range(20)]
        cents[-1] += (100 - sum(cents)) % 200  # an odd sum: a mean that ends in five hundredths
        rows += season([c / 100 for c in cents], user, user * 100)
        halves += reduce(add, [c / 100 for c in cents]) != sum(cents) / 100
    assert halves > 100  # sums that miss the half
    rows += season([None, None], 1000, 100_000)
    spark.createDataFrame(rows, EVENT).coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql("SET threads = 1")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.sql(f"SELECT player, games, points FROM ({ORACLE_SQL['injury_impact']})").fetchall()}
    for parts in (1, 5):  # a player's rows in one place, and in several
        spark.createDataFrame(rows, EVENT).repartition(parts).write.parquet(f"{tmp_path}/{parts}/events.parquet")
        got = {r["player"]: (r["games"], r["points"]) for r in QUERIES["injury_impact"](spark, f"{tmp_path}/{parts}").collect()}
        assert got == want
