"""Streams with state give what the batch operators give, late and repeated rows and restarts included."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, divergence
from tidemark.operators import history as h
from tidemark.streaming import incremental as inc
from tidemark.streaming import stateful as st

START = datetime(2026, 8, 5, 12, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def store(spark):
    st.use_rocksdb(spark)
    yield


def land(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def drain(stream, path, name):
    """Runs a stream over what has landed, from where its checkpoint is."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-marks").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q


QUOTE = "game long, vendor string, at timestamp, price double, tie long"


def test_consensus_is_the_batch_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(2**60 + rng.randrange(3), rng.choice("xyz"), at(rng.randrange(120)), rng.choice([None, 1.0, 2.0, 3.5]), i) for i in range(150)]
    rows += rows[:20]  # delivered again
    end = (1, "x", at(1000), 1.0, 0)  # moves the watermark past everything
    batches = [rows[:80], rows[80:], [end]]
    for rows_ in batches:  # within an hour of each other's latest
        land(spark, f"{tmp_path}/in", rows_, QUOTE)
        drain(st.running_consensus(inc.landed(spark, f"{tmp_path}/in", QUOTE), "game", "vendor", "at", "price", "tie", "3 hours"), tmp_path, "out")
    got = {(r["game"], r["at"]): tuple(r)[2:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["game"], r["at"]): (r["consensus"], r["spread"], r["vendors"]) for r in h.running_latest(spark.createDataFrame(rows, QUOTE), ["game"], "vendor", "at", "price", "tie").collect()}
    assert got.keys() == want.keys() and len(got) > 80
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9, nan_ok=True), k


def test_silent_keys_are_forgotten(spark, tmp_path):
    rows = [(1, "x", at(0), 1.0, 1), (1, "y", at(50), 3.0, 2), (2, "x", at(400), 1.0, 3)]
    for batch in (rows, [(1, "y", at(500), 5.0, 4), (3, "x", at(900), 1.0, 5)], [(3, "x", at(2000), 1.0, 6)]):
        land(spark, f"{tmp_path}/in", batch, QUOTE)
        q = drain(st.running_consensus(inc.landed(spark, f"{tmp_path}/in", QUOTE), "game", "vendor", "at", "price", "tie", "1 minute", idle=3600), tmp_path, "out")
    got = {(r["game"], r["at"].minute + 60 * r["at"].hour): r["consensus"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # At 500 minutes game 1 has been silent for over an hour, so vendor x's price is gone.
    assert [v for (g, _), v in sorted(got.items()) if g == 1] == [1.0, 2.0, 5.0]
    rows_held = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    assert rows_held < 12


EVENTS = "game_id long, time timestamp, kind string, who string, home int, away int, fair double, volume double, won boolean"


def games_of(spark, n, seed):
    rng = random.Random(seed)
    quotes, venues, games = [], [], []
    for g in range(n):
        start = rng.randrange(100, 200)
        for _ in range(rng.randrange(1, 9)):
            home = rng.choice([None, -150, -110, 110, 130, 170])
            quotes.append((g, rng.choice("xyz"), at(rng.randrange(0, 220)), home, None if home is None else -home - 20))
        venues += [(g, v, at(60), rng.choice([0.3, 0.5, 0.7]), rng.choice([10.0, 5000.0])) for v in ("pm", "kx")[: rng.randrange(3)]]
        games.append((g, at(start), at(start + 150) if rng.random() < 0.7 else None, rng.random() < 0.5))
    return (
        spark.createDataFrame(quotes, "game_id long, vendor string, at timestamp, home_odds int, away_odds int"),
        spark.createDataFrame(venues, "game_id long, venue string, at timestamp, fair_home double, volume double"),
        spark.createDataFrame([(g, s, r, w if r else None) for g, s, r, w in games], "game_id long, start_time timestamp, result_at timestamp, home_won boolean"),
    )


def test_divergences_over_a_restart_are_the_batch_ones(spark, tmp_path):
    quotes, venues, games = games_of(spark, 60, 4)
    events = sorted(st.events_of(quotes, venues, games).collect(), key=lambda r: (r["time"], r["game_id"]))
    third = len(events) // 3
    for batch in (events[:third], events[third:], [(999, at(9000), "start", None, None, None, None, None, None)], [(999, at(99_000), "start", None, None, None, None, None, None)]):
        land(spark, f"{tmp_path}/in", [tuple(r) for r in batch], EVENTS)
        # Each run is a new query that goes on from the checkpoint, as after a stop in the middle.
        drain(st.divergences(inc.landed(spark, f"{tmp_path}/in", EVENTS), 1000, "10 minutes", 86_400), tmp_path, "out")
    names = ["game_id", "venue", "side", "book_vendor", "book_odds", "edge", "recheck_odds", "survived", "closing_odds", "clv", "won"]
    now = F.lit(at(60)).cast("timestamp")
    # A quote of the very instant of the result has come before it; batch grades from all quotes before the start.
    found = divergence.detect(quotes, venues.drop("at"), games, now, 1000)
    seen = quotes.join(games.select("game_id", "result_at"), "game_id").filter("result_at is null or at <= result_at").drop("result_at")
    want = divergence.grade(divergence.recheck(found, seen), quotes, games).select(names).collect()
    got = spark.read.parquet(f"{tmp_path}/out").select(names).collect()
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert len(got) > 10 and len(got) == len(want)
    for a, b in zip(order(got), order(want), strict=True):
        assert a == pytest.approx(b, abs=1e-9, nan_ok=True)


def test_freshest_quotes_are_the_as_of_ones(spark, tmp_path):
    rng = random.Random(9)
    fills = [(rng.choice("ab"), at(rng.randrange(0, 600)), i) for i in range(80)]
    quotes = [(rng.choice("ab"), at(rng.randrange(0, 600, 7)), rng.random(), i) for i in range(60)]
    fk, qk = "k string, at timestamp, i long", "k string, seen timestamp, price double, tie long"
    for f, q in ((fills[:40], quotes[:30]), (fills[40:], quotes[30:]), ([("z", at(5000), -1)], [("z", at(5000), 0.0, -1)]), ([("z", at(9000), -2)], [("z", at(9000), 0.0, -2)])):
        land(spark, f"{tmp_path}/fills", f, fk)
        land(spark, f"{tmp_path}/quotes", q, qk)
        stream = st.freshest(inc.landed(spark, f"{tmp_path}/fills", fk), inc.landed(spark, f"{tmp_path}/quotes", qk), ["k"], "at", "seen", "price", "tie", "2 hours", "11 hours")
        q = drain(stream, tmp_path, "out")
    got = {r["i"]: (r["price"], r["observed_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["i"] >= 0}
    batch = asof.asof_join(spark.createDataFrame(fills, fk), spark.createDataFrame(quotes, qk), ["k"], "at", "seen", ["price"], "tie")
    want = {r["i"]: (r["price"], r["observed_at"]) if r["observed_at"] and r["at"] - r["observed_at"] <= timedelta(hours=2) else (None, None) for r in batch.collect()}
    assert got == want
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) < 40  # of the 144 rows that came
