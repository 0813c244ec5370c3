"""A task's share of a shuffle stays the same however many rows there are, and features share their passes."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import asof, quality
from tidemark.operators import history as h
from tidemark.operators.history import dealt
from tidemark.plans import pipeline as p
from tidemark.plans import strategies as s
from tidemark.queries import catalog
from tidemark.queries import strategies as ours
from tidemark.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_to_more_tasks_than_the_session_says(spark):
    assert dealt(spark.range(10), 20, "id").rdd.getNumPartitions() == 20
    assert "Repartition" not in plan(dealt(spark.range(10), 8, "id")) + plan(dealt(spark.range(10), None, "id"))


@pytest.mark.parametrize("name", ["check_plays_by_source", "check_duplicates", "check_totals"])
def test_checks_are_dealt_by_their_rows(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "TASK_ROWS", 100)
    assert "RepartitionByExpression" in plan(QUERIES[name](spark, FOLDER))


def test_stale_looks_at_what_was_found_where_it_is(spark):
    found = spark.range(1000).selectExpr("'a' as check", "cast(id as string) as key")
    known = spark.createDataFrame([("a", "7"), ("a", "x"), ("b", "7")], "check string, key string")
    out = quality.stale(found, known)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "x"), ("b", "7")]
    assert "BroadcastHashJoin" in physical(out)


def _unfitted(spark, name, wide=False):
    made = s.build(name, ours.tables(spark, FOLDER, wide))
    steps = tuple(x for x in made.steps if x.provenance.kind is not p.StepKind.FITTED)
    return physical(p.Pipeline(name, steps, made.event_time, guarded=False).run(ours.CONTEXT).df)


@pytest.mark.parametrize("name", ["team_form", "team_form_multi", "team_matchup", "team_play_shape", "team_market", "team_style"])
def test_both_teams_meet_in_one_exchange(spark, name):
    """All that a game's teams tell each other is told in one window."""
    met = [x for x in _unfitted(spark, name).splitlines() if "Exchange hashpartitioning(game_id#" in x and "_w1" in x]
    assert len(met) <= 1


def test_histories_share_their_sorts(spark):
    made = _unfitted(spark, "team_form_multi").splitlines()
    sorts = [x for x in made if " Sort [team_id#" in x]
    assert len(sorts) <= 4  # rest; by season; by venue; by time
    assert not any("collect_list" in x for x in made)


def test_instants_are_kept_as_numbers(spark):
    from tidemark import staging

    import glob

    import pyarrow.parquet as pq

    spark.sql("select timestamp'2024-01-01 12:00:00' as t").transform(lambda df: staging.materialize(df, "instants"))
    folder = staging.shared_dir(spark).removeprefix("file://")
    kind = pq.ParquetFile(glob.glob(f"{folder}/instants-*/*.parquet")[0]).schema.column(0).physical_type
    assert kind == "INT64" and spark.conf.get("spark.sql.parquet.outputTimestampType", "INT96") == "INT96"


def test_market_rows_are_not_shuffled_for_quotes(spark, monkeypatch):
    """A game's rows go by team and then by game, and stay there while its quotes and fills come to them."""
    monkeypatch.setattr(catalog, "TASK_ROWS", 500)
    made = _unfitted(spark, "team_market")
    assert "Union" not in made  # games aren't one stream with quotes
    wide = [x for x in made.splitlines() if "Exchange hashpartitioning(game_id#" in x and "REPARTITION" in x]
    other = [x for x in made.splitlines() if "Exchange hashpartitioning(game_id#" in x and "REPARTITION" not in x]
    assert wide and not other


def test_markets_at_moments_are_the_as_of_ones(spark):
    rng = random.Random(8)
    at = lambda m: datetime(2026, 8, 5) + timedelta(minutes=m)
    quotes = [(rng.choice([0, 1, 2, 3, None]), rng.choice("xyz"), at(rng.randrange(30)), rng.choice([None, 1.0, 2.0, 3.5, 1.0 / 3]), i) for i in range(400)]
    quotes += [(7, "x", at(3), None, 1), (8, "x", at(3), 5.0, 1), (8, "x", at(3), None, 2), (9, "x", at(1), 5.0, 1), (9, "x", at(2), None, 2)]
    quotes = spark.createDataFrame(quotes, "game long, vendor string, at timestamp, price double, tie long")
    games = [(g, s, i) for i, (g, s) in enumerate([*[(rng.randrange(4), at(rng.randrange(-1, 32))) for _ in range(30)], *[(g, at(10)) for g in (5, 7, 8, 9, None)], (1, None)])]
    games = spark.createDataFrame(games, "game long, start timestamp, row long")
    series = h.running_latest(quotes, ["game"], "vendor", "at", "price", "tie", median=False)
    names = ["observed_at", "consensus", "spread", "vendors"]
    told = h.latest_at(games, quotes, ["game"], "start", "vendor", "at", "price", "tie", 12)
    pairs = [(asof.told_at(games, told, ["game"], "start", names), asof.asof_join(games, series, ["game"], "start", "at", names[1:], "at"))]
    told = asof.last_at(games, quotes, ["game"], "start", "at", ["price"], "tie", 12)
    pairs += [(asof.told_at(games, told, ["game"], "start", ["observed_at", "price"]), asof.asof_join(games, quotes, ["game"], "start", "at", ["price"], "tie"))]
    for got, want in pairs:
        rows = [sorted((tuple(r[c] for c in ["row", *want.columns[3:]]) for r in df.collect()), key=lambda r: r[0]) for df in (got, want)]
        assert len(rows[0]) == len(rows[1]) == 36 and sum(r[1] is not None for r in rows[1]) > 20
        for a, b in zip(*rows, strict=True):
            assert a[1] == b[1] and a[2:] == pytest.approx(b[2:], abs=1e-9)
