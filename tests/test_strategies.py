"""The player strategies' windows on a small frame."""

from datetime import datetime, timezone

import pytest
from tidemark.plans import pipeline as p
from tidemark.plans import strategies as s

GAMES = "game_id long, player_id long, team_id long, season int, season_type string, start_time timestamp, result_known_at timestamp, minutes double, points double, starter boolean"
CONTEXT = p.Context(datetime(2024, 6, 1, tzinfo=timezone.utc))


@pytest.fixture
def tables(spark):
    # Player 1's second game is a short one; player 2 plays beside it in each.
    minutes = [20.0, 2.0, 30.0, 25.0]
    at = [datetime(2024, 1, d, h, tzinfo=timezone.utc) for d in range(1, 5) for h in (12, 15)]
    rows = [(g, 1, 7, 2024, "regular-season", at[2 * g], at[2 * g + 1], m, 10.0 * g, True) for g, m in enumerate(minutes)]
    rows += [(g, 2, 7, 2024, "regular-season", at[2 * g], at[2 * g + 1], 20.0, 1.0, g == 0) for g in range(4)]
    bios = spark.createDataFrame([(1, "BUILDING", 30), (2, "MACHINERY", 25)], "player_id long, position string, age int")
    props = spark.createDataFrame([], "player_id long, at timestamp, line double, tie long")
    return s.Tables(lambda _: None, lambda _: spark.createDataFrame(rows, GAMES), props=lambda: props, bios=lambda: bios)


def test_player_rates_windows_hold_short_games(tables):
    rows = {r["game_id"]: r for r in s.build("player_rates", tables).run(CONTEXT).df.filter("player_id = 1").collect()}
    assert set(rows) == {0, 2, 3} and rows[0]["points_per_36"] is None
    assert rows[2]["points_per_36"] == pytest.approx(36 * 10 / 22) and rows[3]["points_per_36"] == pytest.approx(36 * 30 / 52)
    assert rows[3]["points_weighted"] == pytest.approx((2 * 10 + 30 * 20) / 52) and rows[3]["starts10_rows"] == 3
    assert rows[3]["minutes_share"] == pytest.approx(52 / 112)


def test_player_market_window_holds_games_before_the_filter(tables):
    rows = {r["game_id"]: r for r in s.build("player_market", tables).run(CONTEXT).df.filter("player_id = 1").collect()}
    assert 0 not in rows and rows[1]["form3_rows"] == 1 and rows[3]["points_form3"] == pytest.approx(10.0)


def test_who_sits_out_gains_no_rest(tables, spark):
    """Rest is the team's: player 2 misses the second and third games, which the team plays."""
    games = tables.player_games(None).filter("player_id = 1 or game_id not in (1, 2)")
    own = s.Tables(lambda _: None, lambda _: games, bios=tables.bios)
    rows = {(r["player_id"], r["game_id"]): r["rest_days"] for r in s.build("player_rates", own).run(CONTEXT).df.collect()}
    assert rows[2, 3] == pytest.approx(1.0) and rows[2, 0] is None and rows[1, 3] == pytest.approx(1.0)


def test_strategies_read_each_table_once_for_each_pass(spark):
    """Mirrors don't join a frame with itself: a strategy with four of them reads its games as often as one with none."""
    from tidemark.queries.strategies import CONTEXT as AT
    from tidemark.queries.strategies import tables as ours

    def scans(name):
        made = s.build(name, ours(spark, "/root/testdata/sf0.001"))
        # Up to the fitted step, before which what there is gets written.
        made = p.Pipeline(name, tuple(x for x in made.steps if x.provenance.kind is not p.StepKind.FITTED), made.event_time, guarded=False)
        plan = made.run(AT).df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation ["), plan.count("Join ")

    assert scans("team_matchup") == scans("team_form") == scans("situational_baseline")
