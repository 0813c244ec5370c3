"""Rosters, form and records by hand: nulls, ties, games without a score, empty frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rosters as r


def test_rosters_count_a_game_once(spark):
    rows = [(1, "a", 1, "x", None, 10.0, 30.0), (1, "a", 1, "y", None, 99.0, 1.0), (1, "a", 2, "z", False, 20.0, None), (1, "b", 1, "x", True, 5.0, 5.0), (1, "c", 1, "x", False, None, None), (1, "d", 1, "x", False, 1.0, 30.0), (2, "a", 3, "x", False, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "team int, player string, game int, source string, out boolean, points double, minutes double")
    got = sorted(map(tuple, r.roster(df, "team", "player", "game", "source", ["x", "y"], "out", ["points", "minutes"], "minutes").collect()))
    assert got == [(1, "a", 2, 15.0, 30.0, 1), (1, "c", 1, None, None, 3), (1, "d", 1, 1.0, 30.0, 2), (2, "a", 1, 7.0, 2.0, 1)]
    assert r.roster(df.limit(0), "team", "player", "game", "source", ["x"], "out", ["points"], "points").count() == 0


def test_form_ends_before_the_instant(spark):
    at = [datetime(2024, 1, d) for d in range(1, 16)]
    rows = [(1, at[i], i, float(i % 3), 1.0) for i in range(12)] + [(1, at[13], 99, None, None), (2, at[0], 50, 1.0, 1.0), (3, at[14], 60, 1.0, 0.0)]
    games = spark.createDataFrame(rows, "team int, at timestamp, game int, scored double, allowed double")
    got = {x["team"]: x for x in r.form_before(games, "team", "at", "game", "scored", "allowed", F.lit(at[11])).collect()}
    assert set(got) == {1, 2} and (got[1]["games"], got[1]["wins"], got[1]["losses"]) == (11, 3, 4)
    assert (got[1]["wins_last5"], got[1]["wins_last10"], got[1]["games_last10"], got[1]["last_game_at"]) == (1, 3, 10, at[10])
    assert got[1]["points_for_last5"] == pytest.approx((1 + 0 + 2 + 1 + 0) / 5) and (got[2]["wins"], got[2]["losses"]) == (0, 0)
    assert r.form_before(games, "team", "at", "game", "scored", "allowed").filter("team = 3").first()["wins"] == 1


def test_teams_without_standings_come_last(spark):
    teams = spark.createDataFrame([(i, f"t{9 - i}") for i in range(1, 8)], "team long, name string")
    standings = spark.createDataFrame([(1, 0.5), (2, 0.75), (3, 0.5), (4, None)], "team long, pct double")
    got = {x["team"]: x["place"] for x in r.listed(teams, standings, "team", "name", "pct").collect()}
    assert got == {2: 1, 3: 2, 1: 3, 7: 4, 6: 5, 5: 6, 4: 7}


def test_records_and_zones(spark):
    log = spark.createDataFrame([("p", "o", 3.0, 1, 2), ("p", "o", None, None, 2), ("p", "n", 1.0, 0, 0)], "who string, rival string, points double, made int, tried int")
    assert {x["rival"]: tuple(x)[2:] for x in r.record_against(log, ["who", "rival"], ["points"], "made", "tried").collect()} == {"o": (2, 1.5, 0.25), "n": (1, 1.0, None)}
    players = spark.createDataFrame([("p", "o", z, 5, n) for z, n in (("in", 20), ("out", 14), ("far", 15))], "player string, opponent string, zone string, player_made int, player_tried int")
    defences = spark.createDataFrame([("o", z, 6, 15) for z in ("in", "out", "far")], "opponent string, zone string, defence_made int, defence_tried int")
    league = spark.createDataFrame([("in", 0.5), ("out", 0.4)], "zone string, league_rate double")
    (got,) = r.zone_comparison(players, defences, league, "zone").collect()
    assert (got["zone"], got["own_edge"], got["allowed_edge"]) == ("in", -0.25, pytest.approx(-0.1))
