"""Captured texts, plays and markets by hand: odd inputs, nulls and empty frames."""

import itertools
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import captures as cap
from tidemark.functions import text as tx
from tidemark.operators import divergence, markets, plays, relational, style
from tidemark.plans.targets import TARGETS, drop_targets


def one(spark, values, f, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ticker_dates(spark):
    got = one(spark, ["KXGAME-26AUG05ABC", "KX-26FEB30", "KX-26ABC05", "KX-26AUG05ABC-T12", "26AUG05", "KX-26AUG05abc", "", None], cap.ticker_date)
    assert got == [date(2026, 8, 5), None, None, date(2026, 8, 5), None, None, None, None]


def test_market_titles(spark):
    texts = ["North Bay vs Easton: 1st Quarter Total?", "A vs. B", "Eastport wins the game by over 19.5 points?", "Will North Bay win the 2H by over 3 points?", "Spread: Tides (-4.5)", "Ann Bo: 15+ points", "Ann Bo: Points O/U 12.5", "A vs. B: O/U 166.5", "nothing", None]
    got = one(spark, texts, cap.market_title)
    kinds = [g and g["kind"] for g in got]
    assert kinds == ["two_teams", "two_teams", "margin", "half_margin", "spread", "player_count", "player_line", "total", None, None]
    assert (got[0]["team_a"], got[0]["team_b"]) == ("North Bay", "Easton") and got[5]["line"] == 14.5 and got[5]["prop"] == "points" and got[4]["line"] == -4.5


def test_names_choices_and_labels(spark):
    texts = ["Signed G O'da Marsh to a contract", "Waived Gs Ann Bo and Cy Di", "Named Ann Bo head coach", "Signed F/C Ann, Bo", "Traded C Ann Bo Cy Di", "Signed G ann Bo", "", None]
    assert one(spark, texts, cap.player_after_position) == ["O'da Marsh", "Ann Bo", None, None, "Ann Bo Cy", None, None, None]
    assert one(spark, ["2", " 0 none", "7", "-1", "two", "", None], lambda c: cap.choice(c, F.lit(5))) == [2, 0, None, None, None, None, None]
    assert one(spark, [1, 99, None], cap.event_label, "int") == ["Made Shot", "Event 99", "Unknown"]


def test_row_sets(spark):
    payload = '{"resultSets":[{"name":"a","headers":["X","Y"],"rowSet":[["1","2"],["3"],["4","5","6"],[]]},{"name":"b","headers":["Z"],"rowSet":[["9"]]}]}'
    assert one(spark, [payload, "no", None], cap.row_set) == [[{"X": "1", "Y": "2"}, {"X": "3"}, {"X": "4", "Y": "5"}, {}], None, None]
    assert one(spark, [payload], lambda c: cap.row_set(c, "b")) == [[{"Z": "9"}]]


REPORT = f"""Injury Report: 08/05/26 05:30 PM
{cap.COLUMN_HEADER} Early, Bird Out 08/06/2026 07:00 (ET) NBG@EPT
North Bay Gulls Moss- Hale, Corinne
Out Injury/Illness - knee; Quinn, Delia Mae Probable rest
Eastport Tides {cap.PENDING}
08/06/2026 WES@MTK Milltown Kites Doe, Jane Questionable
"""


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, None), (3, "no header"), (4, "")], "id long, body string")
    rows = [tuple(r)[2:] for r in cap.report_entries(df, "id", "body", ["North Bay Gulls", "North Bay", "Eastport Tides", "Milltown Kites"]).collect()]
    assert rows == [
        ("08/06/2026", "NBG@EPT", "North Bay Gulls", "Corinne Moss-Hale", "Out", "Injury/Illness - knee", True),
        ("08/06/2026", "NBG@EPT", "North Bay Gulls", "Delia Mae Quinn", "Probable", "rest", True),
        ("08/06/2026", "NBG@EPT", "Eastport Tides", None, None, None, False),
        ("08/06/2026", "WES@MTK", "Milltown Kites", "Jane Doe", "Questionable", None, True),
    ]
    assert cap.report_entries(df.limit(0), "id", "body", []).count() == 0


def test_reports_of_several_pages_and_large_ids(spark):
    paged = f"""Injury Report: 08/05/26 05:30 PM {cap.COLUMN_HEADER} 08/06/2026 NBG@EPT North Bay Doe, Jane Out knee
Injury Report: 08/05/26 05:30 PM Page 2 {cap.COLUMN_HEADER} North Bay Gulls O'Neil - Roe, Ann Marie Available - Eastport Out of nowhere, Smith Out"""
    df = spark.createDataFrame([(2**60 + 1, paged), (None, paged), (2**60 + 3, "Report: too short")], "id long, body string")
    rows = [tuple(r) for r in cap.report_entries(df, "id", "body", ["North Bay", "North Bay Gulls", "Eastport"]).collect()]
    assert sorted({r[0] for r in rows if r[0]}) == [2**60 + 1] and len(rows) == 6
    own = [r[4:] for r in rows if r[0]]
    # The second page's head ends the first player's reason; a status without a name before it is a word.
    assert own[0][:4] == ("North Bay", "Jane Doe", "Out", "knee")
    assert own[1] == ("North Bay Gulls", "Ann Marie O'Neil-Roe", "Available", None, True)
    assert own[2][:3] == ("Eastport", "Smith nowhere", "Out")


def test_typed_words():
    phrases = {"North": {("North", "Bay"): "team", ("North", "Bay", "Gulls"): "team"}, "NOT": {("NOT", "YET", "SUBMITTED"): "pending"}}
    words = "North Bay Gulls North Bay North 08/06/2026 8/6/26 AB@CDE a@b AB@C Out NOT YET".split()
    assert list(cap.typed_words(words, phrases)) == [("team", "North Bay Gulls"), ("team", "North Bay"), ("word", "North"), ("date", "08/06/2026"), ("word", "8/6/26"), ("matchup", "AB@CDE"), ("word", "a@b"), ("word", "AB@C"), ("status", "Out"), ("word", "NOT"), ("word", "YET")]


def test_letters_of_all_scripts_fold(spark):
    texts = ["Éñ Ångström", "e\u0301a\u030a", "ÑŃńǸ ЙЁ Ώή", "ở ộ ẫ", "が", "日本語 한글 ﬁ ß ø", "हिन्दी", "", None]
    got = one(spark, texts, tx.fold)
    assert got[:4] == ["en angstrom", "ea", "nnnn ие ωη", "o o a"] and got[4] == "か" and got[5] == "日本語 한글 ﬁ ß ø" and got[7:] == ["", None]


def test_running_score(spark):
    rows = [(1, 1, None), (1, 2, "2 - 0"), (1, 3, "x"), (1, 4, "2 - 3"), (2, 1, "0 - 1")]
    out = plays.running_score(spark.createDataFrame(rows, "game int, n int, score string"), "game", "n", "score").orderBy("game", "n").collect()
    assert [(r["home_score"], r["away_score"], r["scoring_play"], r["score_value"]) for r in out] == [(0, 0, False, 0), (2, 0, True, 2), (2, 0, False, 0), (2, 3, True, 3), (0, 1, True, 1)]


def test_clutch_takes_only_real_clocks(spark):
    rows = [(1, 1, 7, 4, "4:59", 2, 2, 0), (1, 2, 7, 4, "5:01", 3, 5, 0), (1, 3, 8, 5, "x", 2, 5, 2), (1, 4, 8, 5, "2:00", 4, 5, 6), (1, 5, None, 4, "0:01", 9, 5, 6), (1, 6, 8, 4, "0:01", 0, 5, 6)]
    df = spark.createDataFrame(rows, "g int, n int, t int, p int, c string, x int, h int, a int")
    got = {r["t"]: r for r in plays.play_aggregate(df, "g", "t", "n", "p", "c", "x", "h", "a").collect()}
    assert (got[7]["clutch_points"], got[8]["clutch_points"], got[8]["overtime_points"]) == (2, 4, 6)
    assert got[7]["lead_changes"] == got[8]["lead_changes"] == 1 and got[7]["largest_run"] == 5 and got[8]["largest_lead"] == 5


def test_confident_names(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.7), ("b", 1, 0.8), ("b", 2, 0.8), ("c", 1, 0.76), ("d", 1, 0.7), ("e", 1, None), ("f", 1, 0.9), ("f", 2, None)]
    got = markets.confident(spark.createDataFrame(rows, "name string, who int, score double"), "name", "who", "score").collect()
    assert sorted(r["name"] for r in got) == ["a", "c", "f"]


def test_divergences_from_find_to_grade(spark):
    at = lambda h: f"2026-08-05 {h:02d}:00:00"
    quotes = spark.createDataFrame([(1, "x", at(10), 150, -170), (1, "y", at(10), 160, -180), (1, "y", at(14), 140, -160), (1, "y", at(18), 120, -140)], "game_id int, vendor string, at string, home_odds int, away_odds int").withColumn("at", F.to_timestamp("at"))
    venues = spark.createDataFrame([(1, "pm", 0.45, 5000.0), (1, "kx", 0.45, 10.0), (2, "pm", 0.9, 9e9)], "game_id int, venue string, fair_home double, volume double")
    games = spark.createDataFrame([(1, at(20), True), (2, at(20), None)], "game_id int, start_time string, home_won boolean").withColumn("start_time", F.to_timestamp("start_time"))
    found = divergence.detect(quotes, venues, games, F.to_timestamp(F.lit(at(12))), 1000)
    (r,) = divergence.grade(divergence.recheck(found, quotes), quotes, games).collect()
    assert (r["venue"], r["side"], r["book_vendor"], r["book_odds"], r["in_play"], r["minutes_from_start"]) == ("pm", "home", "y", 160, False, -480)
    assert (r["recheck_odds"], r["survived"], r["closing_odds"], r["won"]) == (140, False, 120, True)
    assert r["clv"] == pytest.approx(100 / 220 - 100 / 260)


def test_targets_go(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "game_id int, won int, margin int, pace_mean_5 int")
    assert drop_targets(df).columns == ["game_id", "pace_mean_5"] and len(set(TARGETS)) == 26


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(4)
    sets = {f"n{i}": frozenset(rng.choices("abcdefghijkl" if i % 3 else "aaab", k=rng.randrange(7))) for i in range(120)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, t array<string>")
    for least in (0.3, 0.5, 1.0):
        got = {(r["a"], r["b"]): r["similarity"] for r in relational.similar_sets(df, "id", "t", least).collect()}
        want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.permutations(sets.items(), 2) if x and y and len(x & y) / len(x | y) >= least}
        assert got == pytest.approx(want)


def test_neighbours_and_uniqueness_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("uv"), f"e{i % 9}", [round(rng.gauss(5 * (i % 4), 1), 2) for _ in range(3)]) for i in range(700)] + [(900, "w", "e1", [0.0] * 3), (901, "u", "e2", None)]
    df = spark.createDataFrame(rows, "i int, g string, e string, v array<double>")
    asked = df.filter("i % 20 = 0 or i >= 900")
    far = {(a, b): math.dist(v, w) for a, _, _, v in rows if v and (a % 20 == 0 or a >= 900) for b, _, _, w in rows if w and a != b}
    group, entity = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    near = sorted((r["i"], r["rank"], r["neighbour"]) for r in style.neighbours(asked, df, "i", "v", 4, ["g"]).collect())
    want = [(a, n, b) for a in sorted({a for a, _ in far}) for n, (_, b) in enumerate(sorted((d, b) for (x, b), d in far.items() if x == a and group[a] == group[b])[:4], 1)]
    assert near == want
    lone = {r["i"]: r["uniqueness"] for r in style.uniqueness(asked, df, "i", "e", "v").collect()}
    assert lone == pytest.approx({a: min(d for (x, b), d in far.items() if x == a and entity[a] != entity[b]) for a in {a for a, _ in far}})


def test_nearest_event_against_all_pairs(spark):
    rng = random.Random(7)
    left = [(rng.choice("ab"), rng.randrange(-5000, 5000), i) for i in range(80)]
    right = [(rng.choice("ab"), rng.randrange(-5000, 5000), i) for i in range(80)]
    lf = spark.createDataFrame(left, "k string, s long, i int").withColumn("t", F.timestamp_seconds("s"))
    rf = spark.createDataFrame(right, "k string, s long, j int").withColumn("u", F.timestamp_seconds("s"))
    got = {r["i"]: r["j"] for r in relational.nearest_event(lf, rf, ["k"], "t", "u", 120, "i", "j").collect()}
    want = {i: min(c)[1] for k, s, i in left if (c := [(abs(s - x), j) for q, x, j in right if q == k and abs(s - x) <= 120])}
    assert got == want


def test_trigrams_of_nothing(spark):
    assert one(spark, ["", "--", None], tx.trigrams) == [[], [], None]
