"""Ties, nulls, first rows and leaks on frames made by hand."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, columns, dml, markets
from tidemark.operators import history as h
from tidemark.plans import pipeline as p
from tidemark.plans.provenance import LeakageError, StepContractError, UndeclaredProvenanceError

BY = h.History(("k",), "t", "i")
ROWS = [("a", 1, 1, 10.0), ("a", 2, 2, None), ("a", 2, 3, 30.0), ("a", 3, 4, 50.0), ("b", 1, 5, 7.0)]


def log(spark, rows=ROWS):
    return spark.createDataFrame(rows, "k string, s long, i long, v double").withColumn("t", F.timestamp_seconds("s"))


def by_id(df, *names):
    return {r["i"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_rolling_does_not_see_its_own_instant(spark):
    got = by_id(h.rolling(log(spark), BY, ["v"], 2), "v_roll", "roll_rows")
    assert got == {1: (None, 0), 2: (10.0, 1), 3: (10.0, 1), 4: (30.0, 2), 5: (None, 0)}


def test_rows_out_of_order_give_the_same(spark):
    assert by_id(h.rolling(log(spark, ROWS[::-1]), BY, ["v"], 2), "v_roll") == by_id(h.rolling(log(spark), BY, ["v"], 2), "v_roll")


def test_exponential_mean_ages_null_rows(spark):
    got = by_id(h.exponential(log(spark), BY, "v", 1.0), "v_ewm")
    assert got[1] is None and got[2] == got[3] == 10.0
    assert got[4] == pytest.approx((30 * 1 + 10 * 0.25) / 1.25)


def test_dispersion_needs_two_values(spark):
    got = by_id(h.dispersion(log(spark), BY, "v", 5), "v_sd")
    assert got[2] is None and got[4] == pytest.approx(200**0.5)


def test_streak_signs_and_breaks(spark):
    rows = [("a", s, s, x) for s, x in enumerate([1.0, 1.0, None, -1.0, -1.0, 1.0], 1)]
    assert by_id(h.streak(log(spark, rows), BY, F.col("v") > 0), "streak") == {1: 0, 2: 1, 3: 2, 4: 0, 5: -1, 6: -2}


def test_running_median_skips_nulls(spark):
    assert by_id(h.running_median(log(spark), BY, "v", "m"), "m") == {1: 10.0, 2: 10.0, 3: 20.0, 4: 30.0, 5: 7.0}


@pytest.mark.parametrize("bucket", [None, 2])
def test_as_of_is_strict_and_ties_go_to_the_tiebreak(spark, bucket):
    right = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("a", 2, 3, 3.0), (None, 0, 4, 9.0)], "k string, q long, j long, x double").withColumn("at", F.timestamp_seconds("q")).select("k", "at", "j", "x")
    left = log(spark, [*ROWS, (None, 5, 6, 1.0)])
    got = by_id(asof.asof_join(left, right, ["k"], "t", "at", ["x"], "j", bucket), "x")
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 3.0, 5: None, 6: None}


def test_pushes_are_no_decisions(spark):
    rows = [("a", s, s, v) for s, v in enumerate([5.0, 6.0, 4.0, 7.0, 8.0], 1)]
    r = markets.hit_rates(log(spark, rows), "k", [F.desc("t")], "v", F.lit(5.0), (5,)).first()
    assert (r["last_5_over"], r["last_5_under"], r["last_5_rate"]) == (3, 1, 0.75)


def test_bootstrap_is_the_same_each_time_and_finds_the_sign(spark):
    pairs = spark.createDataFrame([(c, float(x), float(x + (c * 7 + x * 3) % 4)) for c in range(12) for x in range(6)], "c long, x double, y double")
    a, b = (markets.cluster_bootstrap(pairs, "c", "x", "y", 200).first() for _ in range(2))
    assert a == b and a["r"] > 0.5 and a["p_not_positive"] < 0.05 and a["resamples"] == 200


def test_upsert_twice_is_upsert_once(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = dml.upsert(old, new, ["k"], ["v"])
    assert sorted(once.collect()) == sorted(dml.upsert(once, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_null_is_no_category_and_scales_to_null(spark):
    df = spark.createDataFrame([("x", 1.0), (None, None)], "c string, v double")
    hot = columns.one_hot(df, "c", ["x"]).collect()
    assert (hot[1]["c_is_x"], hot[1]["c_is_other"]) == (False, False)
    assert [r["v_scaled"] for r in columns.fit_scale(df, ["v"]).collect()] == [0.0, None]


CONTEXT = p.Context(datetime(2024, 1, 1, tzinfo=timezone.utc))
LOAD = "k", "s", "i", "v", "t", "seen"


def chain(spark, *steps):
    return p.Pipeline("test", (p.source("load", lambda _: log(spark).withColumn("seen", F.col("t")), "seen", LOAD), *steps), "t")


def test_guard_lets_strict_windows_pass_and_stops_open_ones(spark):
    roll = p.windowed("roll", lambda df: h.rolling(df, BY, ["v"], 2), ["v_roll", "roll_rows", "roll_window_end"], ["roll_window_end"])
    assert chain(spark, roll).run(CONTEXT).df.count() == 5
    leak = p.windowed("leak", lambda df: df.withColumn("end", F.col("t")), ["end"], ["end"])
    with pytest.raises(LeakageError):
        chain(spark, leak).run(CONTEXT)
    # A filter that would hide the leaky rows comes too late.
    with pytest.raises(LeakageError):
        chain(spark, leak, p.keep("none", lambda _: F.lit(False))).run(CONTEXT)
    assert chain(spark, leak).unguarded().run(CONTEXT).df.count() == 5


def test_guard_counts_rows(spark):
    twice = p.row_local("twice", lambda df: df.unionByName(df), [])
    lost = p.windowed("lost", lambda df: df.filter("v > 10").withColumn("end", F.col("t") - F.expr("interval 1 second")), ["end"], ["end"])
    grown = p.keep("grown", lambda _: F.lit(True))
    grown = p.Step("grown", grown.provenance, lambda df, _: df.unionByName(df))
    more = p.windowed("more", lambda df: df.unionByName(df).withColumn("end", F.col("t") - F.expr("interval 1 second")), ["end"], ["end"])
    for step in (twice, lost, grown, more):
        # What a plan shows isn't counted.
        with pytest.raises(StepContractError, match="rows of" if step in (lost, more) else "has Union"):
            chain(spark, step).run(CONTEXT)
        assert chain(spark, step).with_guard(False).run(CONTEXT).df.count() != 5
    assert chain(spark, p.keep("few", lambda _: F.col("v") > 10)).run(CONTEXT).df.count() == 2


def test_frames_and_anchors_are_instants(spark):
    made = p.Frame.from_rows(spark, [(1, datetime(2024, 1, 1), datetime(2024, 1, 1))], "i long, t timestamp, seen timestamp", "t", ["seen"])
    assert made.select("i", "t", "seen").df.count() == 1 and p.Frame.empty(spark, "i long, t timestamp", "t").df.count() == 0
    with pytest.raises(StepContractError):
        made.select("i", "t")
    with pytest.raises(StepContractError):
        p.Frame.from_rows(spark, [], "i long, t timestamp, seen timestamp_ntz", "t", ["seen"])
    with pytest.raises(StepContractError):
        p.Frame.empty(spark, "i long, t timestamp", "other")
    wall = p.windowed("wall", lambda df: df.withColumn("end", F.lit("2020-01-01").cast("timestamp_ntz")), ["end"], ["end"])
    with pytest.raises(StepContractError, match="timestamp_ntz"):
        chain(spark, wall).run(CONTEXT)


def test_running_latest_without_median_is_the_same(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice("uvwxyz"), rng.randrange(40), rng.choice([None, 0.05, 0.05, 0.1, 7.25, 1e6]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, vendor string, t long, v double, i long")
    full = h.running_latest(df, ["g"], "vendor", "t", "v", "i").drop("median")
    sums = h.running_latest(df, ["g"], "vendor", "t", "v", "i", median=False)
    for x, y in zip(sorted(map(tuple, full.collect())), sorted(map(tuple, sums.collect())), strict=True):
        assert x[:2] == y[:2] and x[4] == y[4] and x[2] == pytest.approx(y[2], rel=1e-9, abs=1e-6) and x[3] == pytest.approx(y[3], rel=1e-6, abs=1e-2)


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_next_and_nearest_are_running_values(spark, bucket):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.randrange(300), i) for i in range(150)]
    right = [(rng.choice("ab"), rng.randrange(300), i, float(rng.randrange(50))) for i in range(120)]
    lf = spark.createDataFrame(left, "k string, s long, i long").withColumn("t", F.timestamp_seconds("s"))
    rf = spark.createDataFrame(right, "k string, s long, j long, v double").withColumn("u", F.timestamp_seconds("s"))
    after = {r["i"]: r["next_v"] for r in asof.next_after(lf, rf, ["k"], "t", "u", "v", "j", bucket).collect()}
    near = {r["i"]: r["nearest_v"] for r in asof.nearest_within(lf, rf, ["k"], "t", "u", "v", 5, "j", bucket).collect()}
    for k, s, i in left:
        later = [(x, j, v) for q, x, j, v in right if q == k and x > s]
        assert after[i] == (min(later)[2] if later else None)
        upto, ahead = [(x, j, v) for q, x, j, v in right if q == k and x <= s], later
        back, fore = max(upto, default=None), min(ahead, default=None)
        best = back if back and (not fore or s - back[0] <= fore[0] - s) else fore
        assert near[i] == (best[2] if best and abs(best[0] - s) <= 5 else None)


def test_guard_stops_rows_from_the_future(spark):
    with pytest.raises(LeakageError):
        chain(spark).run(p.Context(datetime(1970, 1, 1, 0, 0, 2, tzinfo=timezone.utc)))


def test_steps_must_do_what_they_declare(spark):
    with pytest.raises(UndeclaredProvenanceError):
        chain(spark, p.row_local("x", lambda df: df.withColumn("y", F.lit(1)), ["z"])).run(CONTEXT)
    with pytest.raises(StepContractError):
        chain(spark, p.row_local("x", lambda df: df.drop("v"), [])).run(CONTEXT)
    with pytest.raises(StepContractError):
        chain(spark, p.row_local("x", lambda df: df, [], ["nothing"])).run(CONTEXT)


def test_plans_are_edited_by_name(spark):
    step = p.row_local("one", lambda df: df.withColumn("one", F.lit(1)), ["one"])
    plan = chain(spark, step)
    assert [s.name for s in plan.insert_after("load", p.keep("k", lambda _: F.lit(True))).steps] == ["load", "k", "one"]
    assert [s.name for s in plan.without("one").steps] == ["load"]
    with pytest.raises(Exception, match="no step"):
        plan.without("two")
