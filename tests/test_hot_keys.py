"""Keys with most of the rows: the same rows as without blocks, no task with a whole key, ids that stay as they are."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as h
from tidemark.operators import hot

BY = h.History(("k",), "t", "i")
KIND = "k string, s long, i long, v double, season int, won boolean, big long"


def frame(spark, n=600, seed=1):
    """Half of the rows are one key's; instants repeat, values, results and keys are null at times."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(n // 3), i, rng.choice([None, 1.0, 2.0, rng.random()]), rng.randrange(2), rng.choice([True, True, False, None]), None if i % 7 == 0 else 2**60 + i) for i in range(n)]
    return spark.createDataFrame(rows, KIND).withColumn("t", F.timestamp_seconds("s"))


def equal(a, b, key="i"):
    a, b = ({r[key]: r.asDict() for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and len(a) > 100
    for k in a:
        for c in b[k]:
            assert a[k][c] == (pytest.approx(b[k][c], rel=1e-9, abs=1e-9) if isinstance(b[k][c], float) else b[k][c]), (k, c)


@pytest.mark.parametrize("rows", [7, 64, 10_000])
def test_blocks_give_what_windows_give(spark, rows):
    df = frame(spark)
    equal(h.rolling(df, BY, ["v"], 5, block_rows=rows), h.rolling(df, BY, ["v"], 5))
    equal(h.expanding(df, BY, ["v"], block_rows=rows), h.expanding(df, BY, ["v"]))
    equal(h.expanding(df, BY, ["v"], "season", block_rows=rows), h.expanding(df, BY, ["v"], "season"))
    equal(h.season_to_date(df, BY, F.col("won"), "season", block_rows=rows), h.season_to_date(df, BY, F.col("won"), "season"))
    equal(h.streak(df, BY, F.col("won"), "season", block_rows=rows), h.streak(df, BY, F.col("won"), "season"))
    equal(h.streak(df, BY, F.col("won"), block_rows=rows), h.streak(df, BY, F.col("won")))


@pytest.mark.parametrize("rows", [30, 10_000])
def test_other_bounded_windows_of_blocks(spark, rows):
    df = frame(spark, 400, seed=5).withColumn("w", F.col("i") % 4)
    pairs = [
        lambda b: h.dispersion(df, BY, "v", 6, block_rows=b), lambda b: h.slope(df, BY, "v", 6, block_rows=b), lambda b: h.rolling_rate(df, BY, "v", "w", 5, 36.0, block_rows=b),
        lambda b: h.rolling_weighted(df, BY, "v", "w", 5, block_rows=b), lambda b: h.rolling_share(df, BY, "v", ["k", "season"], 5, block_rows=b), lambda b: h.exponential(df, BY, "v", 1.0, 1e-3, block_rows=b),
    ]
    for made in pairs:
        equal(made(rows), made(None))


def test_a_window_fits_its_block(spark):
    with pytest.raises(ValueError, match="too small"):
        h.rolling(frame(spark), BY, ["v"], 5, block_rows=4)


def test_no_task_holds_a_key(spark):
    """What tasks get is a block, and all but one of a key's blocks are full."""
    df = frame(spark, 2000)
    blocks = BY.blocks(df, 50)
    sizes = [r["count"] for r in blocks.df.groupBy("k", "__block").count().collect()]
    assert max(sizes) == 50 and sum(sizes) == 2000
    lent = blocks.bounded(5, lambda w: {"x": F.count("*").over(w.rowsBetween(-5, -1))})
    assert lent.df.count() == 2000
    plan = h.rolling(df, BY, ["v"], 5, block_rows=50)._jdf.queryExecution().executedPlan().toString().splitlines()
    alone = [i for i, line in enumerate(plan) if re.search(r"hashpartitioning\(k#[0-9]+, [0-9]+\)", line)]
    # By the key alone go only sums of ranges, of which a key has few.
    assert alone and all("HashAggregate" in plan[i + 1] for i in alone)


def test_places_are_counted_over_ranges(spark):
    rows = {r["i"]: r for r in hot.placed(frame(spark, 900), ["k"], ["s", "i"], {"n": F.lit(1), "known": F.col("v").isNotNull()}).collect()}
    for k in ("hot", "a", None):
        own = sorted((r for r in rows.values() if r["k"] == k), key=lambda r: (r["s"], r["i"]))
        assert [r["n"] for r in own] == list(range(len(own)))
        assert [r["known"] for r in own] == [sum(x["v"] is not None for x in own[:j]) for j in range(len(own))]


def brute_medians(rows):
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["s"], r["i"])):
        own = held.setdefault(r["k"], [])
        if r["v"] is not None and r["v"] == r["v"]:
            own.append(r["v"])
        out[r["i"]] = float(np.median(own)) if own else None
    return out


@pytest.mark.parametrize("rows", [1, 5, 40, 65_536])
def test_running_medians_of_blocks(spark, rows):
    df = frame(spark, 500, seed=2)
    got = {r["i"]: r for r in h.running_median(df, BY, "v", "m", rows).collect()}
    want = brute_medians([r.asDict() for r in df.collect()])
    assert {i: r["m"] for i, r in got.items()} == pytest.approx(want)
    assert all(r["big"] == (None if i % 7 == 0 else 2**60 + i) for i, r in got.items())


@pytest.mark.parametrize("shape", ["rising", "falling", "equal", "nulls", "nan"])
def test_running_medians_of_one_key(spark, shape):
    n = 3000
    value = {"rising": "cast(id as double)", "falling": "cast(-id as double)", "equal": "1.0d", "nulls": "if(id % 1000 < 990, null, cast(id as double))", "nan": "if(id % 3 = 0, double('nan'), cast((id * 7919) % 1000 as double))"}[shape]
    df = spark.range(n).selectExpr("1L as k", "id as s", "id as i", f"{value} as v").withColumn("t", F.timestamp_seconds("s"))
    got = {r["i"]: r["m"] for r in h.running_median(df, BY, "v", "m", 64).collect()}
    assert got == pytest.approx(brute_medians([r.asDict() for r in df.collect()]))


def test_quantiles_of_many_ranges():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 20, 500).astype(float)
    start = rng.integers(0, 400, 300)
    stop = start + rng.integers(1, 100, 300)
    k = (rng.random(300) * (stop - start)).astype(np.int64)
    want = [np.sort(values[a:b])[i] for a, b, i in zip(start, stop, k, strict=True)]
    assert hot.quantiles(values, start, stop, k).tolist() == want


def test_folds_keep_other_columns_as_they_are(spark):
    df = frame(spark)
    fold = h.Fold("seen long", lambda: 0, lambda s: (s,), lambda s, row: s + 1)
    got = {r["i"]: r for r in h.trailing_fold(df, BY, fold).collect()}
    assert all(r["big"] == (None if i % 7 == 0 else 2**60 + i) for i, r in got.items())
    own = [r for r in got.values() if r["k"] == "hot"]
    assert all(r["seen"] == sum(x["s"] < r["s"] for x in own) for r in own)


def test_medians_of_vendors_keep_large_groups_ids(spark):
    rows = [(2**60 + 1, "x", 1, 1.0, 1), (None, "x", 1, 2.0, 2), (2**60 + 3, "y", 2, 3.0, 3)]
    got = h.running_latest(spark.createDataFrame(rows, "g long, vendor string, t long, v double, i long"), ["g"], "vendor", "t", "v", "i").collect()
    assert {(r["g"], r["median"]) for r in got} == {(2**60 + 1, 1.0), (None, 2.0), (2**60 + 3, 3.0)}


def test_mirrors_meet_in_one_window(spark):
    rows = [(1, "a", "b", 5, 2**60 + 1), (1, "b", "a", 6, None), (2, "a", "c", 7, 1), (None, "a", "b", 8, 1), (None, "b", "a", 9, 1), (3, None, "a", 1, 1), (4, "d", "d", 3, 3)]
    df = spark.createDataFrame(rows, "g int, own string, opp string, x int, big long")
    once = h.mirror(df, ["g"], "own", "opp", ["x", "big"])
    got = {(r["g"], r["own"]): (r["opponent_x"], r["opponent_big"]) for r in once.collect()}
    assert got == {(1, "a"): (6, None), (1, "b"): (5, 2**60 + 1), (2, "a"): (None, None), (None, "a"): (None, None), (None, "b"): (None, None), (3, None): (None, None), (4, "d"): (3, 3)}
    for n in range(6):
        once = h.mirror(once, ["g"], "own", "opp", ["x"], f"o{n}_")
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
