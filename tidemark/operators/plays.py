"""What a game's plays add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.odds import clock_seconds


def play_aggregate(plays: DataFrame, game: str, team: str, order: str, period: str, clock: str, points: str, home: str, away: str) -> DataFrame:
    """(game, team, points by period, overtime and clutch, largest_run, lead_changes, largest_lead).

    Only plays that score count.  Clutch is the last five minutes of regulation and all overtime, however close
    the game is; a clock that isn't one counts nowhere in it.  A run is what a team scores in a row; the leads are
    the game's and so both teams' alike, and level scores lead nobody.
    """
    scoring = plays.filter((F.col(points) > 0) & F.col(team).isNotNull())
    by = Window.partitionBy(game).orderBy(order)
    margin = F.col(home) - F.col(away)
    before = F.lag(margin).over(by)
    changed = (~F.col(team).eqNullSafe(F.lag(team).over(by))).cast("int")
    told = scoring.withColumns({"__margin": margin, "__turn": (F.sign(margin) * F.sign(before) < 0).cast("int"), "__changed": changed})
    told = told.withColumn("__run", F.sum("__changed").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    p, left, x = F.col(period), clock_seconds(F.col(clock)), F.col(points)
    parts = {f"period_{n}_points": p == n for n in (1, 2, 3, 4)} | {"overtime_points": p >= 5, "clutch_points": (p >= 4) & (left <= 300)}
    leads = {"lead_changes": (F.sum, F.coalesce("__turn", F.lit(0))), "largest_lead": (F.max, F.abs("__margin"))}
    runs = told.groupBy(game, team, "__run").agg(F.sum(x).alias("__points"), *[F.sum(F.when(c, x)).alias(n) for n, c in parts.items()], *[f(c).alias(n) for n, (f, c) in leads.items()])
    teams = runs.groupBy(game, team).agg(*[F.sum(n).alias(n) for n in parts], F.max("__points").alias("largest_run"), *[f(n).alias(n) for n, (f, _) in leads.items()])
    return teams.filter(F.col(game).isNotNull()).withColumns({n: f(n).over(Window.partitionBy(game)) for n, (f, _) in leads.items()})


def running_score(events: DataFrame, game: str, order: str, score: str) -> DataFrame:
    """``events`` with home_score, away_score, scoring_play and score_value.

    A feed gives the score ("12 - 10") with the plays that change it: others carry the last one on, from 0, and
    a play's value is what it adds to both sides together.
    """
    shape = r"^\s*([0-9]+)\s*-\s*([0-9]+)\s*$"
    good = F.coalesce(F.col(score).rlike(shape), F.lit(False))
    side = lambda k: F.when(good, F.regexp_extract(score, shape, k).cast("int"))
    w = Window.partitionBy(game).orderBy(order)
    now, was = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    read = events.withColumns({"__h": side(1), "__a": side(2)})
    last = lambda c, frame: F.coalesce(F.last(c, ignorenulls=True).over(frame), F.lit(0))
    made = {"home_score": last("__h", now), "away_score": last("__a", now), "scoring_play": good, "score_value": F.when(good, F.col("__h") + F.col("__a") - last("__h", was) - last("__a", was)).otherwise(0)}
    return read.withColumns(made).drop("__h", "__a")


def relink(rows: DataFrame, market: Sequence[str], link: str, resolved: DataFrame) -> DataFrame:
    """``rows`` with a null ``link`` filled by market from ``resolved`` (``market`` columns, ``link``).

    A market is resolved once, however many rows it has; links that are there stay.
    """
    found = resolved.select(*market, F.col(link).alias("__link")).filter(F.col("__link").isNotNull()).dropDuplicates(list(market))
    return rows.join(found, list(market), "left").withColumn(link, F.coalesce(link, "__link")).select(rows.columns)


def unlinked(rows: DataFrame, market: Sequence[str], link: str, *more: str) -> DataFrame:
    """Each market without a link, once, with what it is to be resolved by."""
    return rows.filter(F.col(link).isNull()).select(*market, *more).distinct()
