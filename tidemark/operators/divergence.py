"""Divergences between books and venues: found, looked at again at the book's next quote, and graded at the close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.odds import american_to_implied
from tidemark.operators import asof

SIDES = ("home", "away")


def detect(quotes: DataFrame, venues: DataFrame, games: DataFrame, now: Column, least_volume: float) -> DataFrame:
    """(game_id, venue, side, book_vendor, book_odds, book_implied, venue_fair, edge, observed_at, in_play, minutes_from_start).

    ``quotes``: game_id, vendor, at, home_odds, away_odds; of each vendor the newest up to ``now`` counts.
    ``venues``: game_id, venue, fair_home, volume; ``games``: game_id, start_time.  A side's best price is the
    one with the highest odds, ties to the smaller vendor, vendors without odds aside; an edge is what the venue's fair price is above it.
    """
    newest = quotes.filter(F.col("at") <= now).groupBy("game_id", "vendor").agg(F.max(F.struct("at", "home_odds", "away_odds")).alias("q"))
    best = newest.groupBy("game_id").agg(*[F.min(F.when(F.col(f"q.{s}_odds").isNotNull(), F.struct((-F.col(f"q.{s}_odds")).alias("less"), "vendor"))).alias(s) for s in SIDES])
    priced = venues.filter((F.col("volume") >= least_volume) & F.col("fair_home").isNotNull()).join(best, "game_id").join(games.select("game_id", "start_time"), "game_id")
    fair = {"home": F.col("fair_home"), "away": 1 - F.col("fair_home")}
    one = [F.struct(F.lit(s).alias("side"), F.col(f"{s}.vendor").alias("book_vendor"), (-F.col(f"{s}.less")).alias("book_odds"), fair[s].alias("venue_fair")) for s in SIDES]
    each = priced.select("game_id", "venue", "start_time", F.explode(F.array(*one)).alias("s")).select("game_id", "venue", "start_time", "s.*").filter("book_odds is not null")
    minutes = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 60_000_000
    scored = each.withColumn("book_implied", american_to_implied(F.col("book_odds"))).withColumn("edge", F.col("venue_fair") - F.col("book_implied"))
    return scored.filter("edge > 0").select("game_id", "venue", "side", "book_vendor", "book_odds", "book_implied", "venue_fair", "edge", now.alias("observed_at"), (minutes >= 0).alias("in_play"), minutes.alias("minutes_from_start"))


def by_side(quotes: DataFrame) -> DataFrame:
    """(game_id, side, vendor, at, odds): a row for each side that is quoted."""
    one = [F.struct(F.lit(s).alias("side"), F.col(f"{s}_odds").alias("odds")) for s in SIDES]
    return quotes.select("game_id", "vendor", "at", F.explode(F.array(*one)).alias("s")).select("game_id", "s.side", "vendor", "at", "s.odds").filter("odds is not null")


def recheck(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """``found`` with recheck_odds and survived: whether the game's next quote of that side, after the instant at
    which it was found, was as good or better.  Null while there is none; no clock but the rows' own."""
    sided = by_side(quotes).withColumn("tie", F.struct("vendor", "odds"))
    out = asof.next_after(found, sided, ["game_id", "side"], "observed_at", "at", "odds", "tie").withColumnRenamed("next_odds", "recheck_odds")
    still = american_to_implied(F.col("recheck_odds")) <= american_to_implied(F.col("book_odds"))
    return out.withColumn("survived", F.when(F.col("recheck_odds").isNotNull(), still))


def grade(found: DataFrame, quotes: DataFrame, games: DataFrame) -> DataFrame:
    """``found`` with closing_odds, clv and won, of games with a result (``games``: game_id, start_time, home_won).

    The close is the best of the odds at the last instant before the start; what has no close or result stays null.
    """
    sided = by_side(quotes).join(games.select("game_id", "start_time"), "game_id").filter(F.col("at") < F.col("start_time"))
    close = sided.groupBy("game_id", "side").agg(F.max(F.struct("at", "odds"))["odds"].alias("closing_odds"))
    joined = found.join(close, ["game_id", "side"], "left").join(games.select("game_id", "home_won"), "game_id", "left")
    known = F.col("closing_odds").isNotNull() & F.col("home_won").isNotNull()
    made = {"clv": F.when(known, american_to_implied(F.col("closing_odds")) - F.col("book_implied")), "won": F.when(known, F.col("home_won") == (F.col("side") == "home"))}
    return joined.withColumns(made).withColumn("closing_odds", F.when(known, F.col("closing_odds"))).drop("home_won")
