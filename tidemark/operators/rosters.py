"""Who is in a team and how it stands: rosters out of who played, form before an instant, records, zones compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import hot
from tidemark.operators import relational as rel


def roster(played: DataFrame, team: str, player: str, game: str, source: str, precedence: Sequence[str], absent: str, values: Sequence[str], by: str, *then: Column) -> DataFrame:
    """(team, player, games_played, the values' means, place): a team's players by their mean of ``by``.

    A game that several sources tell counts once, by the first of them in ``precedence`` (then ``then``); rows whose
    ``absent`` is true don't count, those that don't say do.  Players without a mean come last, ties by their id.
    """
    there = played.filter(~F.coalesce(F.col(absent), F.lit(False)))
    once = rel.by_precedence(there, [player, game], source, precedence, *then)
    means = once.groupBy(team, player).agg(F.count("*").alias("games_played"), *[F.avg(v).alias(v) for v in values])
    return means.withColumn("place", F.row_number().over(Window.partitionBy(team).orderBy(F.desc_nulls_last(by), player)))


def form_before(games: DataFrame, team: str, time: str, game: str, scored: str, allowed: str, before: Column | None = None) -> DataFrame:
    """What a team has done (a row for each team and game), all of it and lately, before an instant: games, wins,
    losses, means for and against, the same of the last five, wins of the last five and ten, the newest game's time.

    Level games are neither won nor lost; games without a score aren't played yet.
    """
    known = games.filter(F.col(scored).isNotNull() & F.col(allowed).isNotNull())
    known = known if before is None else known.filter(F.col(time) < before)
    recency = F.row_number().over(Window.partitionBy(team).orderBy(F.desc(time), F.desc(game)))
    won, lost, n = F.col(scored) > F.col(allowed), F.col(scored) < F.col(allowed), F.col("__n")
    late = lambda k, c: F.when(n <= k, F.col(c))
    return known.withColumn("__n", recency).groupBy(team).agg(
        F.count("*").alias("games"), F.count_if(won).alias("wins"), F.count_if(lost).alias("losses"), F.avg(scored).alias("points_for"), F.avg(allowed).alias("points_against"),
        F.avg(late(5, scored)).alias("points_for_last5"), F.avg(late(5, allowed)).alias("points_against_last5"), F.count_if((n <= 5) & won).alias("wins_last5"),
        F.count_if((n <= 10) & won).alias("wins_last10"), F.count_if(n <= 10).alias("games_last10"), F.max(late(1, time)).alias("last_game_at"),
    )


def listed(teams: DataFrame, standings: DataFrame, key: str, name: str, share: str) -> DataFrame:
    """All ``teams``, with their standings where there are any, and their place: by ``share``, those without one last,
    ties by name."""
    met = teams.join(standings, key, "left").withColumns({"__none": F.col(share).isNull(), "__less": -F.col(share)})
    # Places are counted over a sort of all tasks.
    placed = hot.placed(met, [], ["__none", "__less", name, key], {"place": F.lit(1)})
    return placed.withColumn("place", F.col("place") + 1).drop("__none", "__less")


def record_against(log: DataFrame, keys: Sequence[str], values: Sequence[str], made: str, tried: str) -> DataFrame:
    """A row for each of ``keys`` (such as player and opponent): games, means (null counts as nothing had), and the
    share of all tries that were made; null where nothing was tried."""
    total = {c: F.sum(F.coalesce(F.col(c), F.lit(0))) for c in (*values, made, tried)}
    return log.groupBy(*keys).agg(F.count("*").alias("games"), *[(total[v] / F.count("*")).alias(v) for v in values], F.when(total[tried] > 0, total[made] / total[tried]).alias(f"{made}_share"))


def zone_comparison(players: DataFrame, defences: DataFrame, league: DataFrame, zone: str, least: int = 15) -> DataFrame:
    """Player against the opponent's defence, zone by zone, each as what it is above the league's rate, and their sum;
    zones with fewer than ``least`` tries of either go.  ``*_made`` over ``*_tried``; ``league``: league_rate."""
    met = players.join(defences, ["opponent", zone]).join(league, zone).filter((F.col("player_tried") >= least) & (F.col("defence_tried") >= least))
    made = {"own_edge": F.col("player_made") / F.col("player_tried") - F.col("league_rate"), "allowed_edge": F.col("defence_made") / F.col("defence_tried") - F.col("league_rate")}
    return met.withColumns(made).withColumn("edge_sum", F.col("own_edge") + F.col("allowed_edge"))
