"""Rosters, form, records and zones of all teams and players at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rosters as r
from tidemark.queries.catalog import long, query, rounded, table
from tidemark.queries.strategies import _GAMES, CONTEXT, tables


@query("""WITH s AS (SELECT l_suppkey AS team, l_partkey % 20 AS player, l_orderkey AS game, l_returnflag AS source, CASE WHEN l_linenumber % 5 <> 0 THEN l_linenumber = 6 END AS out, l_quantity AS points, round(l_discount * 100) AS assists, CASE WHEN l_linenumber <> 4 THEN round(l_tax * 100) END AS minutes, l_linenumber, l_extendedprice FROM lineitem),
o AS (SELECT * FROM s WHERE out IS NOT TRUE QUALIFY row_number() OVER (PARTITION BY player, game ORDER BY CASE source WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_extendedprice) = 1),
m AS (SELECT team, player, count(*) AS games_played, avg(points) AS points, avg(assists) AS assists, avg(minutes) AS minutes FROM o GROUP BY ALL)
SELECT team, player, games_played, round(points, 6) AS points, round(assists, 6) AS assists, round(minutes, 6) AS minutes, row_number() OVER (PARTITION BY team ORDER BY minutes DESC NULLS LAST, player) AS place FROM m""")
def team_rosters(spark: SparkSession, folder: str) -> DataFrame:
    """Every team's players out of who played, a game of several sources counted once."""
    n = F.col("l_linenumber")
    played = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("team"), (F.col("l_partkey") % 20).alias("player"), F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("source"), F.when(n % 5 != 0, n == 6).alias("out"),
        F.col("l_quantity").alias("points"), F.round(F.col("l_discount") * 100).alias("assists"), F.when(n != 4, F.round(F.col("l_tax") * 100)).alias("minutes"), n, "l_extendedprice",
    )
    out = r.roster(played, "team", "player", "game", "source", ["R", "A"], "out", ["points", "assists", "minutes"], "minutes", n, F.col("l_extendedprice"))
    return rounded(out.withColumn("place", long("place")), 6)


@query(_GAMES + """, p AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY start_time DESC, game_id DESC) AS k FROM t WHERE start_time < TIMESTAMP '1998-01-01')
SELECT team_id, count(*) AS games, count(*) FILTER (WHERE ps > pa) AS wins, count(*) FILTER (WHERE ps < pa) AS losses, round(avg(ps), 6) AS points_for, round(avg(pa), 6) AS points_against, round(avg(ps) FILTER (WHERE k <= 5), 6) AS points_for_last5, round(avg(pa) FILTER (WHERE k <= 5), 6) AS points_against_last5,
  count(*) FILTER (WHERE k <= 5 AND ps > pa) AS wins_last5, count(*) FILTER (WHERE k <= 10 AND ps > pa) AS wins_last10, count(*) FILTER (WHERE k <= 10) AS games_last10, max(start_time) FILTER (WHERE k = 1) AS last_game_at FROM p GROUP BY 1""")
def form_before(spark: SparkSession, folder: str) -> DataFrame:
    """Every team's record and form as it was before an instant."""
    games = tables(spark, folder).team_games(CONTEXT).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    return rounded(r.form_before(games, "team_id", "start_time", "game_id", "points_scored", "points_allowed", F.lit("1998-01-01").cast("timestamp_ntz")), 6)


@query("""WITH w AS (SELECT l_suppkey AS team, count(*) FILTER (WHERE l_returnflag = 'R') AS wins, count(*) FILTER (WHERE l_returnflag = 'A') AS losses FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1),
s AS (SELECT *, CASE WHEN wins + losses > 0 THEN round(wins / (wins + losses), 9) END AS pct FROM w)
SELECT s_suppkey AS team, s_name AS name, wins, losses, pct, row_number() OVER (ORDER BY pct DESC NULLS LAST, s_name, s_suppkey) AS place FROM supplier LEFT JOIN s ON team = s_suppkey WHERE s_suppkey % 10 <> 9""")
def listed_teams(spark: SparkSession, folder: str) -> DataFrame:
    """All teams with their standings, those without any last."""
    lines = table(spark, folder, "lineitem").filter("l_suppkey % 3 <> 0")
    won = lines.groupBy(F.col("l_suppkey").alias("team")).agg(F.count_if(F.col("l_returnflag") == "R").alias("wins"), F.count_if(F.col("l_returnflag") == "A").alias("losses"))
    total = F.col("wins") + F.col("losses")
    teams = table(spark, folder, "supplier").filter("s_suppkey % 10 <> 9").select(F.col("s_suppkey").alias("team"), F.col("s_name").alias("name"))
    out = r.listed(teams, won.withColumn("pct", F.when(total > 0, F.round(F.col("wins") / total, 9))), "team", "name", "pct")
    return out.select("team", "name", "wins", "losses", "pct", long("place").alias("place"))


@query("""WITH l AS (SELECT user_id, event_type, value, CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS made, event_id % 7 + event_id % 5 AS tried FROM events)
SELECT user_id, event_type, count(*) AS games, round(sum(value) / count(*), 6) AS value, CASE WHEN sum(tried) > 0 THEN round(coalesce(sum(made), 0) / sum(tried), 6) END AS made_share FROM l GROUP BY ALL""")
def record_against(spark: SparkSession, folder: str) -> DataFrame:
    """Every player's record against every opponent."""
    e = F.col("event_id")
    log = table(spark, folder, "events").select("user_id", "event_type", "value", F.when(e % 3 != 0, e % 7).alias("made"), (e % 7 + e % 5).alias("tried"))
    return rounded(r.record_against(log, ["user_id", "event_type"], ["value"], "made", "tried"), 6)


@query("""WITH l AS (SELECT l_linenumber AS zone, l_suppkey AS player, l_partkey % 50 AS opponent, l_returnflag = 'R' AS made FROM lineitem),
p AS (SELECT player, zone, count(*) FILTER (WHERE made) AS m, count(*) AS n FROM l GROUP BY ALL), d AS (SELECT opponent, zone, count(*) FILTER (WHERE made) AS m, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT zone, count(*) FILTER (WHERE made) / count(*) AS rate FROM l GROUP BY 1)
SELECT p.player, d.opponent, p.zone, round(p.m / p.n - rate, 9) AS own_edge, round(d.m / d.n - rate, 9) AS allowed_edge, round(p.m / p.n - rate + d.m / d.n - rate, 9) AS edge_sum FROM p JOIN d ON d.zone = p.zone AND d.opponent = p.player % 50 JOIN g ON g.zone = p.zone WHERE p.n >= 15 AND d.n >= 15""")
def zone_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Every zone of a player against the defence that is met, however small the edge."""
    lines = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("zone"), F.col("l_suppkey").alias("player"), (F.col("l_partkey") % 50).alias("opponent"), (F.col("l_returnflag") == "R").alias("made"))
    count = lambda df, side: df.agg(F.count_if("made").alias(f"{side}_made"), F.count("*").alias(f"{side}_tried"))
    players = count(lines.groupBy("player", "zone"), "player").withColumn("opponent", F.col("player") % 50)
    league = count(lines.groupBy("zone"), "league").select("zone", (F.col("league_made") / F.col("league_tried")).alias("league_rate"))
    out = r.zone_comparison(players, count(lines.groupBy("opponent", "zone"), "defence"), league, "zone")
    return rounded(out.select("player", "opponent", "zone", "own_edge", "allowed_edge", "edge_sum"), 9)
