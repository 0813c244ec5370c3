"""What a desk asks of games, players, prices and reports: the reference's result sets on the driver's tables.

Orders are games, lines their quotes, stat rows or plays, suppliers teams or vendors, parts players.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import markets
from tidemark.operators import relational as rel
from tidemark.operators.history import dealt
from tidemark.queries.catalog import query, rounded, table, tasks

@query("""SELECT l_orderkey AS game_id, l_shipdate AS captured_at, l_suppkey AS vendor, l_linenumber AS n, l_discount AS spread, l_tax AS total, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS INT) AS rank
FROM lineitem QUALIFY rank <= 100""")
def odds_history(spark: SparkSession, folder: str) -> DataFrame:
    """Each game's quotes, oldest first, a hundred at most."""
    asked = table(spark, folder, "lineitem")
    ranked = rel.top_per(asked, ["l_orderkey"], 100, F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"))
    return ranked.select(F.col("l_orderkey").alias("game_id"), F.col("l_shipdate").alias("captured_at"), F.col("l_suppkey").alias("vendor"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("spread"), F.col("l_tax").alias("total"), "rank")


@query("""WITH d AS (SELECT l_returnflag AS venue, l_discount AS edge, CASE WHEN l_linenumber <> 3 THEN l_tax - 0.04 END AS clv, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS survived, CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 END AS won FROM lineitem)
SELECT venue, count(*) AS observations, count(clv) AS clv_graded, count(*) FILTER (WHERE survived) AS price_survived, count(survived) AS survival_checked, round(avg(edge), 4) AS mean_edge, round(avg(clv), 4) AS mean_clv, count(*) FILTER (WHERE won) AS won, count(won) AS settled FROM d GROUP BY 1""")
def divergence_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    clv, survived = F.when(F.col("l_linenumber") != 3, F.col("l_tax") - 0.04), F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False)
    d = lines.select(F.col("l_returnflag").alias("venue"), F.col("l_discount").alias("edge"), clv.alias("clv"), survived.alias("survived"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 25).alias("won"))
    return rounded(markets.divergence_summary(d, ["venue"]), 4)


@query("""WITH g AS (SELECT o_custkey % 50 AS team, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT team, l_linenumber AS zone, count(*) AS attempts, count(*) FILTER (WHERE l_quantity > 25) AS made, round(count(*) FILTER (WHERE l_quantity > 25) / count(*), 6) AS share FROM g JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 10 GROUP BY ALL""")
def recent_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Shots by zone over each team's ten newest games."""
    orders = table(spark, folder, "orders").withColumn("team", F.col("o_custkey") % 50)
    recent = rel.top_per(orders, ["team"], 10, F.desc("o_orderdate"), F.desc("o_orderkey")).select("team", "o_orderkey")
    made = F.count_if(F.col("l_quantity") > 25)
    shots = recent.join(table(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(shots.groupBy("team", F.col("l_linenumber").alias("zone")).agg(F.count("*").alias("attempts"), made.alias("made"), rel.ratio(made, F.count("*")).alias("share")), 6)


@query("""WITH e AS (SELECT user_id, event_id // 3 AS game, event_type AS source, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id FROM events WHERE event_type <> 'error'),
o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, game ORDER BY source, event_id) = 1)
SELECT user_id, count(*) AS games, arg_max(source, (game, event_id)) AS team, round(avg(value), 6) AS usage, round(avg(floor(value) + (k % 60) / 60.0), 6) AS minutes FROM o GROUP BY 1 HAVING count(*) >= 5""")
def efficiency(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each player and game, minutes read from a clock; players with five games or more."""
    k = F.get_json_object("props", "$.k").cast("int")
    clock = F.when(F.col("event_type") == "error", "--").otherwise(F.format_string("%d:%02d", F.floor("value").cast("int"), k % 60))
    e = table(spark, folder, "events").select("user_id", F.floor(F.col("event_id") / 3).alias("game"), F.col("event_type").alias("source"), "value", odds.minutes(clock).alias("minutes"), "event_id").filter("minutes is not null")
    one = rel.first_by(e, ["user_id", "game"], F.col("source"), F.col("event_id"))
    out = one.groupBy("user_id").agg(F.count("*").alias("games"), F.max_by("source", F.struct("game", "event_id")).alias("team"), F.avg("value").alias("usage"), F.avg("minutes").alias("minutes"))
    return rounded(out.filter("games >= 5"), 6)


@query("""WITH p AS (SELECT l_orderkey AS game, l_returnflag AS source, l_linenumber AS sequence, l_partkey, l_quantity AS home, l_tax * 100 AS away FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT game, source, count(*) AS n FROM p GROUP BY ALL), c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY game ORDER BY n DESC, source) = 1)
SELECT p.game, p.source, p.sequence, p.l_partkey, round(p.home - p.away, 6) AS margin FROM p JOIN c USING (game, source)""")
def game_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Each game's scoring plays from the source that has most of them."""
    p = table(spark, folder, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("sequence"), "l_partkey", (F.col("l_quantity") - F.col("l_tax") * 100).alias("margin"))
    best = rel.first_by(p.groupBy("game", "source").agg(F.count("*").alias("n")), ["game"], F.desc("n"), F.col("source")).select("game", "source")
    return rounded(p.join(best, ["game", "source"]), 6)


_LAST_QUOTES = """v AS (SELECT o_orderkey AS game, l_suppkey AS vendor, l_discount * 200 - 10 AS spread, l_tax * 1000 AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate QUALIFY row_number() OVER (PARTITION BY o_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1),
c AS (SELECT game, avg(spread) AS spread, avg(total) AS total, count(*) AS books FROM v GROUP BY 1),
g AS (SELECT o_orderkey AS game, o_orderdate AS at_, o_custkey % 90 AS home, o_custkey % 77 AS away, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'scheduled' END AS status, floor(o_totalprice / 6000) AS hs, o_custkey % 83 AS as_ FROM orders),
s AS (SELECT game, at_, status, home AS team, away AS opponent, true AS is_home, hs - as_ AS margin, hs + as_ AS points, 1 AS sign FROM g UNION ALL SELECT game, at_, status, away, home, false, as_ - hs, hs + as_, -1 FROM g)
"""


@query(f"""WITH {_LAST_QUOTES} SELECT s.game, team, opponent, is_home, books, round(sign * spread, 6) AS spread, round(total, 6) AS total, CASE WHEN status = 'final' AND round(margin + sign * spread, 6) <> 0 THEN round(margin + sign * spread, 6) > 0 END AS covered, CASE WHEN status = 'final' AND round(points - total, 6) <> 0 THEN round(points - total, 6) > 0 END AS went_over
FROM s LEFT JOIN c USING (game)""")
def team_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Both teams' games with the closing consensus and how they came out against it; level is neither."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    quotes = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("game"), F.col("l_suppkey").alias("vendor"), (F.col("l_discount") * 200 - 10).alias("spread"), (F.col("l_tax") * 1000).alias("total"), F.col("l_shipdate").alias("at"), F.col("o_orderdate").alias("start"), F.col("l_extendedprice").alias("tie"))
    last = markets.last_before(quotes, ["game", "vendor"], "at", "start", ["spread", "total"], "tie")
    consensus = last.groupBy("game").agg(F.avg("spread").alias("spread"), F.avg("total").alias("total"), F.count("*").alias("books"))
    g = orders.select(F.col("o_orderkey").alias("game"), (F.col("o_custkey") % 90).alias("home"), (F.col("o_custkey") % 77).alias("away"), (F.col("o_orderstatus") == "F").alias("final"), F.floor(F.col("o_totalprice") / 6000).alias("hs"), (F.col("o_custkey") % 83).alias("as"), F.lit(True).alias("yes"), F.lit(False).alias("no"))
    both = rel.sides(g, {"home": {"team": "home", "opponent": "away", "is_home": "yes", "own": "hs", "other": "as"}, "away": {"team": "away", "opponent": "home", "is_home": "no", "own": "as", "other": "hs"}}).join(consensus, "game", "left")
    sign = F.when(F.col("is_home"), 1).otherwise(-1)
    beat, over = F.round(F.col("own") - F.col("other") + sign * F.col("spread"), 6), F.round(F.col("own") + F.col("other") - F.col("total"), 6)
    out = both.select("game", "team", "opponent", "is_home", "books", (sign * F.col("spread")).alias("spread"), "total", F.when(F.col("final") & (beat != 0), beat > 0).alias("covered"), F.when(F.col("final") & (over != 0), over > 0).alias("went_over"))
    return rounded(out, 6)


_REPORTS = f"WITH i AS (SELECT user_id AS player, user_id % 12 AS team, event_type AS source, ts, event_id, CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'Out' WHEN 1 THEN 'Questionable' ELSE 'Probable' END AS status FROM events WHERE ts >= TIMESTAMP '2024-01-27'), c AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY player ORDER BY (source = 'view') DESC, ts DESC, event_id DESC) = 1)"


def _current(spark: SparkSession, folder: str) -> DataFrame:
    """Each player's report that counts: the league's own before others', then the newest, of the last days alone."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    i = table(spark, folder, "events").filter(F.col("ts") >= F.lit("2024-01-27").cast("timestamp_ntz")).select(F.col("user_id").alias("player"), (F.col("user_id") % 12).alias("team"), F.col("event_type").alias("source"), "ts", "event_id", F.when(k == 0, "Out").when(k == 1, "Questionable").otherwise("Probable").alias("status"))
    return rel.by_precedence(i, ["player"], "source", ["view"], F.desc("ts"), F.desc("event_id"))


@query(f"{_REPORTS} SELECT player, team, source, ts, event_id, status FROM c")
def current_injuries(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder)


@query(f"""{_REPORTS}, s AS (SELECT user_id AS player, count(*) AS games, avg(value) AS points FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1)
SELECT c.player, c.team, c.status, coalesce(games, 0) AS games, round(points, 1) AS points FROM c LEFT JOIN s USING (player)""")
def injury_impact(spark: SparkSession, folder: str) -> DataFrame:
    """Who is listed, with what they do in a season; players without games stay.  A player's values are added in the
    order of their events and tenths are counted in ten times the mean, so that a mean half-way between two tenths goes
    where SQL's does, however the rows are dealt."""
    log = table(spark, folder, "events").filter((F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("event_type") != "error"))
    so_far = F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    season = log.withColumn("so_far", so_far).groupBy(F.col("user_id").alias("player")).agg(F.count("*").alias("games"), (F.round(F.max_by("so_far", "event_id") / F.count("value") * 10) / 10).alias("points"))
    return _current(spark, folder).join(season, "player", "left").select("player", "team", "status", F.coalesce("games", F.lit(0)).cast("long").alias("games"), "points")


_PROPS = "WITH g AS (SELECT l_partkey AS player, l_linenumber % 3 AS prop, l_orderkey AS game, avg(l_discount * 500) AS line, max(l_quantity) AS realized FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)"


def _props(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter("l_returnflag <> 'N'")
    return lines.groupBy(F.col("l_partkey").alias("player"), (F.col("l_linenumber") % 3).alias("prop"), F.col("l_orderkey").alias("game")).agg(F.avg(F.col("l_discount") * 500).alias("line"), F.max("l_quantity").alias("realized"))


def _graded(g: DataFrame, *keys: str) -> DataFrame:
    over = F.round(F.col("realized") - F.col("line"), 6)
    return g.groupBy(*keys).agg(F.count("*").alias("games"), F.round(F.avg("line"), 2).alias("avg_line"), F.count_if(over > 0).alias("overs"), F.count_if(over < 0).alias("unders"), F.count_if(over == 0).alias("pushes"))


_GRADED = "count(*) AS games, round(avg(line), 2) AS avg_line, count(*) FILTER (WHERE round(realized - line, 6) > 0) AS overs, count(*) FILTER (WHERE round(realized - line, 6) < 0) AS unders, count(*) FILTER (WHERE round(realized - line, 6) = 0) AS pushes"


@query(f"{_PROPS} SELECT player, prop, {_GRADED} FROM g GROUP BY ALL")
def player_prop_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The consensus line against what came of it, for each player and kind of prop."""
    return _graded(_props(spark, folder), "player", "prop")


@query(f"{_PROPS} SELECT prop, {_GRADED} FROM g GROUP BY ALL")
def prop_market_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(_props(spark, folder), "prop")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate AS observed_at, l_linestatus FROM lineitem), q AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT d.l_orderkey, d.l_linenumber, d.l_partkey FROM d JOIN q USING (l_orderkey) WHERE l_linestatus = 'O' AND last > observed_at""")
def recheck_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Observations without a recheck for which a later quote is there by now."""
    lines = table(spark, folder, "lineitem")
    newest = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    waiting = lines.filter("l_linestatus = 'O'")
    return waiting.join(newest, "l_orderkey").filter("last > l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_orderkey AS game, l_returnflag AS source, CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS summed, o_custkey AS final FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL HAVING sum(l_quantity) FILTER (WHERE l_linestatus = 'F') IS DISTINCT FROM o_custkey""")
def check_plays_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's scoring plays against the final score, each for itself; no plays is not the same as the score."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    n = tasks(lines)
    joined = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    sums = joined.groupBy(F.col("l_orderkey").alias("game"), F.col("l_returnflag").alias("source"), F.col("o_custkey").alias("final")).agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).cast("long").alias("summed"))
    return sums.filter(~F.col("summed").eqNullSafe(F.col("final"))).select("game", "source", "summed", "final")


@query("""WITH t AS (SELECT s_suppkey AS team FROM supplier), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS season FROM orders), h AS (SELECT o_custkey % 110 AS team, CAST(year(o_orderdate) AS INT) AS season, count(*) AS played FROM orders GROUP BY ALL)
SELECT team, season, coalesce(played, 0) AS played FROM t CROSS JOIN y LEFT JOIN h USING (team, season) WHERE coalesce(played, 0) < 5""")
def check_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Teams with fewer games in a season than a schedule has, those without any among them."""
    orders = table(spark, folder, "orders").select((F.col("o_custkey") % 110).alias("team"), F.year("o_orderdate").alias("season"))
    seasons = F.array_sort(F.collect_set("season")).alias("seasons")  # a handful
    every = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("team")).join(F.broadcast(orders.agg(seasons))).select("team", F.explode("seasons").alias("season"))
    have = orders.groupBy("team", "season").agg(F.count("*").alias("played"))
    return every.join(have, ["team", "season"], "left").withColumn("played", F.coalesce("played", F.lit(0)).cast("long")).filter("played < 5")


@query("""WITH z AS (SELECT l_suppkey AS player, l_linenumber AS zone, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT player, zone, n / sum(n) OVER (PARTITION BY player) AS share FROM z), g AS (SELECT l_linenumber AS zone, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1)
SELECT player, zone, round(s.share - g.share, 6) AS edge FROM s JOIN g USING (zone) ORDER BY round(abs(s.share - g.share), 9) DESC, player, zone LIMIT 15""")
def zone_edge_leaders(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen largest departures from how the league's shots are spread."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("player"), F.col("l_linenumber").alias("zone"))
    league = lines.groupBy("zone").agg(F.count("*").alias("all")).withColumn("base", F.col("all") / F.sum("all").over(Window.partitionBy(F.lit(0))))
    own = lines.groupBy("player", "zone").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("player")))
    edges = own.join(league, "zone").select("player", "zone", (F.col("share") - F.col("base")).alias("edge"))
    return rounded(edges.orderBy(F.desc(F.round(F.abs("edge"), 9)), "player", "zone").limit(15), 6)


@query(f"""WITH o AS (SELECT l_partkey AS player, l_suppkey AS team, l_orderkey AS game, l_quantity AS points, l_returnflag AS source, l_linenumber FROM lineitem WHERE l_linestatus = 'F' QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_suppkey) = 1)
SELECT p_partkey AS player, count(game) AS games, round(avg(points), 6) AS points, arg_max(team, game) AS team, contains(lower(p_name), 'a') AS found, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) AS has_props FROM part LEFT JOIN o ON player = p_partkey GROUP BY p_partkey, p_name""")
def player_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Every player with games from the best source, newest team, a search flag and whether there are props."""
    lines = table(spark, folder, "lineitem")
    stats = lines.filter("l_linestatus = 'F'").select(F.col("l_partkey").alias("player"), F.col("l_suppkey").alias("team"), F.col("l_orderkey").alias("game"), F.col("l_quantity").alias("points"), F.col("l_returnflag").alias("source"), "l_linenumber")
    one = rel.by_precedence(stats, ["player", "game"], "source", ["R", "A"], F.col("l_linenumber"), F.col("team"))
    sums = one.groupBy("player").agg(F.count("*").alias("games"), F.avg("points").alias("points"), F.max_by("team", "game").alias("team"))
    props = lines.filter("l_discount > 0.09").select(F.col("l_partkey").alias("player")).distinct().withColumn("has_props", F.lit(True))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("player"), F.lower("p_name").contains("a").alias("found"))
    out = parts.join(sums, "player", "left").join(props, "player", "left")
    return rounded(out.select("player", F.coalesce("games", F.lit(0)).cast("long").alias("games"), "points", "team", "found", F.coalesce("has_props", F.lit(False)).alias("has_props")), 6)
