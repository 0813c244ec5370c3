"""The named strategies on the driver's tables, and the guard's verdicts.

An order with lines of two suppliers is a game of its first against its last line's; events are player games.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import history as h
from tidemark.operators import plays
from tidemark.operators import relational as rel
from tidemark.plans import pipeline as p
from tidemark.plans import strategies as s
from tidemark.queries.catalog import game_log, query, rounded, table, tasks

CONTEXT = p.Context(datetime(2024, 6, 1, tzinfo=timezone.utc))


#: Ten dimensions out of a game's lines.
WIDE = {
    "price": "{0}.l_extendedprice / 1000", "discount": "{0}.l_discount", "tax": "{0}.l_tax", "quantity": "{0}.l_quantity", "line": "{0}.l_linenumber", "part": "{0}.l_partkey % 97",
    "unit": "{0}.l_extendedprice / {0}.l_quantity", "saved": "{0}.l_extendedprice * {0}.l_discount / 1000", "taxed": "{0}.l_extendedprice * {0}.l_tax / 1000", "maker": "{0}.l_partkey % 7",
}


def tables(spark: SparkSession, folder: str, wide: bool = False) -> s.Tables:
    def team_games(context: p.Context) -> DataFrame:
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        ends = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min(line).alias("a"), F.max(line).alias("b")).filter("a.l_suppkey <> b.l_suppkey")
        orders = table(spark, folder, "orders").filter(F.col("o_orderdate") <= F.lit(context.as_of.replace(tzinfo=None).isoformat()).cast("timestamp_ntz"))
        games = ends.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.when(F.col("o_orderstatus") == "F", "regular-season").when(F.col("o_orderstatus") == "O", "post-season").otherwise("preseason").alias("season_type"),
            F.col("o_orderdate").cast("timestamp").alias("start_time"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 3 hours")).alias("result_known_at"), "a", "b", F.lit(True).alias("yes"), F.lit(False).alias("no"),
        )

        def side(own: str, other: str, home: str) -> dict[str, str]:
            if wide:
                return {"team_id": f"{own}.l_suppkey", "opponent_team_id": f"{other}.l_suppkey", "is_home": home, "points_scored": f"{own}.l_quantity", "points_allowed": f"{other}.l_quantity", **{k: f"{own}_{k}" for k in WIDE}}
            return {"team_id": f"{own}.l_suppkey", "opponent_team_id": f"{other}.l_suppkey", "is_home": home, "points_scored": f"{own}.l_quantity", "points_allowed": f"{other}.l_quantity", "price": f"{own}.l_extendedprice", "tempo": f"{own}.l_discount", "spread": f"{own}.l_tax"}

        if wide:
            games = games.withColumns({f"{x}_{k}": F.expr(v.format(x)).cast("double") for x in "ab" for k, v in WIDE.items()})
        both = rel.sides(games, {"home": side("a", "b", "yes"), "away": side("b", "a", "no")})
        shown = ["game_id", "team_id", "opponent_team_id", "season", "season_type", "start_time", "result_known_at", (F.col("team_id") % 10 != 9).alias("is_franchise"), "is_home", "points_scored", "points_allowed"]
        return both.select(*shown, *WIDE) if wide else both.select(*shown, (F.col("price") / 1000).alias("pace"), "tempo", "spread")

    def player_games(context: p.Context) -> DataFrame:
        log = game_log(spark, folder)
        known = (F.col("ts").cast("timestamp") + F.expr("interval 3 hours")).alias("result_known_at")
        shots, boards, e = F.floor(F.col("value") / 5), F.col("event_id") % 9, F.col("event_id")
        mixed = [shots.alias("attempts"), F.least(shots, e % 6).alias("long_attempts"), (e % 4).alias("free_attempts"), boards.alias("rebounds"), F.least(boards, e % 4).alias("offensive_rebounds"), F.when(e % 13 != 0, F.col("value") / 100).alias("usage")]
        return log.select(*(mixed if wide else ()), F.col("event_id").alias("game_id"), F.col("user_id").alias("player_id"), (F.col("user_id") % 10).alias("team_id"), "season", F.lit("regular-season").alias("season_type"), F.col("ts").cast("timestamp").alias("start_time"), known, F.col("k").alias("minutes"), F.col("value").alias("points"), (F.col("event_type") == "click").alias("starter"))

    def quotes() -> DataFrame:
        return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("vendor"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_discount").alias("price"), F.col("l_extendedprice").alias("tie"))

    def props() -> DataFrame:
        return table(spark, folder, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("player_id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("line"), F.col("event_id").alias("tie"))

    def bios() -> DataFrame:
        return table(spark, folder, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_mktsegment").alias("position"), F.col("c_nationkey").alias("age"))

    def shaped() -> DataFrame:
        """Lines of a game's two teams as plays: points by quantity, up to five periods, a clock."""
        ends = team_games(CONTEXT).filter("is_home").select("game_id", F.col("team_id").alias("home_id"), F.col("opponent_team_id").alias("away_id"))
        lines = table(spark, folder, "lineitem").join(ends, F.col("l_orderkey") == F.col("game_id")).filter(F.col("l_suppkey").isin(F.col("home_id"), F.col("away_id")))
        w = Window.partitionBy("game_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
        by = {n: F.sum(F.when(F.col("l_suppkey") == F.col(f"{n}_id"), F.col("l_quantity")).otherwise(0)).over(w) for n in ("home", "away")}
        rows = lines.withColumns({**by, "sequence": F.row_number().over(w), "period": F.least("l_linenumber", F.lit(5)), "clock": F.format_string("%d:%02d", (F.col("l_partkey") % 10).cast("int"), (F.col("l_partkey") % 60).cast("int"))})
        return plays.play_aggregate(rows.withColumnRenamed("l_suppkey", "team_id"), "game_id", "team_id", "sequence", "period", "clock", "l_quantity", "home", "away")

    def standings() -> DataFrame:
        o = table(spark, folder, "orders")
        return o.select((F.col("o_custkey") % 100).alias("team_id"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").cast("timestamp").alias("at"), F.floor(F.col("o_totalprice") / 10_000).alias("wins"), (F.col("o_custkey") % 7).alias("losses"), F.col("o_orderkey").alias("tie"))

    return s.Tables(team_games, player_games, quotes, lambda: quotes().drop("vendor"), props, bios, shaped, standings, tuple(WIDE) if wide else s.STYLE, wide, tasks(table(spark, folder, "lineitem")))


def _run(spark: SparkSession, folder: str, name: str, wide: bool = False) -> DataFrame:
    return s.build(name, tables(spark, folder, wide)).run(CONTEXT).df


_TEAM = """WITH e AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS a, max((l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS b FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS game_id, o_orderdate AS start_time, year(o_orderdate) AS season, a[3] AS ta, b[3] AS tb, a[5] AS qa, b[5] AS qb FROM e JOIN orders ON l_orderkey = o_orderkey WHERE a[3] <> b[3]),
t AS (SELECT game_id, start_time, season, ta AS team_id, tb AS opponent_team_id, 'home' AS venue, qa - qb AS margin FROM g UNION ALL SELECT game_id, start_time, season, tb, ta, 'away', qb - qa FROM g),
f AS (SELECT * FROM t WHERE team_id % 10 <> 9),
r AS (SELECT *, epoch_us(start_time) - epoch_us(max(start_time) OVER w) AS gap, count(*) OVER w AS earlier, row_number() OVER (PARTITION BY team_id ORDER BY start_time, game_id) AS n FROM f WINDOW w AS (PARTITION BY team_id ORDER BY start_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
"""


@query(f"""{_TEAM} SELECT game_id, team_id, opponent_team_id, CAST(season AS INT) AS season, venue, margin, margin > 0 AS won, round(gap / 86400000000.0, 9) AS rest_days, coalesce(gap < 36 * 3600000000, false) AS is_back_to_back FROM r""")
def situational_baseline(spark: SparkSession, folder: str) -> DataFrame:
    df = _run(spark, folder, "situational_baseline")
    return rounded(df.select("game_id", "team_id", "opponent_team_id", "season", "venue", "margin", "won", "rest_days", "is_back_to_back"), 9)


@query(f"""{_TEAM}, m AS (SELECT r.game_id, r.team_id, r.opponent_team_id, count(x.n) AS form5_rows, avg(x.margin) AS form FROM r LEFT JOIN r x ON x.team_id = r.team_id AND x.n <= r.earlier AND x.n > r.earlier - 5 GROUP BY ALL)
SELECT m.game_id, m.team_id, m.form5_rows, round(m.form, 9) AS margin_form5, round(o.form, 9) AS opponent_margin_form5 FROM m LEFT JOIN m o ON o.game_id = m.game_id AND o.team_id = m.opponent_team_id""")
def team_form(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run(spark, folder, "team_form").select("game_id", "team_id", "form5_rows", "margin_form5", "opponent_margin_form5"), 9)


_PLAYER = """WITH l AS (SELECT event_id AS game_id, user_id AS player_id, value AS points, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS minutes, ts, event_id FROM events),
f AS (SELECT *, avg(points) OVER w AS points_form5, avg(minutes) OVER w AS minutes_form5 FROM l WINDOW w AS (PARTITION BY player_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
"""


@query(f"""{_PLAYER} SELECT game_id, player_id, round(points_form5, 9) AS points_form5, round(minutes_form5, 9) AS minutes_form5, coalesce(c_mktsegment = 'BUILDING', false) AS position_is_BUILDING, c_nationkey AS age FROM f LEFT JOIN customer ON c_custkey = player_id WHERE minutes_form5 >= 10""")
def player_form(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run(spark, folder, "player_form").select("game_id", "player_id", "points_form5", "minutes_form5", "position_is_BUILDING", "age"), 9)


@query(f"""{_PLAYER}, q AS (SELECT user_id AS player_id, ts AS seen_at, value AS line FROM events WHERE event_type = 'purchase'), k AS (SELECT * FROM f WHERE minutes_form5 >= 10)
SELECT k.game_id, k.player_id, q.line, round(q.line - k.points_form5, 9) AS line_edge FROM k ASOF LEFT JOIN q ON k.player_id = q.player_id AND k.ts > q.seen_at""")
def player_market(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run(spark, folder, "player_market").select("game_id", "player_id", "line", "line_edge"), 9)


_GAMES = """WITH e AS (SELECT l_orderkey, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS a, max((l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax)) AS b FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS game_id, o_orderdate AS start_time, CAST(year(o_orderdate) AS INT) AS season, a, b FROM e JOIN orders ON l_orderkey = o_orderkey WHERE a[3] <> b[3]),
t AS (SELECT game_id, start_time, season, a[3] AS team_id, b[3] AS opponent_team_id, true AS is_home, a[5] AS ps, b[5] AS pa, a[4] / 1000 AS pace, a[6] AS tempo, a[7] AS spread FROM g UNION ALL SELECT game_id, start_time, season, b[3], a[3], false, b[5], a[5], b[4] / 1000, b[6], b[7] FROM g),
f AS (SELECT *, ps - pa AS margin, ps > pa AS won FROM t WHERE team_id % 10 <> 9),
r AS (SELECT *, (epoch_us(start_time) - epoch_us(max(start_time) OVER w)) / 86400000000.0 AS rest_days, count(*) OVER w AS earlier, row_number() OVER (PARTITION BY team_id ORDER BY start_time, game_id) AS n FROM f WINDOW w AS (PARTITION BY team_id ORDER BY start_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
"""


def _last(name: str, k: int, source: str = "r", **made: str) -> str:
    """A table of aggregates over a team's last k rows (x) before each row."""
    cells = ", ".join(f"{e} AS {c}" for c, e in made.items())
    return f", {name} AS (SELECT r.game_id, r.team_id, {cells} FROM {source} r LEFT JOIN {source} x ON x.team_id = r.team_id AND x.n <= r.earlier AND x.n > r.earlier - {k} GROUP BY ALL)"


def _split(name: str, where: str) -> str:
    return f""", {name}_i AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY start_time, game_id) AS i FROM r WHERE {where}),
{name}_u AS (SELECT r.game_id, r.team_id, max(x.i) AS upto FROM r LEFT JOIN {name}_i x ON x.team_id = r.team_id AND x.start_time < r.start_time GROUP BY ALL),
{name} AS (SELECT u.game_id, u.team_id, avg(x.margin) AS {name} FROM {name}_u u LEFT JOIN {name}_i x ON x.team_id = u.team_id AND x.i <= u.upto AND x.i > u.upto - 10 GROUP BY ALL)"""


def _chosen(spark: SparkSession, folder: str, name: str, *columns: str, digits: int = 6) -> DataFrame:
    return rounded(_run(spark, folder, name).select("game_id", "team_id", *columns), digits)


_MULTI = ("margin_form10", "margin_form20", "margin_season_mean", "margin_ewm5", "margin_sd10", "margin_slope10", "margin_home10", "margin_road10", "blowout_win_profile10", "close_game_profile10")


@query(
    _GAMES
    + _last("w10", 10, margin_form10="avg(x.margin)", margin_sd10="stddev_samp(x.margin)", margin_slope10="CASE WHEN count(x.n) >= 2 THEN regr_slope(x.margin, x.n) END", blowout_win_profile10="avg((x.margin >= 15)::INT)", close_game_profile10="avg((abs(x.margin) <= 5)::INT)")
    + _last("w20", 20, margin_form20="avg(x.margin)")
    + _last("w100", 100, margin_ewm5="sum(x.margin * pow(0.5, (r.earlier - x.n) / 5.0)) / sum(pow(0.5, (r.earlier - x.n) / 5.0))")
    + _split("margin_home10", "is_home")
    + _split("margin_road10", "NOT is_home")
    + f""", s AS (SELECT r.game_id, r.team_id, avg(x.margin) AS margin_season_mean FROM r LEFT JOIN r x ON x.team_id = r.team_id AND x.season = r.season AND x.start_time < r.start_time GROUP BY ALL),
k1 AS (SELECT *, CASE WHEN won = lag(won) OVER (PARTITION BY team_id, season ORDER BY start_time, game_id) THEN 0 ELSE 1 END AS new FROM r),
k2 AS (SELECT *, sum(new) OVER (PARTITION BY team_id, season ORDER BY start_time, game_id) AS run FROM k1),
k3 AS (SELECT *, row_number() OVER (PARTITION BY team_id, season, run ORDER BY start_time, game_id) * CASE WHEN won THEN 1 ELSE -1 END AS s FROM k2),
k4 AS (SELECT * FROM k3 QUALIFY row_number() OVER (PARTITION BY team_id, season, start_time ORDER BY game_id DESC) = 1),
k AS (SELECT r.game_id, r.team_id, CAST(coalesce(k4.s, 0) AS BIGINT) AS streak FROM r ASOF LEFT JOIN k4 ON r.team_id = k4.team_id AND r.season = k4.season AND r.start_time > k4.start_time)
SELECT game_id, team_id, streak, {", ".join(f"round({c}, 6) AS {c}" for c in _MULTI)}
FROM w10 JOIN w20 USING (game_id, team_id) JOIN w100 USING (game_id, team_id) JOIN margin_home10 USING (game_id, team_id) JOIN margin_road10 USING (game_id, team_id) JOIN s USING (game_id, team_id) JOIN k USING (game_id, team_id)"""
)
def team_form_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, "team_form_multi", "streak", *_MULTI)


def _met(name: str, season: str = "") -> str:
    return f""", {name} AS (SELECT r.game_id, r.team_id, count(x.n) AS {name}_games, count(x.n) FILTER (WHERE x.won) AS {name}_wins, CASE WHEN count(x.n) > 0 THEN count(x.n) FILTER (WHERE x.won) / count(x.n) END AS {name}_pct, avg(x.margin) AS {name}_margin
FROM r LEFT JOIN r x ON x.team_id = r.team_id AND x.opponent_team_id = r.opponent_team_id AND x.start_time < r.start_time{season} GROUP BY ALL)"""


@query(
    _GAMES + _last("p", 5, pace5="avg(x.pace)") + _met("h2h_all") + _met("h2h_season", " AND x.season = r.season")
    + """, z AS (SELECT r.*, pace5, coalesce(rest_days < 1.5, false)::INT AS b2b FROM r JOIN p USING (game_id, team_id))
SELECT z.game_id, z.team_id, round(z.rest_days - o.rest_days, 8) AS rest_advantage, o.b2b - z.b2b AS back_to_back_edge, round((z.pace5 + o.pace5) / 2, 8) AS pace_mean, round(abs(z.pace5 - o.pace5), 8) AS pace_gap,
  h2h_all_games, h2h_all_wins, round(h2h_all_pct, 8) AS h2h_all_pct, round(h2h_all_margin, 8) AS h2h_all_margin, h2h_season_games, round(h2h_season_margin, 8) AS h2h_season_margin
FROM z LEFT JOIN z o ON o.game_id = z.game_id AND o.team_id = z.opponent_team_id JOIN h2h_all a ON a.game_id = z.game_id AND a.team_id = z.team_id JOIN h2h_season s ON s.game_id = z.game_id AND s.team_id = z.team_id"""
)
def team_matchup(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, "team_matchup", "rest_advantage", "back_to_back_edge", "pace_mean", "pace_gap", "h2h_all_games", "h2h_all_wins", "h2h_all_pct", "h2h_all_margin", "h2h_season_games", "h2h_season_margin", digits=8)


_DIMENSIONS = ("pace", "tempo", "spread")


@query(
    _GAMES + _last("a", 5, **{f"{v}5": f"avg(x.{v})" for v in _DIMENSIONS}) + _last("b", 15, **{f"{v}15": f"avg(x.{v})" for v in _DIMENSIONS})
    + f""", z AS (SELECT r.game_id, r.team_id, r.opponent_team_id, {", ".join(f"{v}5, {v}15" for v in _DIMENSIONS)} FROM r JOIN a USING (game_id, team_id) JOIN b USING (game_id, team_id)),
d AS (SELECT {", ".join(f"CASE WHEN stddev_samp({v}5) > 0 THEN stddev_samp({v}5) ELSE 1 END AS {v}_d" for v in _DIMENSIONS)} FROM z)
SELECT z.game_id, z.team_id, {", ".join(f"round(z.{v}5, 8) AS {v}_style5, round(o.{v}5, 8) AS opponent_{v}_style5" for v in _DIMENSIONS)},
  CASE WHEN z.pace5 IS NOT NULL AND o.pace5 IS NOT NULL THEN round(sqrt({" + ".join(f"pow((z.{v}5 - o.{v}5) / {v}_d, 2)" for v in _DIMENSIONS)}), 8) END AS style_distance, round(sqrt(({" + ".join(f"pow(z.{v}5 - z.{v}15, 2)" for v in _DIMENSIONS)}) / 3), 8) AS style_volatility
FROM z LEFT JOIN z o ON o.game_id = z.game_id AND o.team_id = z.opponent_team_id CROSS JOIN d"""
)
def team_style(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, "team_style", *[f"{o}{v}_style5" for v in _DIMENSIONS for o in ("", "opponent_")], "style_distance", "style_volatility", digits=8)


@query(
    _GAMES + """, q AS (SELECT l_orderkey AS game_id, l_suppkey AS vendor, l_shipdate AS seen_at, l_discount AS price, l_extendedprice AS tie FROM lineitem),
b AS (SELECT f.game_id, f.team_id, q.* EXCLUDE (game_id) FROM f JOIN q ON q.game_id = f.game_id AND q.seen_at < f.start_time),
v AS (SELECT game_id, team_id, vendor, arg_max(price, (seen_at, tie)) AS price FROM b GROUP BY ALL), c AS (SELECT game_id, team_id, avg(price) AS consensus, stddev_samp(price) AS spread_, count(*) AS vendors FROM v GROUP BY ALL),
p AS (SELECT game_id, team_id, arg_max(price, (seen_at, tie)) AS prediction FROM b GROUP BY ALL)
SELECT f.game_id, f.team_id, round(consensus, 6) AS book_consensus, round(spread_, 6) AS book_spread, vendors AS book_vendors, round(prediction, 6) AS prediction, round(prediction - consensus, 6) AS divergence, round(prediction - consensus + spread_, 6) AS movement
FROM f LEFT JOIN c USING (game_id, team_id) LEFT JOIN p USING (game_id, team_id)"""
)
def team_market(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, "team_market", "book_consensus", "book_spread", "book_vendors", "prediction", "divergence", "movement")


_SHAPES = ("period_1_share", "second_half_share", "clutch_share", "run_per_lead", "went_to_overtime", "lead_changes_per_100")


@query(
    _GAMES + f""", l AS (SELECT g.game_id, l_suppkey AS team, least(l_linenumber, 5) AS period, l_quantity AS x, CASE WHEN l_suppkey = a[3] THEN l_quantity ELSE -l_quantity END AS d, (l_partkey % 10) * 60 + l_partkey % 60 AS left_, row_number() OVER w AS i FROM lineitem JOIN g ON l_orderkey = g.game_id WHERE l_suppkey IN (a[3], b[3]) WINDOW w AS (PARTITION BY g.game_id ORDER BY l_linenumber, l_partkey, l_extendedprice)),
m AS (SELECT *, sum(d) OVER (PARTITION BY game_id ORDER BY i) AS margin, i - row_number() OVER (PARTITION BY game_id, team ORDER BY i) AS island FROM l), n AS (SELECT *, lag(margin) OVER (PARTITION BY game_id ORDER BY i) AS before FROM m),
gs AS (SELECT game_id, count(*) FILTER (WHERE margin * before < 0) AS changes, max(abs(margin)) AS lead_ FROM n GROUP BY 1), rn AS (SELECT game_id, team, max(s) AS run FROM (SELECT game_id, team, sum(x) AS s FROM m GROUP BY game_id, team, island) GROUP BY ALL),
pp AS (SELECT game_id, team AS team_id, {", ".join(f"sum(x) FILTER (WHERE period = {i}) AS p{i}" for i in (1, 2, 3, 4))}, coalesce(sum(x) FILTER (WHERE period >= 5), 0) AS ot, sum(x) FILTER (WHERE period >= 4 AND left_ <= 300) AS clutch, any_value(run) AS run, any_value(changes) AS changes, any_value(lead_) AS lead_ FROM l JOIN rn USING (game_id, team) JOIN gs USING (game_id) GROUP BY ALL),
z AS (SELECT r.*, CASE WHEN p1 + p2 + p3 + p4 > 0 THEN p1 / (p1 + p2 + p3 + p4) END AS period_1_share, CASE WHEN p1 + p2 + p3 + p4 > 0 THEN (p3 + p4) / (p1 + p2 + p3 + p4) END AS second_half_share, CASE WHEN p1 + p2 + p3 + p4 > 0 THEN clutch / (p1 + p2 + p3 + p4) END AS clutch_share,
  CASE WHEN lead_ > 0 THEN run / lead_ END AS run_per_lead, (coalesce(ot, 0) > 0)::INT::DOUBLE AS went_to_overtime, CASE WHEN ps + pa > 0 THEN 100.0 * changes / (ps + pa) END AS lead_changes_per_100 FROM r LEFT JOIN pp USING (game_id, team_id))
""" + _last("w", 10, "z", **{f"{c}_shape10": f"avg(x.{c})" for c in _SHAPES}, run_per_lead_sd10="stddev_samp(x.run_per_lead)")
    + f""" SELECT game_id, team_id, {", ".join(f"round({c}_shape10, 6) AS {c}_shape10" for c in _SHAPES)}, round(run_per_lead_sd10, 6) AS run_per_lead_sd10 FROM w"""
)
def team_play_shape(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, "team_play_shape", *[f"{c}_shape10" for c in _SHAPES], "run_per_lead_sd10")


@query(
    _GAMES + """, s AS (SELECT o_custkey % 100 AS team_id, CAST(year(o_orderdate) AS INT) AS season, o_orderdate AS seen_at, floor(o_totalprice / 10000) AS wins, o_custkey % 7 AS losses FROM orders QUALIFY row_number() OVER (PARTITION BY team_id, season, o_orderdate ORDER BY o_orderkey DESC) = 1)
SELECT f.game_id, f.team_id, CAST(s.wins AS BIGINT) AS standings_wins, s.losses AS standings_losses, CASE WHEN s.wins + s.losses > 0 THEN round(s.wins / (s.wins + s.losses), 6) END AS standings_pct FROM f ASOF LEFT JOIN s ON f.team_id = s.team_id AND f.season = s.season AND f.start_time > s.seen_at"""
)
def team_standings(spark: SparkSession, folder: str) -> DataFrame:
    """The situational strategy with standings as they were known."""
    own = tables(spark, folder)
    return rounded(s.with_standings(s.build("situational_baseline", own), own).run(CONTEXT).df.select("game_id", "team_id", "standings_wins", "standings_losses", "standings_pct"), 6)


@query(f"""{_PLAYER.split("f AS (")[0].rstrip().rstrip(",")}, r AS (SELECT l.*, event_type = 'click' AS starter FROM l JOIN events USING (event_id)),
w AS (SELECT game_id, player_id, minutes, 36 * sum(points) FILTER (WHERE minutes IS NOT NULL) OVER o / nullif(sum(minutes) OVER o, 0) AS per36, sum(CASE WHEN minutes > 0 THEN minutes * points END) OVER o / nullif(sum(CASE WHEN minutes > 0 THEN minutes END) OVER o, 0) AS weighted, sum(minutes) OVER o / nullif(sum(minutes) OVER o, 0) AS share, avg(starter::INT) OVER o AS starts
  FROM r WINDOW o AS (PARTITION BY player_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT game_id, player_id, round(per36, 9) AS points_per_36, per36 IS NULL AS points_per_36_is_null, round(weighted, 9) AS points_weighted, round(share, 9) AS minutes_share, round(starts, 9) AS started_starts10 FROM w WHERE minutes >= 5""")
def player_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_run(spark, folder, "player_rates").select("game_id", "player_id", "points_per_36", "points_per_36_is_null", "points_weighted", "minutes_share", "started_starts10"), 9)


_WIDE = {k: v.format("l") for k, v in WIDE.items()}


@query(
    """WITH l AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k, lineitem AS l FROM lineitem), e AS (SELECT l_orderkey, arg_min(l, k) AS a, arg_max(l, k) AS b FROM l GROUP BY 1),
g AS (SELECT o_orderkey AS game_id, o_orderdate AS start_time, a, b FROM e JOIN orders ON e.l_orderkey = o_orderkey WHERE a.l_suppkey <> b.l_suppkey),
t AS (SELECT game_id, start_time, a.l_suppkey AS team_id, b.l_suppkey AS opponent_team_id, a AS l FROM g UNION ALL SELECT game_id, start_time, b.l_suppkey, a.l_suppkey, b FROM g),
"""
    + f"""f AS (SELECT game_id, start_time, team_id, opponent_team_id, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _WIDE.items())} FROM t WHERE team_id % 10 <> 9),
r AS (SELECT *, count(*) OVER w AS earlier, row_number() OVER (PARTITION BY team_id ORDER BY start_time, game_id) AS n FROM f WINDOW w AS (PARTITION BY team_id ORDER BY start_time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""
    + _last("a5", 5, **{f"{v}5": f"avg(x.{v})" for v in WIDE}) + _last("a15", 15, **{f"{v}15": f"avg(x.{v})" for v in WIDE})
    + f""", z AS (SELECT r.game_id, r.team_id, r.opponent_team_id, {", ".join(f"{v}5, {v}15" for v in WIDE)} FROM r JOIN a5 USING (game_id, team_id) JOIN a15 USING (game_id, team_id)),
d AS (SELECT {", ".join(f"CASE WHEN stddev_samp({v}5) > 0 THEN stddev_samp({v}5) ELSE 1 END AS {v}_d" for v in WIDE)} FROM z)
SELECT z.game_id, z.team_id, {", ".join(f"round(z.{v}5 - o.{v}5, 9) AS {v}_gap" for v in WIDE)}, CASE WHEN z.price5 IS NOT NULL AND o.price5 IS NOT NULL THEN round(sqrt({" + ".join(f"pow((z.{v}5 - o.{v}5) / {v}_d, 2)" for v in WIDE)}), 9) END AS style_distance,
  round(sqrt(({" + ".join(f"pow(z.{v}5 - z.{v}15, 2)" for v in WIDE)}) / 10), 9) AS style_volatility
FROM z LEFT JOIN z o ON o.game_id = z.game_id AND o.team_id = z.opponent_team_id CROSS JOIN d"""
)
def team_style_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Style in ten dimensions: the gaps of both teams' vectors, their distance, and how settled a team is."""
    out = _run(spark, folder, "team_style", wide=True)
    return rounded(out.select("game_id", "team_id", *[f"{v}_gap" for v in WIDE], "style_distance", "style_volatility"), 9)


@query("""WITH l AS (SELECT event_id AS game_id, user_id AS player_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS minutes, floor(value / 5) AS shots, event_id % 9 AS boards, CASE WHEN event_id % 13 <> 0 THEN value / 100 END AS usage FROM events),
w AS (SELECT game_id, player_id, minutes, usage IS NULL AS usage_is_null, sum(least(shots, event_id % 6)) OVER o / nullif(sum(shots) OVER o, 0) AS long_share, sum(event_id % 4) OVER o / nullif(sum(shots) OVER o, 0) AS free_share, sum(least(boards, event_id % 4)) OVER o / nullif(sum(boards) OVER o, 0) AS offensive,
  sum(CASE WHEN minutes > 0 THEN minutes * usage END) OVER o / nullif(sum(CASE WHEN minutes > 0 AND usage IS NOT NULL THEN minutes END) OVER o, 0) AS usage_w FROM l WINDOW o AS (PARTITION BY player_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT game_id, player_id, round(long_share, 9) AS long_attempts_share, round(free_share, 9) AS free_attempts_share, round(offensive, 9) AS offensive_rebounds_share, round(usage_w, 9) AS usage_weighted, usage_is_null FROM w WHERE minutes >= 5""")
def player_mix(spark: SparkSession, folder: str) -> DataFrame:
    """What players' shots and rebounds are made of over their last ten games, and their usage."""
    out = _run(spark, folder, "player_rates", wide=True)
    return rounded(out.select("game_id", "player_id", "long_attempts_share", "free_attempts_share", "offensive_rebounds_share", "usage_weighted", "usage_is_null"), 9)


@query("""SELECT 'clean' AS frame, CAST(0 AS BIGINT) AS late, CAST(0 AS BIGINT) AS open UNION ALL SELECT 'planted', count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20'), count(*) FILTER (WHERE event_type = 'error') FROM events""")
def guard_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows break the guard's rules: on a sound frame, and on one with planted leaks."""
    log = game_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seen", F.col("ts"))
    sound = h.rolling(log, h.History(("user_id",), "ts", "event_id"), ["value"], 5)
    leaky = sound.withColumn("roll_window_end", F.when(F.col("event_type") == "error", F.col("ts")).otherwise(F.col("roll_window_end")))
    out = []
    for name, df, at in (("clean", sound, datetime(2024, 6, 1, tzinfo=timezone.utc)), ("planted", leaky, datetime(2024, 1, 20, tzinfo=timezone.utc))):
        found = p.violations(p.Frame(df, "ts", ("seen",), ("roll_window_end",)), p.Context(at))
        out.append(found.select(F.lit(name).alias("frame"), F.col("late__seen").alias("late"), F.col("open__roll_window_end").alias("open")))
    return out[0].unionByName(out[1])
