"""Histories that end strictly before the row, running series, runs and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import history as h
from tidemark.operators import relational as rel
from tidemark.queries.catalog import LOG, game_log, long, query, rounded, table

BY_USER = h.History(("user_id",), "ts", "event_id")
LAST5 = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
LAST10 = LAST5.replace("5 PRECEDING", "10 PRECEDING")
PAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SEASON = PAST.replace("user_id ORDER", "user_id, season ORDER")


@query(f"""{LOG} SELECT event_id, round(avg(value) {LAST5}, 6) AS value_roll, round(avg(k) {LAST5}, 6) AS k_roll, count(*) {LAST5} AS roll_rows, max(ts) {LAST5} AS roll_window_end FROM log""")
def rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.rolling(game_log(spark, folder), BY_USER, ["value", "k"], 5).select("event_id", "value_roll", "k_roll", "roll_rows", "roll_window_end"))


@query(f"""{LOG} SELECT event_id, round(avg(value) {SEASON}, 9) AS value_mean, count(*) {SEASON} AS mean_rows, max(ts) {SEASON} AS mean_window_end FROM log""")
def expanding_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.expanding(game_log(spark, folder), BY_USER, ["value"], "season").select("event_id", "value_mean", "mean_rows", "mean_window_end"), 9)


@query(f"""{LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM log)
SELECT a.event_id, round(sum(b.value * pow(0.5, (a.i - b.i - 1) / 5.0)) / sum(pow(0.5, (a.i - b.i - 1) / 5.0)), 6) AS value_ewm, count(b.i) AS ewm_rows
FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.i < a.i AND b.i >= a.i - 100 GROUP BY a.event_id""")
def exponential_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.exponential(game_log(spark, folder), BY_USER, "value", 5.0).select("event_id", "value_ewm", "ewm_rows"))


@query(f"""{LOG} SELECT event_id, round(stddev_samp(value) {LAST10}, 6) AS value_sd FROM log""")
def rolling_dispersion(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.dispersion(game_log(spark, folder), BY_USER, "value", 10).select("event_id", "value_sd"))


@query(f"""{LOG}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS i FROM log)
SELECT event_id, CASE WHEN count(value) {LAST10} >= 2 THEN round(regr_slope(value, i) {LAST10}, 6) END AS value_slope FROM n""")
def rolling_slope(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.slope(game_log(spark, folder), BY_USER, "value", 10).select("event_id", "value_slope"))


@query(f"""{LOG}, c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM log WHERE event_type = 'click'),
j AS (SELECT l.event_id, max(c.i) AS upto FROM log l LEFT JOIN c ON c.user_id = l.user_id AND c.ts < l.ts GROUP BY ALL)
SELECT l.event_id, round(avg(c.value), 6) AS value_split, count(c.value) AS split_rows
FROM log l JOIN j USING (event_id) LEFT JOIN c ON c.user_id = l.user_id AND c.i <= j.upto AND c.i > j.upto - 10 GROUP BY l.event_id""")
def split_rolling_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.split_rolling(game_log(spark, folder), BY_USER, "value", F.col("event_type") == "click", 10).select("event_id", "value_split", "split_rows"))


@query(f"""{LOG}, a AS (SELECT *, CASE WHEN won = lag(won) OVER w THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY user_id, season ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id, season ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, season, run ORDER BY ts, event_id) * CASE WHEN won THEN 1 ELSE -1 END AS s FROM b)
SELECT event_id, CAST(coalesce(lag(s) OVER (PARTITION BY user_id, season ORDER BY ts, event_id), 0) AS BIGINT) AS streak FROM c""")
def signed_streak(spark: SparkSession, folder: str) -> DataFrame:
    return h.streak(game_log(spark, folder), BY_USER, F.col("won"), "season").select("event_id", "streak")


@query(f"""{LOG}, a AS (SELECT event_id, count(*) {SEASON} AS prior_games, CAST(coalesce(sum(CAST(won AS INT)) {SEASON}, 0) AS BIGINT) AS prior_wins FROM log)
SELECT *, CASE WHEN prior_games > 0 THEN round(prior_wins / prior_games, 6) END AS prior_pct FROM a""")
def season_to_date(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.season_to_date(game_log(spark, folder), BY_USER, F.col("won"), "season").select("event_id", "prior_games", long("prior_wins").alias("prior_wins"), "prior_pct"))


@query(f"""{LOG}, a AS (SELECT event_id, epoch_us(ts) - epoch_us(max(ts) {PAST}) AS gap FROM log)
SELECT event_id, round(gap / 86400000000.0, 6) AS rest_days, coalesce(gap < 36 * 3600000000, false) AS is_back_to_back FROM a""")
def rest_days(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.rest(game_log(spark, folder), BY_USER).select("event_id", "rest_days", "is_back_to_back"))


@query(f"""{LOG} SELECT event_id, round(36 * sum(value) {LAST5} / nullif(sum(k) {LAST5}, 0), 6) AS rate FROM log""")
def rolling_rate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.rolling_rate(game_log(spark, folder), BY_USER, "value", "k", 5, 36.0).select("event_id", "rate"))


@query(f"""{LOG} SELECT event_id, round(sum(CASE WHEN k > 0 THEN value * k END) {LAST5} / sum(CASE WHEN k > 0 THEN k END) {LAST5}, 9) AS wmean FROM log""")
def rolling_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.rolling_weighted(game_log(spark, folder), BY_USER, "value", "k", 5).select("event_id", "wmean"), 9)


@query(f"""{LOG}, p AS (SELECT *, sum(value) OVER (PARTITION BY season, event_type) AS pool FROM log)
SELECT event_id, round(sum(value) {LAST5} / sum(pool) {LAST5}, 9) AS share FROM p""")
def rolling_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.rolling_share(game_log(spark, folder), BY_USER, "value", ["season", "event_type"], 5).select("event_id", "share"), 9)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    log = game_log(spark, folder)
    return log.withColumn("rival", F.col("event_type")).withColumn("margin", F.col("value") - 40)


PAIR = "OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


@query(f"""{LOG}, a AS (SELECT event_id, count(*) {PAIR.format("UNBOUNDED")} AS h2h_games, CAST(coalesce(sum(CAST(won AS INT)) {PAIR.format("UNBOUNDED")}, 0) AS BIGINT) AS h2h_wins,
  round(avg(value - 40) {PAIR.format("UNBOUNDED")}, 6) AS h2h_margin, round(avg(value - 40) {PAIR.format("3")}, 6) AS last3_margin FROM log)
SELECT *, CASE WHEN h2h_games > 0 THEN round(h2h_wins / h2h_games, 6) END AS h2h_pct FROM a""")
def head_to_head(spark: SparkSession, folder: str) -> DataFrame:
    pair = h.History(("user_id", "rival"), "ts", "event_id")
    out = h.head_to_head(h.head_to_head(_pairs(spark, folder), pair, F.col("won"), "margin"), pair, F.col("won"), "margin", "last3", n=3)
    return rounded(out.select("event_id", "h2h_games", long("h2h_wins").alias("h2h_wins"), "h2h_pct", "h2h_margin", "last3_margin"))


_SIDES = """WITH g AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, sum(l_quantity) AS q, max(l_shipdate) AS t FROM lineitem GROUP BY 1 HAVING min(l_linenumber) < max(l_linenumber)),
s AS (SELECT l_orderkey, a AS team, b AS rival, q AS own, t FROM g UNION ALL SELECT l_orderkey, b, a, -q, t FROM g)
"""


@query(f"""{_SIDES}, f AS (SELECT *, avg(own) OVER (PARTITION BY team ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS form FROM s)
SELECT x.l_orderkey, x.team, round(x.form, 6) AS form, round(y.form, 6) AS opponent_form FROM f x LEFT JOIN f y ON x.l_orderkey = y.l_orderkey AND x.rival = y.team""")
def opponent_form(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("at")).filter("a < b")
    both = rel.sides(lines.withColumn("minus", -F.col("q")), {"a": {"team": "a", "rival": "b", "own": "q"}, "b": {"team": "b", "rival": "a", "own": "minus"}}).select("l_orderkey", "at", "team", "rival", "own")
    form = h.expanding(both, h.History(("team",), "at", "l_orderkey"), ["own"], label="form").withColumnRenamed("own_form", "form")
    return rounded(h.mirror(form, ["l_orderkey"], "team", "rival", ["form"]).select("l_orderkey", "team", "form", "opponent_form"))


_QUOTES = """WITH q AS (SELECT l_partkey AS game, l_suppkey AS vendor, l_shipdate AS t, max_by(l_discount, l_extendedprice) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT DISTINCT game, t FROM q),
g AS (SELECT m.game, m.t, q.vendor, q.v, row_number() OVER (PARTITION BY m.game, m.t, q.vendor ORDER BY q.t DESC) AS n FROM m JOIN q ON m.game = q.game AND q.t <= m.t),
c AS (SELECT game, t, avg(v) AS consensus, stddev_samp(v) AS spread, median(v) AS mid, count(*) AS vendors FROM g WHERE n = 1 GROUP BY ALL)
"""


def _consensus(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("game"), F.col("l_suppkey").alias("vendor"), F.col("l_shipdate").alias("at"), F.col("l_discount").alias("v"), F.col("l_extendedprice").alias("tie"))
    return h.running_latest(quotes, ["game"], "vendor", "at", "v", "tie")


@query(f"""{_QUOTES} SELECT game, t AS "at", round(consensus, 9) AS consensus, round(spread, 9) AS spread, round(mid, 9) AS median, vendors FROM c""")
def running_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_consensus(spark, folder), 9)


@query(f"""{_QUOTES} SELECT game, t AS "at", round(consensus, 9) AS consensus FROM c
WINDOW w AS (PARTITION BY game ORDER BY t) QUALIFY lag(consensus) OVER w IS NULL OR abs(consensus - lag(consensus) OVER w) > 1e-9 OR lead(t) OVER w IS NULL""")
def consensus_moves(spark: SparkSession, folder: str) -> DataFrame:
    moves = h.change_only(_consensus(spark, folder), h.History(("game",), "at", "at"), "consensus")
    return rounded(moves.select("game", "at", "consensus"), 9)


@query("""SELECT event_id, count(*) OVER w AS so_far, round(first(value) OVER w, 6) AS opening FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def running_count_opening(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(table(spark, folder, "events").select("event_id", F.count(F.lit(1)).over(w).alias("so_far"), F.first("value").over(w).alias("opening")))


@query("""SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS line FROM events""")
def running_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.running_median(table(spark, folder, "events").select("event_id", "user_id", "ts", "value"), BY_USER, "value", "line").select("event_id", "line"))


@query("""SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def resample_last(spark: SparkSession, folder: str) -> DataFrame:
    return h.resample_last(table(spark, folder, "events"), ["user_id"], "ts", "value", 3600, "event_id")


@query("""WITH b AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT user_id, bucket, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY bucket), 6) AS change FROM b QUALIFY change IS NOT NULL""")
def first_differences(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.changes(resample_last(spark, folder), ["user_id"], "bucket", "value").select("user_id", "bucket", "change"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS length FROM n GROUP BY user_id, event_type, g""")
def scoring_runs(spark: SparkSession, folder: str) -> DataFrame:
    return h.islands(table(spark, folder, "events"), BY_USER, "event_type").select("user_id", "event_type", "first_at", "last_at", "length")


@query("""WITH m AS (SELECT user_id, ts, event_id, sum(value - 40) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS margin FROM events),
l AS (SELECT *, lag(margin) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM m)
SELECT user_id, count(*) FILTER (WHERE sign(margin) * sign(before) < 0) AS lead_changes, round(max(abs(margin)), 4) AS largest_lead FROM l GROUP BY 1""")
def lead_changes(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    margins = table(spark, folder, "events").withColumn("margin", F.sum(F.col("value") - 40).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("margin").over(w))
    return rounded(margins.groupBy("user_id").agg(F.count_if(F.signum("margin") * F.signum("before") < 0).alias("lead_changes"), F.max(F.abs("margin")).alias("largest_lead")), 4)


@query(f"""{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM log)
SELECT user_id, count(*) FILTER (WHERE won AND n <= 10) AS last10_wins, count(*) FILTER (WHERE NOT won AND n <= 10) AS last10_losses, min(n) FILTER (WHERE won) - 1 AS since_win FROM r GROUP BY 1""")
def recent_form(spark: SparkSession, folder: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = game_log(spark, folder).withColumn("n", n)
    return recent.groupBy("user_id").agg(F.count_if(F.col("won") & (F.col("n") <= 10)).alias("last10_wins"), F.count_if(~F.col("won") & (F.col("n") <= 10)).alias("last10_losses"), (F.min(F.when(F.col("won"), F.col("n"))) - 1).cast("long").alias("since_win"))


@query(f"""{LOG}, t AS (SELECT DISTINCT event_type AS team, ts AS t FROM log), g AS (SELECT team, t, row_number() OVER (PARTITION BY team ORDER BY t DESC) AS n, count(*) OVER (PARTITION BY team) AS total FROM t),
p AS (SELECT l.user_id, l.event_type AS team, min(g.n) AS first_back, count(*) FILTER (WHERE g.n <= 50) AS played, max(g.n) AS tenure FROM log l JOIN g ON g.team = l.event_type AND g.t = l.ts GROUP BY ALL)
SELECT user_id, team, CAST(first_back - 1 AS BIGINT) AS missed_in_row, CAST(least(50, tenure) - played AS BIGINT) AS missed_of_50 FROM p""")
def games_missed(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a team's newest games a player missed, in a row and of the last fifty since joining."""
    log = game_log(spark, folder).withColumnRenamed("event_type", "team")
    # Newest first by day blocks: ranks inside a day, and the counts of later days added, so that no task has a team.
    games = log.select("team", "ts").distinct().withColumn("day", F.to_date("ts"))
    days = games.groupBy("team", "day").agg(F.count("*").alias("in_day"))
    later = Window.partitionBy("team").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("later", F.coalesce(F.sum("in_day").over(later), F.lit(0))).drop("in_day")
    ranked = games.withColumn("own", F.row_number().over(Window.partitionBy("team", "day").orderBy(F.desc("ts")))).join(days, ["team", "day"]).withColumn("n", F.col("own") + F.col("later"))
    met = log.join(ranked.select("team", "ts", "n"), ["team", "ts"])
    out = met.groupBy("user_id", "team").agg(F.min("n").alias("first"), F.count_if(F.col("n") <= 50).alias("played"), F.max("n").alias("tenure"))
    return out.select("user_id", "team", long(F.col("first") - 1).alias("missed_in_row"), long(F.least(F.lit(50), "tenure") - F.col("played")).alias("missed_of_50"))


#: Kinds of events hold a fifth of all rows each: keys that no task should have whole.
BY_TYPE = h.History(("event_type",), "ts", "event_id")
BLOCK = 5_000
_TYPE = "PARTITION BY event_type ORDER BY ts"
_BEFORE = f"OVER ({_TYPE} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


def _cents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers, whose sums are exact in whatever order they are taken."""
    return game_log(spark, folder).withColumn("value", F.round(F.col("value") * 100))


@query(f"""{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) {_BEFORE} AS upto FROM log)
SELECT a.event_id, round(avg(round(b.value * 100)), 6) AS value_roll, count(b.i) AS roll_rows FROM r a LEFT JOIN r b ON a.event_type = b.event_type AND b.i <= a.upto AND b.i > a.upto - 20 GROUP BY a.event_id""")
def blocked_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of a kind's last twenty values, from blocks of a key's rows."""
    return rounded(h.rolling(_cents(spark, folder), BY_TYPE, ["value"], 20, block_rows=BLOCK).select("event_id", "value_roll", "roll_rows"))


@query(f"""{LOG} SELECT event_id, round(avg(round(value * 100)) {_BEFORE}, 6) AS value_mean, count(*) {_BEFORE} AS mean_rows, max(ts) {_BEFORE} AS mean_window_end FROM log""")
def blocked_expanding(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.expanding(_cents(spark, folder), BY_TYPE, ["value"], block_rows=BLOCK).select("event_id", "value_mean", "mean_rows", "mean_window_end"))


@query(f"""{LOG}, a AS (SELECT event_id, count(*) {_BEFORE.replace("event_type", "event_type, season")} AS prior_games, CAST(coalesce(sum(CAST(won AS INT)) {_BEFORE.replace("event_type", "event_type, season")}, 0) AS BIGINT) AS prior_wins FROM log)
SELECT *, CASE WHEN prior_games > 0 THEN round(prior_wins / prior_games, 6) END AS prior_pct FROM a""")
def blocked_season(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(h.season_to_date(game_log(spark, folder), BY_TYPE, F.col("won"), "season", block_rows=BLOCK).select("event_id", "prior_games", "prior_wins", "prior_pct"))


@query(f"""{LOG}, a AS (SELECT *, CASE WHEN won = lag(won) OVER w THEN 0 ELSE 1 END AS new FROM log WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY event_type, run ORDER BY ts, event_id) * CASE WHEN won THEN 1 ELSE -1 END AS s FROM b),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) = 1)
SELECT c.event_id, CAST(coalesce(k.s, 0) AS BIGINT) AS streak FROM c ASOF LEFT JOIN k ON c.event_type = k.event_type AND c.ts > k.ts""")
def blocked_streak(spark: SparkSession, folder: str) -> DataFrame:
    return h.streak(game_log(spark, folder), BY_TYPE, F.col("won"), block_rows=BLOCK).select("event_id", "streak")


@query("""SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS line FROM events""")
def blocked_median(spark: SparkSession, folder: str) -> DataFrame:
    """Running medians of keys that are too large for one block."""
    return rounded(h.running_median(table(spark, folder, "events").select("event_id", "event_type", "ts", "value"), BY_TYPE, "value", "line", 1_000).select("event_id", "line"))
