"""Prices, execution, lead and lag, reports, trends, races."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import history as h
from tidemark.operators import markets as m
from tidemark.queries.catalog import LOG, game_log, long, query, rounded, table

#: American odds from a price: under 100 counts as a favourite.
_ODDS = "CAST(CASE WHEN k >= 50 THEN k + 50 ELSE -(k + 100) END AS INT)"
_IMPLIED = "CASE WHEN o > 0 THEN 100.0 / (o + 100) ELSE -o / (-o + 100.0) END"


@query(f"""{LOG}, x AS (SELECT event_id, {_ODDS} AS o, k FROM log), y AS (SELECT *, {_IMPLIED} AS p, (k + 1) / 200 AS r FROM x)
SELECT event_id, o AS odds, round(p, 9) AS implied, round(CASE WHEN o > 0 THEN o / 100.0 ELSE 100.0 / -o END, 9) AS profit, round(p / (p + r), 9) AS fair_home, round(r / (p + r), 9) AS fair_away, round(r - p, 9) AS clv FROM y""")
def odds_math(spark: SparkSession, folder: str) -> DataFrame:
    x = game_log(spark, folder).select("event_id", F.expr(_ODDS).alias("odds"), ((F.col("k") + 1) / 200).alias("r"))
    p = odds.american_to_implied(F.col("odds"))
    x = x.withColumn("implied", p)
    home, away = odds.remove_vig(F.col("implied"), F.col("r"))
    return rounded(x.select("event_id", "odds", "implied", odds.american_to_profit(F.col("odds")).alias("profit"), home.alias("fair_home"), away.alias("fair_away"), odds.clv(F.col("implied"), F.col("r")).alias("clv")), 9)


@query(f"""{LOG} SELECT event_id, CASE event_type WHEN 'click' THEN k / 100 WHEN 'view' THEN round(1 - k / 100, 9) END AS home_probability, round(coalesce((value + k) / 2, value), 9) AS price FROM log""")
def probability_orientation(spark: SparkSession, folder: str) -> DataFrame:
    home = odds.home_probability(F.col("event_type"), F.lit("click"), F.lit("view"), F.col("k") / 100)
    return rounded(game_log(spark, folder).select("event_id", home.alias("home_probability"), odds.implied_price(F.col("value"), F.col("k"), F.col("value")).alias("price")), 9)


_PRICE = "l_extendedprice / l_quantity"


@query(f"""SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS vwap, sum(l_quantity) AS volume, count(*) AS fills FROM lineitem GROUP BY 1""")
def vwap(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return rounded(m.vwap(lines, ["l_suppkey"], "price", "l_quantity"))


@query(f"""WITH v AS (SELECT l_suppkey, sum(l_extendedprice) / sum(l_quantity) AS vwap FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(max(vwap), 5) AS vwap, round(2 * sum(abs({_PRICE} - vwap) * l_quantity) / sum(l_quantity), 5) AS effective_spread, round(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity), 9) AS buy_share,
  round((2 * sum(l_quantity) FILTER (WHERE l_returnflag = 'R') - sum(l_quantity)) / sum(l_quantity), 9) AS imbalance, round(max({_PRICE}) - min({_PRICE}), 5) AS price_range, count(*) AS fills FROM lineitem JOIN v USING (l_suppkey) GROUP BY 1""")
def execution_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    out = m.execution_summary(lines, ["l_suppkey"], "price", "l_quantity", F.col("l_returnflag") == "R")
    return out.select("l_suppkey", *[F.round(c, 5).alias(c) for c in ("vwap", "effective_spread", "price_range")], *[F.round(c, 9).alias(c) for c in ("buy_share", "imbalance")], "fills")


@query(f"""{LOG}, x AS (SELECT event_id, user_id, season, value, k, event_type, {_ODDS} AS o FROM log), y AS (SELECT *, {_IMPLIED} AS p, (k + 20) / 120 AS fair FROM x WHERE value >= 20),
b AS (SELECT user_id, season, arg_min(event_type, (p, event_type, fair)) AS book, min(p) AS book_implied, arg_min(fair, (p, event_type, fair)) AS venue_fair FROM y GROUP BY ALL)
SELECT user_id, season, book, round(book_implied, 9) AS book_implied, round(venue_fair, 9) AS venue_fair, round(venue_fair - book_implied, 9) AS edge FROM b WHERE venue_fair > book_implied""")
def divergences(spark: SparkSession, folder: str) -> DataFrame:
    prices = game_log(spark, folder).select("user_id", "season", F.col("value").alias("volume"), F.col("event_type").alias("book"), ((F.col("k") + 20) / 120).alias("venue_fair"), odds.american_to_implied(F.expr(_ODDS)).alias("book_implied"))
    return rounded(m.divergences(prices, "volume", "book", "venue_fair", "book_implied", ["user_id", "season"], 20), 9)


_T = "CASE WHEN count(clv) > 1 AND stddev_samp(clv) > 0 THEN round(avg(clv) / (stddev_samp(clv) / sqrt(count(clv))), 5) END"


@query(f"""{LOG}, g AS (SELECT event_type, k / 100 AS edge, (value - 50) / 100 AS clv, CASE WHEN k < 20 THEN NULL ELSE k > 60 END AS survived, value / 10 - 4 AS profit FROM log)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN survived THEN 1.0 WHEN NOT survived THEN 0.0 END), 9) AS survival, round(avg(edge), 9) AS mean_edge, round(avg(clv), 9) AS mean_clv, {_T} AS t_clv, round(avg(profit), 9) AS roi, count(*) >= 120 AS ready FROM g GROUP BY 1""")
def divergence_report(spark: SparkSession, folder: str) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    graded = game_log(spark, folder).select("event_type", (k / 100).alias("edge"), ((v - 50) / 100).alias("clv"), F.when(k >= 20, k > 60).alias("survived"), (v / 10 - 4).alias("profit"))
    out = m.divergence_report(graded, ["event_type"], "edge", "clv", "survived", "profit")
    return rounded(out.withColumn("t_clv", F.round("t_clv", 5)), 9)


@query(f"""{LOG}, g AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN (k - 50) / 1000 END AS clv FROM log)
SELECT user_id, count(clv) AS scored, count(*) FILTER (WHERE clv IS NULL) AS line_moved, round(avg(clv), 9) AS mean_clv, round(stddev_samp(clv), 9) AS sd_clv, round(avg((clv = 0)::INT), 9) AS unmoved_share,
  round(avg((abs(clv) > 0.01)::INT), 9) AS share_over_1pct, round(avg((abs(clv) > 0.03)::INT), 9) AS share_over_3pct, round(avg((abs(clv) > 0.05)::INT), 9) AS share_over_5pct FROM g GROUP BY 1""")
def clv_report(spark: SparkSession, folder: str) -> DataFrame:
    scored = game_log(spark, folder).select("user_id", F.when(F.col("event_type") != "error", (F.col("k") - 50) / 1000).alias("clv"))
    out = m.clv_report(scored, ["user_id"], "clv")
    return rounded(out.withColumn("line_moved", long("line_moved")), 9)


_BUCKETS = """b AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS bucket, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY bucket) AS change FROM b),
x AS (SELECT * FROM d WHERE event_type = 'click' AND change IS NOT NULL), y AS (SELECT * FROM d WHERE event_type = 'view' AND change IS NOT NULL),
p AS (SELECT lag, x.user_id, x.change AS x, y.change AS y FROM x, unnest(range(-2, 3)) AS u(lag) JOIN y ON y.user_id = x.user_id AND y.bucket = x.bucket + lag)"""


def _changes(spark: SparkSession, folder: str, kind: str, name: str) -> DataFrame:
    events = table(spark, folder, "events").filter(F.col("event_type") == kind)
    last = h.resample_last(events, ["user_id"], "ts", "value", 86_400, "event_id")
    return h.changes(last, ["user_id"], "bucket", "value").select("user_id", "bucket", F.col("change").alias(name))


@query(f"""WITH {_BUCKETS}, c AS (SELECT lag, count(*) AS n, corr(x, y) AS r FROM p GROUP BY 1)
SELECT lag, n, CASE WHEN n >= 30 THEN round(r, 9) END AS r, CASE WHEN n >= 30 AND n > 2 AND abs(r) < 1 THEN round(r * sqrt((n - 2) / (1 - r * r)), 6) END AS t FROM c""")
def lead_lag(spark: SparkSession, folder: str) -> DataFrame:
    out = m.cross_correlation(_changes(spark, folder, "click", "x"), _changes(spark, folder, "view", "y"), "user_id", "bucket", "x", "y", [-2, -1, 0, 1, 2])
    return out.select("lag", "n", F.round("r", 9).alias("r"), F.round("t", 6).alias("t"))


def _poisson() -> str:
    """How often a cluster with the draw u is taken, as SQL."""
    upto, p = [], 0.36787944117144233
    for k in range(1, 12):
        upto.append((upto[-1] if upto else 0.0) + p)
        p /= k
    return " + ".join(f"(u > {x!r})::INT" for x in upto)


@query(f"""WITH {_BUCKETS}, s AS (SELECT user_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM p WHERE lag = 0 GROUP BY 1),
dr AS (SELECT s.*, i, (CAST('0x' || substr(md5('20260803:' || i || ':' || user_id), 1, 10) AS BIGINT) + 0.5) / 1099511627776 AS u FROM s, range(0, 2001) AS t(i)),
t AS (SELECT *, CASE WHEN i = 0 THEN 1 ELSE {_poisson()} END AS k FROM dr),
g AS (SELECT i, sum(k * n) AS n, sum(k * sx) AS sx, sum(k * sy) AS sy, sum(k * sxx) AS sxx, sum(k * syy) AS syy, sum(k * sxy) AS sxy FROM t GROUP BY 1),
v AS (SELECT i, n * sxy - sx * sy AS cov, (n * sxx - sx * sx) * (n * syy - sy * sy) AS var FROM g), r AS (SELECT i, CASE WHEN var > 0 THEN cov / sqrt(var) END AS r FROM v)
SELECT round(max(r) FILTER (WHERE i = 0), 6) AS r, round(avg((r <= 0)::INT) FILTER (WHERE i > 0 AND r IS NOT NULL), 6) AS p_not_positive, count(r) FILTER (WHERE i > 0) AS resamples FROM r""")
def lead_lag_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Draws are a hash that SQL has too, so the resamples are the same ones."""
    pairs = _changes(spark, folder, "click", "x").join(_changes(spark, folder, "view", "y"), ["user_id", "bucket"])
    return rounded(m.cluster_bootstrap(pairs, "user_id", "x", "y"))


def _span(name: str, inside: str) -> str:
    over, under = (f"count(*) FILTER (WHERE {inside} AND d = {s})" for s in (1, -1))
    return f"{over} AS {name}_over, {under} AS {name}_under, CASE WHEN {over} + {under} >= 4 THEN round({over} / ({over} + {under}), 9) END AS {name}_rate"


@query(f"""{LOG}, g AS (SELECT user_id, sign(value - k) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM log)
SELECT user_id, {", ".join(_span(f"last_{n}", f"n <= {n}") for n in (5, 10, 20))}, {_span("season", "true")} FROM g GROUP BY 1""")
def hit_rates(spark: SparkSession, folder: str) -> DataFrame:
    out = m.hit_rates(game_log(spark, folder), "user_id", [F.desc("ts"), F.desc("event_id")], "value", F.col("k"))
    return rounded(out.select(*[long(c).alias(c) if c.endswith(("_over", "_under")) else c for c in out.columns]), 9)


@query(f"""{LOG}, g AS (SELECT user_id, CAST(sign(value - k) AS INT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM log WHERE value <> k),
f AS (SELECT *, first(d) OVER (PARTITION BY user_id ORDER BY n) AS f FROM g), b AS (SELECT user_id, coalesce(min(n) FILTER (WHERE d <> f) - 1, max(n)) * max(f) AS streak FROM f GROUP BY 1)
SELECT user_id, CAST(streak AS BIGINT) AS streak FROM b""")
def current_streak(spark: SparkSession, folder: str) -> DataFrame:
    return m.current_streak(game_log(spark, folder), "user_id", [F.desc("ts"), F.desc("event_id")], "value", F.col("k"))


@query(f"""{LOG} SELECT user_id, count(*) FILTER (WHERE value > k) AS above, count(*) FILTER (WHERE value < k) AS below, round(median(value - k), 9) AS median_gap FROM log GROUP BY 1""")
def gap_balance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(m.gap_balance(game_log(spark, folder).withColumn("gap", F.col("value") - F.col("k")), ["user_id"], "gap"), 9)


@query(f"""{LOG}, s AS (SELECT season, user_id AS team, CAST(count(*) FILTER (WHERE won) AS INT) AS w, CAST(count(*) FILTER (WHERE NOT won) AS INT) AS l FROM log WHERE user_id % 10 < 10 GROUP BY ALL),
r AS (SELECT *, 60 - l AS most, row_number() OVER (PARTITION BY season ORDER BY w / (w + l) DESC, w DESC, l, team) AS seed FROM s),
z AS (SELECT r.*, first(w) OVER o AS fw, first(l) OVER o AS fl, max(w) FILTER (WHERE seed = 8) OVER (PARTITION BY season) AS held FROM r WINDOW o AS (PARTITION BY season ORDER BY seed)),
v AS (SELECT a.season, a.team, list_sort(list(b.most), 'DESC')[8] AS rival FROM r a JOIN r b ON a.season = b.season AND a.team <> b.team GROUP BY ALL)
SELECT season, team, seed, ((fw - w) + (l - fl)) / 2 AS games_behind, CAST(greatest(rival + 1 - w, 0) AS INT) AS magic_number, coalesce(rival + 1 - w <= 0, true) AS clinched, coalesce(seed > 8 AND most < held, false) AS eliminated FROM z LEFT JOIN v USING (season, team)""")
def playoff_race(spark: SparkSession, folder: str) -> DataFrame:
    log, won = game_log(spark, folder), F.col("won")
    table_ = log.groupBy("season", F.col("user_id").alias("team")).agg(F.count_if(won).cast("int").alias("w"), F.count_if(~won).cast("int").alias("l"))
    out = m.race(table_, ["season"], "team", "w", "l", 60, 8)
    return out.select("season", "team", long("seed").alias("seed"), "games_behind", F.col("magic_number").cast("int").alias("magic_number"), "clinched", "eliminated")


def _made(keys: str) -> str:
    return f"SELECT {keys}, count(*) FILTER (WHERE l_returnflag = 'R') AS made, count(*) AS tried FROM lineitem GROUP BY ALL"


@query(f"""WITH p AS ({_made("l_suppkey AS player, l_linenumber AS zone")}), d AS ({_made("l_partkey % 50 AS opponent, l_linenumber AS zone")}), g AS ({_made("l_linenumber AS zone")})
SELECT player, opponent, zone, round(p.made / p.tried - g.made / g.tried, 9) AS own_edge, round(d.made / d.tried - g.made / g.tried, 9) AS allowed_edge FROM p JOIN d USING (zone) JOIN g USING (zone)
WHERE player % 50 = opponent AND p.tried >= 15 AND d.tried >= 15 AND own_edge > 0.03 AND allowed_edge > 0.03""")
def zone_edges(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_linenumber").alias("zone"), F.col("l_suppkey").alias("player"), (F.col("l_partkey") % 50).alias("opponent"), (F.col("l_returnflag") == "R").alias("made"))
    count = lambda df, side: df.agg(F.count_if("made").alias(f"{side}_made"), F.count("*").alias(f"{side}_tried"))
    players = count(lines.groupBy("player", "zone"), "player").withColumn("opponent", F.col("player") % 50)
    league = count(lines.groupBy("zone"), "league").select("zone", (F.col("league_made") / F.col("league_tried")).alias("league_rate"))
    out = m.zone_edges(players, count(lines.groupBy("opponent", "zone"), "defence"), league, "zone")
    return rounded(out.select("player", "opponent", "zone", "own_edge", "allowed_edge"), 9)
