"""Captured texts read into fields, markets priced and linked, divergences from find to grade, plays summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import captures as cap
from tidemark.operators import asof, divergence, markets, plays
from tidemark.operators import history as h
from tidemark.operators import quality as ql
from tidemark.plans.targets import drop_targets
from tidemark.queries.catalog import LOG, QUERIES, game_log, long, query, rounded, table
from tidemark.queries.strategies import _TEAM

#: Names of teams that every task may hold.
TEAMS = 10_000
_TICKER = "'KXGAME-' || strftime(o_orderdate, '%y') || CASE WHEN o_orderkey % 13 = 0 THEN 'XXX' ELSE upper(strftime(o_orderdate, '%b')) END || CASE WHEN o_orderkey % 11 = 0 THEN '31' ELSE strftime(o_orderdate, '%d') END || CASE o_orderkey % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN 'ABC-D12' ELSE '' END"


@query("""WITH t AS (SELECT o_orderkey, 2000 + year(o_orderdate) % 100 AS y, month(o_orderdate) AS m, CASE WHEN o_orderkey % 11 = 0 THEN 31 ELSE day(o_orderdate) END AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(TRY_CAST(printf('%d-%02d-%02d', y, m, d) AS DATE) AS VARCHAR) END AS day FROM t""")
def ticker_dates(spark: SparkSession, folder: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    ticker = F.concat(
        F.lit("KXGAME-"), F.date_format(date, "yy"), F.when(key % 13 == 0, "XXX").otherwise(F.upper(F.date_format(date, "MMM"))), F.when(key % 11 == 0, "31").otherwise(F.date_format(date, "dd")),
        F.when(key % 3 == 0, "ABC").when(key % 3 == 1, "ABC-D12").otherwise(""),
    )
    return table(spark, folder, "orders").select("o_orderkey", cap.ticker_date(ticker).cast("string").alias("day"))


@query("""WITH c AS (SELECT c_custkey AS k, 'Team ' || n_name AS a, c_mktsegment AS b, CAST(c_custkey % 40 AS VARCHAR) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT k, CASE k % 9 WHEN 0 THEN 'two_teams' WHEN 1 THEN 'two_teams' WHEN 2 THEN 'margin' WHEN 3 THEN 'half_margin' WHEN 4 THEN 'spread' WHEN 5 THEN 'player_count' WHEN 6 THEN 'player_line' WHEN 7 THEN 'total' END AS kind,
  CASE WHEN k % 9 IN (0, 1, 2, 3, 4, 7) THEN a END AS team_a, CASE WHEN k % 9 IN (0, 1, 7) THEN b END AS team_b, CASE WHEN k % 9 IN (5, 6) THEN b END AS player, CASE k % 9 WHEN 5 THEN 'points' WHEN 6 THEN 'rebounds' END AS prop,
  CASE k % 9 WHEN 2 THEN n::DOUBLE WHEN 3 THEN n::DOUBLE WHEN 4 THEN -n::DOUBLE WHEN 5 THEN n::DOUBLE - 0.5 WHEN 6 THEN n::DOUBLE + 0.5 WHEN 7 THEN n::DOUBLE + 0.5 END AS line FROM c""")
def market_titles(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    c = c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("Team "), "n_name").alias("a"), F.col("c_mktsegment").alias("b"), (F.col("c_custkey") % 40).cast("string").alias("n"))
    shapes = ["{a} vs {b}: 1st Quarter Total?", "{a} vs. {b} women's Pro Basketball game: Over 166.5 points?", "{a} wins the game by over {n} points?", "Will {a} win the 1H by over {n} points?", "Spread: {a} (-{n})", "{b}: {n}+ Points", "{b}: Rebounds O/U {n}.5", "{a} vs. {b}: O/U {n}.5", "nothing of the kind"]
    title = F.get(F.array(*[_filled(x) for x in shapes]), (F.col("k") % 9).cast("int"))
    return c.select("k", cap.market_title(title).alias("t")).select("k", "t.*")


def _filled(shape: str):
    """A text with {a}, {b} and {n} out of columns."""
    out = F.lit(shape)
    for c in "abn":
        out = F.replace(out, F.lit(f"{{{c}}}"), F.col(c))
    return out


@query("""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'Unknown' WHEN k % 20 BETWEEN 1 AND 13 OR k % 20 = 18 THEN (['Made Shot', 'Missed Shot', 'Free Throw', 'Rebound', 'Turnover', 'Foul', 'Violation', 'Substitution', 'Timeout', 'Jump Ball', 'Ejection', 'Period Begin', 'Period End', '', '', '', '', 'Instant Replay'])[k % 20] ELSE 'Event ' || k % 20 END AS label
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    code = F.when(F.col("event_id") % 23 != 0, (F.get_json_object("props", "$.k").cast("int") % 20))
    return table(spark, folder, "events").select("event_id", cap.event_label(code).alias("label"))


@query("""SELECT user_id, event_id, event_type, CAST(CASE WHEN event_id % 5 <> 0 THEN floor(value) END AS BIGINT) AS points FROM events""")
def row_sets(spark: SparkSession, folder: str) -> DataFrame:
    """A payload for each user with the rows under headers; every fifth row lacks its last cell."""
    e = table(spark, folder, "events")
    cells = F.array(F.col("event_id").cast("string"), F.col("event_type"), F.floor("value").cast("string"))
    row = F.when(F.col("event_id") % 5 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    other = F.struct(F.lit("other").alias("name"), F.array(F.lit("X")).alias("headers"), F.array(F.array(F.lit("1"))).alias("rowSet"))
    log = F.struct(F.lit("log").alias("name"), F.array(F.lit("ID"), F.lit("TYPE"), F.lit("PTS")).alias("headers"), F.array(row).alias("rowSet"))
    payloads = e.select("user_id", F.to_json(F.struct(F.array(other, log).alias("resultSets"))).alias("payload"))
    rows = payloads.select("user_id", F.explode(cap.row_set(F.col("payload"), "log")).alias("r"))
    return rows.select("user_id", F.col("r")["ID"].cast("long").alias("event_id"), F.col("r")["TYPE"].alias("event_type"), F.col("r")["PTS"].cast("long").alias("points"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 4 = 1 AND k % 10 <= 6 THEN k % 10 WHEN event_id % 4 = 2 AND k % 3 = 0 THEN 0 END AS INT) AS choice FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def reply_choices(spark: SparkSession, folder: str) -> DataFrame:
    k, e = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    reply = F.when(e % 4 == 1, F.concat((k % 10).cast("string"), F.lit(". because"))).when(e % 4 == 2, F.concat(-(k % 3), F.lit(" is none"))).when(e % 4 == 3, "none of them, 3 times")
    return table(spark, folder, "events").select("event_id", cap.choice(reply, F.lit(6)).alias("choice"))


@query("""WITH s AS (SELECT user_id || ':' || day(ts) AS name, event_type, max(value) / 100 AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS n, coalesce(lead(score) OVER w, 0) AS next FROM s WINDOW w AS (PARTITION BY name ORDER BY score DESC, event_type))
SELECT name, event_type, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.75 AND score - next >= 0.15""")
def confident_matches(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat_ws(":", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("name")
    scored = table(spark, folder, "events").groupBy(name, "event_type").agg((F.max("value") / 100).alias("score"))
    return rounded(markets.confident(scored, "name", "event_type", "score"), 6)


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment || ' X' || c_custkey WHEN 3 THEN c_mktsegment || ' X' || c_custkey WHEN 4 THEN c_mktsegment || ' X' || c_custkey || ' Jr' END AS player FROM customer""")
def named_players(spark: SparkSession, folder: str) -> DataFrame:
    who = F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("X"), F.col("c_custkey").cast("string")))
    texts = [F.concat(F.lit("Signed G "), who, F.lit(". More.")), F.concat(F.lit("Named "), who, F.lit(" a coach")), F.concat(F.lit("Waived F "), "c_mktsegment"), F.concat(F.lit("Signed Gs  "), who, F.lit(" And others")), F.concat(F.lit("Traded C/F "), who, F.lit(" Jr III to X")), F.concat(F.lit("Waived F "), "c_mktsegment", F.lit(", Xy Z"))]
    return table(spark, folder, "customer").select("c_custkey", cap.player_after_position(F.get(F.array(*texts), (F.col("c_custkey") % 6).cast("int"))).alias("player"))


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
u AS (SELECT k, n_name AS team, r_name || ' ' || seg AS player, 'Out' AS status, 'Left knee - soreness' AS reason, true AS submitted FROM c UNION ALL
SELECT k, n_name, 'Ann Moss-' || seg, 'Questionable', NULL, true FROM c WHERE k % 2 = 0 UNION ALL SELECT k, 'New Town', NULL, NULL, NULL, false FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'New Town United', 'Bo ' || seg, 'Available', 'rest', true FROM c WHERE k % 3 = 1)
SELECT k, '08/05/26 05:30 PM' AS reported_at, '08/06/2026' AS game_date, 'AB@CDE' AS matchup, team, player, status, reason, submitted FROM u""")
def report_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Reports written out of the tables and read again."""
    nations = table(spark, folder, "nation")
    c = table(spark, folder, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, folder, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    parts = [
        F.lit(f"Injury Report: 08/05/26 05:30 PM\nPage 1\n{cap.COLUMN_HEADER.replace(' ', chr(10))}\nLost, Before Out 08/06/2026 07:00 (ET) AB@CDE"),
        F.col("n_name"), F.concat(seg, F.lit(", "), F.col("r_name"), F.lit(" Out Left knee - soreness;")), F.when(k % 2 == 0, F.concat(F.lit("Moss- "), seg, F.lit(", Ann Questionable"))),
        F.when(k % 3 == 0, f"New Town {cap.PENDING}").when(k % 3 == 1, F.concat(F.lit("New Town United "), seg, F.lit(", Bo Available rest"))),
    ]
    reports = c.select(k.alias("k"), F.concat_ws("\n", *parts).alias("text"))
    teams = [r["n_name"] for r in nations.select("n_name").limit(TEAMS + 1).collect()]
    if len(teams) > TEAMS:
        raise ValueError(f"over {TEAMS} names are too many for each task to hold")
    return cap.report_entries(reports, "k", "text", [*teams, "New Town", "New Town United"])


_SNAPSHOTS = """WITH s AS (SELECT l_suppkey AS market, l_orderkey AS game_id, l_partkey AS player_id, l_discount AS implied_probability, l_shipdate AS captured_at, l_linenumber AS n FROM lineitem),
g AS (SELECT o_orderkey AS game_id, o_orderdate AS start_time FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT s.*, start_time FROM s LEFT JOIN g USING (game_id) WHERE captured_at <= coalesce(start_time, TIMESTAMP '1999-01-01') QUALIFY row_number() OVER (PARTITION BY market, s.game_id, player_id ORDER BY captured_at DESC) = 1)
"""


@query(f"""{_SNAPSHOTS} SELECT market, game_id, player_id, implied_probability AS over_probability, CASE WHEN market % 2 = 0 THEN 'points' ELSE 'rebounds' END AS prop_type, CASE WHEN market % 2 = 0 THEN n + 9.5 ELSE n + 3.5 END AS line, captured_at FROM l WHERE n > 1""")
def market_props(spark: SparkSession, folder: str) -> DataFrame:
    """Each prop market's last price up to the start, with what and how much it is about; titles that say neither go."""
    n = F.col("l_linenumber").cast("string")
    title = F.when(F.col("l_linenumber") == 1, "Some Body").when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Some Body: 1"), n, F.lit("+ Points"))).otherwise(F.concat(F.lit("Some Body: Rebounds O/U "), n, F.lit(".5")))
    shift = F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(3)
    s = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("market"), F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("player_id"), F.col("l_discount").alias("implied_probability"), F.col("l_shipdate").alias("captured_at"), title.alias("title"), shift.alias("shift"))
    games = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("start_time"))
    last = markets.latest_markets(s, games, F.lit("1999-01-01").cast("timestamp_ntz"), ["market", "game_id", "player_id"])
    read = last.withColumn("t", cap.market_title(F.col("title"))).filter("t.prop is not null and t.line is not null")
    return read.select("market", "game_id", "player_id", F.col("implied_probability").alias("over_probability"), F.col("t.prop").alias("prop_type"), (F.col("t.line") + F.col("shift")).alias("line"), "captured_at")


_PRICES = """WITH g AS (SELECT o_orderkey AS game_id, 'Home ' || o_custkey || ' Gulls' AS h, 'Away ' || o_custkey || ' Kites' AS a FROM orders),
p AS (SELECT l_orderkey AS game_id, l_shipdate AS "at", l_discount AS p, CASE l_linenumber WHEN 1 THEN 'home' WHEN 2 THEN 'home' WHEN 3 THEN 'home' WHEN 4 THEN 'away' WHEN 5 THEN 'away' END AS side, l_linenumber FROM lineitem WHERE l_returnflag <> 'N')
"""


def _game_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of winner markets with the side they are about: outcomes are names, or their first or last words."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    name = lambda first, last: F.concat_ws(" ", F.lit(first), F.col("o_custkey").cast("string"), F.lit(last))
    games = orders.select(F.col("o_orderkey").alias("game_id"), name("Home", "Gulls").alias("home_name"), name("Away", "Kites").alias("away_name"))
    n = F.col("l_linenumber")
    outcome = F.when(n == 1, F.lit("Home")).when(n == 2, "Gulls").when(n == 3, name("Home", "Gulls")).when(n == 4, "Kites").when(n == 5, name("Away", "Kites")).when(n == 6, "Draw")
    s = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("game_id"), n.alias("n"), F.when(F.col("l_returnflag") == "N", "KXQUARTER-1").otherwise("KXGAME-1").alias("market"), outcome.alias("outcome"), F.col("l_discount").alias("implied_probability"), F.col("l_shipdate").alias("at"))
    return markets.game_prices(s, games, F.col("market").startswith("KXGAME-"))


@query(f"""{_PRICES} SELECT game_id, l_linenumber AS n, "at", p AS implied_probability, side FROM p WHERE side IS NOT NULL AND game_id IN (SELECT game_id FROM g)""")
def game_market_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _game_prices(spark, folder).select("game_id", "n", "at", "implied_probability", "side")


@query(f"""{_PRICES} SELECT game_id, "at", round(avg(CASE side WHEN 'home' THEN p ELSE 1 - p END), 9) AS home_probability FROM p WHERE side IS NOT NULL AND game_id IN (SELECT game_id FROM g) GROUP BY ALL""")
def venue_series(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(markets.venue_series(_game_prices(spark, folder), ["game_id"], "at"), 9)


@query("""SELECT l_orderkey AS game_id, l_linenumber AS n, l_shipdate AS "at", CASE WHEN l_linenumber = 3 THEN l_discount ELSE 1 - l_discount END AS home_probability FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber IN (3, 5)""")
def home_fills(spark: SparkSession, folder: str) -> DataFrame:
    """Fills as what they say of the home team, whichever side was bought; those of other outcomes go."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    name = lambda first: F.concat_ws(" ", F.lit(first), F.col("o_custkey").cast("string"))
    n = F.col("l_linenumber")
    fills = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("game_id"), n.alias("n"), F.col("l_shipdate").alias("at"), F.col("l_discount").alias("price"), F.when(n == 3, name("Home")).when(n == 5, name("Away")).when(n == 6, "Draw").alias("outcome"))
    games = orders.select(F.col("o_orderkey").alias("game_id"), name("Home").alias("home_name"), name("Away").alias("away_name"))
    return rounded(markets.home_fills(fills, games).select("game_id", "n", "at", "home_probability"), 9)


@query("""WITH r AS (SELECT l_suppkey AS k, avg(l_discount) * 8 AS rate, avg(l_tax) * 12 AS price, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, round(round(rate, 9) - round(price, 9), 3) AS gap FROM r WHERE round(price, 9) BETWEEN 0.03 AND 0.97 AND n >= 6 AND k NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) ORDER BY abs(round(round(rate, 9) - round(price, 9), 3)) DESC, k LIMIT 12""")
def ranked_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve largest gaps between how often and how dear; keys in the red are ruled out."""
    r = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount") * 8, 9).alias("rate"), F.round(F.avg("l_tax") * 12, 9).alias("price"), F.count("*").alias("n"))
    out = table(spark, folder, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))
    return markets.ranked_gaps(r, "rate", "price", F.col("n"), out, "k", 12).select("k", "gap")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey AS market, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS link FROM lineitem), r AS (SELECT s_suppkey AS market, s_nationkey AS game FROM supplier WHERE s_acctbal > 0)
SELECT l_orderkey, l_linenumber, market, coalesce(link, game) AS link FROM m LEFT JOIN r USING (market)""")
def relinked(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose market had no game get it once the market resolves; each market is resolved once."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("market"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("link"))
    resolver = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("market"), long("s_nationkey").alias("link"))
    return plays.relink(rows, ["market"], "link", plays.unlinked(rows, ["market"], "link").join(resolver, "market"))


_IMPLIED = "CASE WHEN {0} > 0 THEN 100.0 / ({0} + 100) ELSE -{0}::DOUBLE / (-{0} + 100) END"


_DIVERGENCES = f"""WITH q AS (SELECT l_orderkey AS game_id, l_suppkey AS vendor, l_shipdate AS t, CAST(l_quantity * 10 - 255 AS INT) AS home, CAST(265 - l_quantity * 10 AS INT) AS away FROM lineitem),
s AS (SELECT game_id, vendor, t, 'home' AS side, home AS odds FROM q UNION ALL SELECT game_id, vendor, t, 'away', away FROM q),
n AS (SELECT * FROM q WHERE t <= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY game_id, vendor ORDER BY t DESC, home DESC, away DESC) = 1),
b AS (SELECT game_id, 'home' AS side, home AS odds, vendor FROM n UNION ALL SELECT game_id, 'away', away, vendor FROM n),
top AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY game_id, side ORDER BY odds DESC, vendor) = 1),
g AS (SELECT o_orderkey AS game_id, o_orderdate AS start_time, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 200000 END AS home_won, (o_custkey % 100) / 100 AS fair FROM orders WHERE o_totalprice >= 100000),
d AS (SELECT game_id, side, vendor, odds, {_IMPLIED.format("odds")} AS implied, CASE side WHEN 'home' THEN fair ELSE 1 - fair END AS fair, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(start_time)) / 60000000 AS minutes, start_time, home_won FROM top JOIN g USING (game_id)),
f AS (SELECT * FROM d WHERE fair - implied > 0),
r AS (SELECT f.game_id, f.side, arg_min(s.odds, (s.t, s.vendor, s.odds)) AS recheck_odds FROM f JOIN s ON s.game_id = f.game_id AND s.side = f.side AND s.t > TIMESTAMP '1999-01-01' GROUP BY ALL),
c AS (SELECT f.game_id, f.side, arg_max(s.odds, (s.t, s.odds)) AS closing_odds FROM f JOIN s ON s.game_id = f.game_id AND s.side = f.side AND s.t < f.start_time GROUP BY ALL),
graded AS (SELECT game_id, side, vendor AS book_vendor, odds AS book_odds, round(fair - implied, 9) AS edge, minutes >= 0 AS in_play, round(minutes, 3) AS minutes_from_start, recheck_odds,
  {_IMPLIED.format("recheck_odds")} <= implied AS survived, CASE WHEN home_won IS NOT NULL THEN closing_odds END AS closing_odds, CASE WHEN home_won IS NOT NULL THEN round({_IMPLIED.format("closing_odds")} - implied, 9) END AS clv, CASE WHEN closing_odds IS NOT NULL THEN home_won = (side = 'home') END AS won
FROM f LEFT JOIN r USING (game_id, side) LEFT JOIN c USING (game_id, side))
"""


def _divergence_tables(spark: SparkSession, folder: str) -> tuple:
    """Quotes, venues' prices, games, and the instant at which divergences are looked for."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    odds = {"home": F.col("l_quantity") * 10 - 255, "away": 265 - F.col("l_quantity") * 10}
    quotes = lines.select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("vendor"), F.col("l_shipdate").alias("at"), *[c.cast("int").alias(f"{s}_odds") for s, c in odds.items()])
    games = orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("start_time"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 200_000).alias("home_won"))
    venues = orders.select(F.col("o_orderkey").alias("game_id"), F.lit("pm").alias("venue"), (F.col("o_custkey") % 100 / 100).alias("fair_home"), F.col("o_totalprice").alias("volume"))
    return quotes, venues, games, F.lit("1999-01-01").cast("timestamp_ntz")


@query(f"{_DIVERGENCES} SELECT * FROM graded")
def divergence_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Found at one instant, looked at again at the book's next quote, graded at the close."""
    quotes, venues, games, now = _divergence_tables(spark, folder)
    found = divergence.detect(quotes, venues, games, now, 100_000)
    graded = divergence.grade(divergence.recheck(found, quotes), quotes, games)
    out = graded.select("game_id", "side", "book_vendor", "book_odds", "edge", "in_play", F.round("minutes_from_start", 3).alias("minutes_from_start"), "recheck_odds", "survived", "closing_odds", "clv", "won")
    return rounded(out, 9)


_PLAYS = """WITH e AS (SELECT event_id, event_id // 50 AS game, CASE WHEN user_id % 17 <> 0 THEN user_id % 2 END AS team, event_id % 50 // 10 + 1 AS period, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS points,
  CASE WHEN event_id % 7 <> 0 THEN CAST(floor(value / 10) AS INT) * 60 + CAST(json_extract_string(props, '$.k') AS INT) % 60 END AS left_ FROM events),
s AS (SELECT *, sum(CASE WHEN team = 0 THEN points ELSE 0 END) OVER w AS home, sum(CASE WHEN team = 1 THEN points ELSE 0 END) OVER w AS away FROM e WINDOW w AS (PARTITION BY game ORDER BY event_id))
"""


def _plays(spark: SparkSession, folder: str) -> DataFrame:
    """Events as plays: fifty to a game, ten to a period, points by their kind and a clock."""
    e, k = table(spark, folder, "events"), F.get_json_object("props", "$.k").cast("int")
    points = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "purchase", 1).otherwise(0)
    clock = F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.format_string("%d:%02d", F.floor(F.col("value") / 10).cast("int"), k % 60))
    e = e.select("event_id", F.floor(F.col("event_id") / 50).alias("game"), F.when(F.col("user_id") % 17 != 0, F.col("user_id") % 2).alias("team"), (F.floor(F.col("event_id") % 50 / 10) + 1).alias("period"), points.cast("long").alias("points"), clock.alias("clock"))
    w = Window.partitionBy("game").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumns({n: F.sum(F.when(F.col("team") == t, F.col("points")).otherwise(0)).over(w) for n, t in (("home", 0), ("away", 1))})


@query(f"""{_PLAYS}, c AS (SELECT *, home - away AS m FROM s WHERE points > 0 AND team IS NOT NULL),
l AS (SELECT *, lag(m) OVER w AS b, row_number() OVER w - row_number() OVER (PARTITION BY game, team ORDER BY event_id) AS island FROM c WINDOW w AS (PARTITION BY game ORDER BY event_id)),
r AS (SELECT game, team, max(x) AS largest_run FROM (SELECT game, team, sum(points) AS x FROM l GROUP BY game, team, island) GROUP BY ALL),
g AS (SELECT game, count(*) FILTER (WHERE sign(m) <> sign(b) AND sign(m) <> 0 AND sign(b) <> 0) AS lead_changes, max(abs(m)) AS largest_lead FROM l GROUP BY game)
SELECT game, team, {", ".join(f"sum(points) FILTER (WHERE period = {n}) AS period_{n}_points" for n in (1, 2, 3, 4))}, sum(points) FILTER (WHERE period >= 5) AS overtime_points, sum(points) FILTER (WHERE period >= 4 AND left_ <= 300) AS clutch_points, any_value(largest_run) AS largest_run, any_value(lead_changes) AS lead_changes, any_value(largest_lead) AS largest_lead
FROM c JOIN r USING (game, team) JOIN g USING (game) GROUP BY game, team""")
def play_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return plays.play_aggregate(_plays(spark, folder), "game", "team", "event_id", "period", "clock", "points", "home", "away")


@query(f"""{_PLAYS} SELECT event_id, home AS home_score, away AS away_score, points > 0 AND team IS NOT NULL AS scoring_play, CASE WHEN team IS NOT NULL THEN points ELSE 0 END AS score_value FROM s""")
def running_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores that stand only with the plays that changed them, carried on to all."""
    feed = _plays(spark, folder).select("event_id", "game", F.when((F.col("points") > 0) & F.col("team").isNotNull(), F.format_string("%d - %d", "home", "away")).alias("score"))
    out = plays.running_score(feed, "game", "event_id", "score")
    return out.select("event_id", long("home_score").alias("home_score"), long("away_score").alias("away_score"), "scoring_play", long("score_value").alias("score_value"))


@query(f"""{LOG}, s AS (SELECT user_id, season, ts AS seen, k AS standings_wins FROM log WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-20'), g AS (SELECT * FROM log WHERE event_type = 'click')
SELECT g.event_id, s.standings_wins, s.seen AS standings_observed_at FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.season = s.season AND g.ts > s.seen""")
def standings_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The standings as they were known before each game; never the newest ones, which hold its result."""
    log = game_log(spark, folder)
    known = log.filter("event_type = 'view'").filter(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "season", "ts", F.col("k").alias("wins"), "event_id")
    out = asof.asof_join(log.filter("event_type = 'click'"), known.withColumnRenamed("ts", "seen"), ["user_id", "season"], "ts", "seen", ["wins"], "event_id", prefix="standings_")
    return out.select("event_id", "standings_wins", "standings_observed_at")


@query(f"""{_TEAM} SELECT game_id, team_id, opponent_team_id, CAST(season AS INT) AS season, venue, round(gap / 86400000000.0, 9) AS rest_days, coalesce(gap < 36 * 3600000000, false) AS is_back_to_back FROM r""")
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A strategy's rows without what their own games came to."""
    return drop_targets(QUERIES["situational_baseline"](spark, folder))


@query("""SELECT 'duplicate' AS "check", concat(l_orderkey, '|', l_linenumber) AS key, CAST(l_partkey AS VARCHAR) AS detail FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1""")
def check_duplicate_members(spark: SparkSession, folder: str) -> DataFrame:
    return ql.duplicate_members(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "duplicate")


@query("""SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS above FROM customer""")
def reference_means(spark: SparkSession, folder: str) -> DataFrame:
    """Each point against the unweighted mean of all, which is one row."""
    c = table(spark, folder, "customer")
    mean = c.agg(F.avg("c_acctbal").alias("mean"))
    return rounded(c.join(F.broadcast(mean)).select("c_custkey", (F.col("c_acctbal") - F.col("mean")).alias("above")), 6)


@query(f"""{LOG} SELECT event_id, CAST(coalesce(sum(CASE WHEN value > 40 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS balance FROM log""")
def trailing_balance(spark: SparkSession, folder: str) -> DataFrame:
    """A fold of one's own over each key's earlier rows."""
    fold = h.Fold("balance long", lambda: 0, lambda state: (state,), lambda state, row: state + (1 if row["value"] > 40 else -1))
    return h.trailing_fold(game_log(spark, folder).select("event_id", "ts", "user_id", "value"), h.History(("user_id",), "ts", "event_id"), fold).select("event_id", "balance")
