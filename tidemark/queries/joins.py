"""Joins: star, as-of in all its forms, nearest, either-side, semi and anti, top one of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, markets
from tidemark.operators import relational as rel
from tidemark.queries.catalog import long, query, rounded, table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as quotes for the other events of a user."""
    return _events(spark, folder).filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("quote"), F.col("value").alias("price"))


_QUOTES = "WITH q AS (SELECT user_id, ts AS at, event_id AS quote, value AS price FROM events WHERE event_type = 'purchase') "


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000""")
def star_join(spark: SparkSession, folder: str) -> DataFrame:
    # Nation and region are fixed dimensions of 25 and 5 rows; Spark itself decides about customers by their size.
    orders = table(spark, folder, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    people = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def left_join_condition(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = rel.left_with(table(spark, folder, "customer").select("c_custkey"), orders, ["c_custkey"], F.col("o_orderpriority") == "1-URGENT")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("urgent"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS open_value, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS close_value, min(l_shipdate) AS open_at, max(l_shipdate) AS close_at FROM lineitem GROUP BY ALL)
SELECT * FROM a WHERE close_at > open_at""")
def open_close_pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_extendedprice"))
    return rel.open_close(lines, ["l_partkey", "l_suppkey"], "l_shipdate", "l_extendedprice", "tie")


@query("""SELECT n_nationkey, count(*) AS people FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1""")
def union_all_counts(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n_nationkey")).unionByName(table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey")))
    return keys.join(table(spark, folder, "nation").select("n_nationkey"), "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("people"))


@query("""SELECT s_suppkey, count(*) AS games, count(*) FILTER (WHERE s_suppkey = l_suppkey) AS as_supplier FROM supplier JOIN lineitem ON s_suppkey = l_suppkey OR s_suppkey = l_partkey GROUP BY 1""")
def either_side_join(spark: SparkSession, folder: str) -> DataFrame:
    """A line counts once for each of its two ids that names a supplier; once if both are the same."""
    lines = rel.sides(table(spark, folder, "lineitem").select("l_suppkey", "l_partkey"), {"supplier": {"s_suppkey": "l_suppkey"}, "part": {"s_suppkey": "l_partkey"}})
    once = lines.filter((F.col("side") == "supplier") | (F.col("l_suppkey") != F.col("l_partkey")))
    return once.join(table(spark, folder, "supplier").select("s_suppkey"), "s_suppkey").groupBy("s_suppkey").agg(F.count("*").alias("games"), F.count_if(F.col("side") == "supplier").alias("as_supplier"))


@query("""SELECT l_orderkey, CASE WHEN l_suppkey < l_partkey THEN l_partkey ELSE l_suppkey END AS rival, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = CASE WHEN l_suppkey < l_partkey THEN l_partkey ELSE l_suppkey END GROUP BY ALL""")
def computed_key_join(spark: SparkSession, folder: str) -> DataFrame:
    rival = F.when(F.col("l_suppkey") < F.col("l_partkey"), F.col("l_partkey")).otherwise(F.col("l_suppkey"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", rival.alias("rival"))
    return lines.join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("rival")), "rival").groupBy("l_orderkey", "rival").agg(F.count("*").alias("n"))


@query(f"""{_QUOTES} SELECT e.event_id, q.quote, q.price, q.at AS observed_at FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts > q.at""")
def asof_join(spark: SparkSession, folder: str) -> DataFrame:
    return asof.asof_join(_events(spark, folder), _quotes(spark, folder), ["user_id"], "ts", "at", ["quote", "price"], "quote").select("event_id", "quote", "price", "observed_at")


@query(f"""{_QUOTES} SELECT e.event_id, q.quote, q.price FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts > q.at""")
def asof_join_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a hot key's stream dealt out by days."""
    return asof.asof_join(_events(spark, folder), _quotes(spark, folder), ["user_id"], "ts", "at", ["quote", "price"], "quote", bucket_seconds=86_400).select("event_id", "quote", "price")


@query(f"""{_QUOTES} SELECT e.event_id, q.price AS next_price FROM events e ASOF LEFT JOIN q ON e.user_id = q.user_id AND e.ts < q.at""")
def next_quote(spark: SparkSession, folder: str) -> DataFrame:
    return asof.next_after(_events(spark, folder), _quotes(spark, folder), ["user_id"], "ts", "at", "price", "quote").select("event_id", "next_price")


@query(f"""{_QUOTES}, p AS (SELECT e.event_id, arg_min(q.price, (abs(epoch_us(e.ts) - epoch_us(q.at)), q.at)) AS nearest_price FROM events e JOIN q ON e.user_id = q.user_id AND abs(epoch_us(e.ts) - epoch_us(q.at)) <= 7200000000 GROUP BY 1)
SELECT event_id, nearest_price FROM events LEFT JOIN p USING (event_id)""")
def nearest_within_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    return asof.nearest_within(_events(spark, folder), _quotes(spark, folder), ["user_id"], "ts", "at", "price", 7200, "quote").select("event_id", "nearest_price")


@query("""WITH c AS (SELECT user_id, max(ts) AS cutoff FROM events GROUP BY 1) SELECT user_id, arg_max(value, (ts, event_id)) AS closing_price FROM events JOIN c USING (user_id) WHERE ts < cutoff GROUP BY 1""")
def closing_price(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    cutoffs = events.groupBy("user_id").agg(F.max("ts").alias("cutoff"))
    return markets.closing_price(events.join(cutoffs, "user_id"), ["user_id"], "ts", "value", "cutoff", "event_id")


@query("""WITH q AS (SELECT l_partkey, l_suppkey, l_discount, l_extendedprice, l_shipdate, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= o_orderdate)
SELECT l_partkey, l_suppkey, arg_max(l_discount, (l_shipdate, l_orderkey, l_extendedprice)) AS l_discount, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_extendedprice)) AS l_extendedprice FROM q GROUP BY ALL""")
def last_quote_before_start(spark: SparkSession, folder: str) -> DataFrame:
    starts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    quotes = table(spark, folder, "lineitem").join(starts, "l_orderkey").withColumn("tie", F.struct("l_orderkey", "l_extendedprice"))
    return markets.last_before(quotes, ["l_partkey", "l_suppkey"], "l_shipdate", "o_orderdate", ["l_discount", "l_extendedprice"], "tie")


@query("""WITH p AS (SELECT e.event_id AS event_id, o.event_id AS other, abs(epoch_us(e.ts) - epoch_us(o.ts)) AS gap FROM events e JOIN events o ON e.user_id = o.user_id WHERE e.event_type = 'error' AND o.event_type = 'signup' AND abs(epoch_us(e.ts) - epoch_us(o.ts)) <= 3600000000 * 12)
SELECT event_id, arg_min(other, (gap, other)) AS other FROM p GROUP BY 1""")
def nearest_event(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    signups = events.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("other"))
    return rel.nearest_event(events.filter("event_type = 'error'"), signups, ["user_id"], "ts", "ts", 12 * 3600, "event_id", "other")


_CHECKPOINTS = {"t_minus_7d": 7 * 86_400, "t_minus_24h": 86_400, "t_minus_1h": 3600, "at_start": 0}


@query(f"""{_QUOTES}, o(checkpoint, s) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _CHECKPOINTS.items())}),
m AS (SELECT event_id, user_id, checkpoint, ts - to_seconds(s) AS t FROM events, o WHERE event_type = 'view')
SELECT m.event_id, m.checkpoint, q.price FROM m ASOF LEFT JOIN q ON m.user_id = q.user_id AND m.t > q.at""")
def checkpoint_quotes(spark: SparkSession, folder: str) -> DataFrame:
    views = _events(spark, folder).filter("event_type = 'view'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    quotes = _quotes(spark, folder).withColumn("at", F.col("at").cast("timestamp"))
    return asof.checkpoints(views, quotes, ["user_id"], "ts", "at", "price", "quote", _CHECKPOINTS).select("event_id", "checkpoint", "price")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_large FROM customer""")
def exists_flag(spark: SparkSession, folder: str) -> DataFrame:
    large = table(spark, folder, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct()
    return table(spark, folder, "customer").select("c_custkey").join(large, "c_custkey", "left").select("c_custkey", F.col("has").isNotNull().alias("has_large"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def lateral_latest(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, folder, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.col("o.o_orderkey").alias("o_orderkey"))


@query("""SELECT l_orderkey, l_linenumber, side, team, rival FROM lineitem, LATERAL (VALUES ('part', l_partkey, l_suppkey), ('supplier', l_suppkey, l_partkey)) v(side, team, rival)""")
def unpivot_sides(spark: SparkSession, folder: str) -> DataFrame:
    names = {"part": {"team": "l_partkey", "rival": "l_suppkey"}, "supplier": {"team": "l_suppkey", "rival": "l_partkey"}}
    return rel.sides(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), names).select("l_orderkey", "l_linenumber", "side", "team", "rival")


@query("""SELECT o_custkey, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 9) AS share FROM orders GROUP BY 1""")
def share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    total = orders.agg(F.sum("o_totalprice").alias("total"))  # one row
    own = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("own"))
    return rounded(own.join(F.broadcast(total)).select("o_custkey", (F.col("own") / F.col("total")).alias("share")), 9)


@query("""WITH w AS (SELECT DISTINCT p_partkey, string_split(p_name, ' ')[1] AS first_word FROM part) SELECT a.n_nationkey, count(*) AS parts FROM nation a JOIN w ON a.n_name ILIKE '%' || left(first_word, 1) || '%' GROUP BY 1""")
def substring_join(spark: SparkSession, folder: str) -> DataFrame:
    """Nations whose name holds a part's first letter: counted by letter first, so the loop is over 25 nations and few letters."""
    letters = table(spark, folder, "part").groupBy(F.substring(F.split_part("p_name", F.lit(" "), F.lit(1)), 1, 1).alias("letter")).agg(F.count("*").alias("n"))
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return letters.join(nations, F.expr("n_name ilike concat('%', letter, '%')")).groupBy("n_nationkey").agg(long(F.sum("n")).alias("parts"))


@query("""WITH ids(c_custkey) AS (VALUES (1), (3), (7), (100000000)) SELECT CAST(ids.c_custkey AS BIGINT) AS c_custkey, count(o_orderkey) AS orders FROM ids LEFT JOIN orders ON o_custkey = ids.c_custkey GROUP BY 1""")
def requested_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.sources.tables import requested

    ids = requested(spark, [1, 3, 7, 100_000_000], "c_custkey")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return ids.join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("""SELECT l_orderkey, rank, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 2""")
def top_two_per_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    top = rel.top_per(lines, ["l_orderkey"], 2, F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))
    return top.select("l_orderkey", long("rank").alias("rank"), "l_linenumber", "l_extendedprice")
