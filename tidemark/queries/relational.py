"""Aggregates, precedence, bins, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import markets
from tidemark.operators import relational as rel
from tidemark.queries.catalog import LOG, game_log, long, query, rounded, table

PRECEDENCE = ("1-URGENT", "2-HIGH")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n,
  min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL""")
def grouped_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
    )


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent_total FROM orders GROUP BY 1""")
def filtered_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("o_orderstatus")
    urgent = F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(s == "F").alias("final"), F.count_if(s == "O").alias("open"), F.round(urgent, 2).alias("urgent_total"))


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, round(avg(l_extendedprice), 5) AS mean_price FROM lineitem GROUP BY 1 HAVING count(*) >= 100""")
def having_distinct(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.avg("l_extendedprice").alias("mean_price"), F.count("*").alias("n"))
    return rounded(out.filter("n >= 100").drop("n"), 5)


@query("""SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1""")
def last_value_by(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 6""")
def ordered_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of an order's lines, which are bounded by the order."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"), F.count("*").alias("n"))
    return lines.filter("n > 6").select("l_orderkey", F.concat_ws(",", F.col("p").cast("array<string>")).alias("parts"))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) = 1""")
def source_precedence(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return rel.by_precedence(orders, ["o_custkey"], "o_orderpriority", PRECEDENCE, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""WITH d AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) = 1)
SELECT o_custkey, count(*) AS games, round(avg(o_totalprice), 7) AS mean_points FROM d GROUP BY 1 HAVING count(*) >= 5 ORDER BY mean_points DESC, o_custkey LIMIT 25""")
def leaders(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplicated by precedence, averaged, and the best 25 with enough games: the limit is the report."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    one = rel.by_precedence(orders, ["o_custkey", "o_orderdate"], "o_orderpriority", PRECEDENCE, F.col("o_orderkey"))
    out = one.groupBy("o_custkey").agg(F.count("*").alias("games"), F.round(F.avg("o_totalprice"), 7).alias("mean_points")).filter("games >= 5")
    return out.orderBy(F.desc("mean_points"), "o_custkey").limit(25)


@query("""WITH v AS (SELECT l_partkey, l_suppkey, arg_max(l_discount, (l_shipdate, l_orderkey, l_extendedprice)) AS line FROM lineitem GROUP BY ALL)
SELECT l_partkey, round(avg(line), 9) AS consensus, round(stddev_samp(line), 9) AS spread, round(median(line), 9) AS mid, count(*) AS vendors FROM v GROUP BY 1""")
def closing_consensus(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_extendedprice")).alias("line"))
    return rounded(last.groupBy("l_partkey").agg(F.avg("line").alias("consensus"), F.stddev_samp("line").alias("spread"), F.median("line").alias("mid"), F.count("*").alias("vendors")), 9)


@query("""WITH v AS (SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_shipdate, l_orderkey, l_extendedprice)) AS line FROM lineitem GROUP BY ALL), c AS (SELECT l_partkey, avg(line) AS line FROM v GROUP BY 1),
g AS (SELECT l_suppkey, sign(l_quantity - c.line) AS d FROM lineitem JOIN c USING (l_partkey))
SELECT l_suppkey, count(*) FILTER (WHERE d > 0) AS covers, count(*) FILTER (WHERE d < 0) AS misses, count(*) FILTER (WHERE d = 0) AS pushes, round(count(*) FILTER (WHERE d > 0) / nullif(count(*) FILTER (WHERE d <> 0), 0), 6) AS cover_rate FROM g GROUP BY 1""")
def betting_record(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    last = lines.groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_extendedprice")).alias("line"))
    consensus = last.groupBy("l_partkey").agg(F.avg("line").alias("line"))
    graded = lines.select("l_partkey", "l_suppkey", "l_quantity").join(consensus, "l_partkey").withColumn("d", F.signum(F.col("l_quantity") - F.col("line")))
    d = F.col("d")
    out = graded.groupBy("l_suppkey").agg(F.count_if(d > 0).alias("covers"), F.count_if(d < 0).alias("misses"), F.count_if(d == 0).alias("pushes"))
    return rounded(out.withColumn("cover_rate", rel.ratio(F.col("covers"), F.col("covers") + F.col("misses"))))


@query("""SELECT CAST(floor(p_size / 10.0) * 10 AS DOUBLE) AS x_bin, CAST(floor(p_retailprice / 50.0) * 50 AS DOUBLE) AS y_bin, count(*) AS n, count(*) FILTER (WHERE p_type = 'ECONOMY') AS makes FROM part GROUP BY ALL""")
def shot_chart(spark: SparkSession, folder: str) -> DataFrame:
    return rel.histogram2d(table(spark, folder, "part"), "p_size", "p_retailprice", 10.0, 50.0, makes=F.count_if(F.col("p_type") == "ECONOMY"))


@query("""SELECT p_brand, p_type, count(*) AS attempts, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS share FROM part GROUP BY p_brand, p_type""")
def zone_shares(spark: SparkSession, folder: str) -> DataFrame:
    zones = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("attempts"))
    return rounded(zones.withColumn("share", F.col("attempts") / F.sum("attempts").over(Window.partitionBy("p_brand"))))


@query("""SELECT l_suppkey, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS rate, round(36 * sum(l_quantity) / nullif(sum(l_extendedprice), 0), 9) AS per_36 FROM lineitem GROUP BY 1""")
def ratio_of_sums(spark: SparkSession, folder: str) -> DataFrame:
    p, q = F.sum("l_extendedprice"), F.sum("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.round(rel.ratio(p, q), 6).alias("rate"), F.round(rel.ratio(36 * q, p), 9).alias("per_36"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM customer) AS customers, (SELECT max(o_orderdate) FROM orders) AS newest, (SELECT count(DISTINCT user_id) FROM events) AS users""")
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("newest"))
    lines = table(spark, folder, "lineitem").agg(F.count("*").alias("lines"))
    people = table(spark, folder, "customer").agg(F.count("*").alias("customers"))
    users = table(spark, folder, "events").agg(F.countDistinct("user_id").alias("users"))
    # One row each.
    return orders.join(F.broadcast(lines)).join(F.broadcast(people)).join(F.broadcast(users)).select("orders", "lines", "customers", "newest", "users")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 300000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500""")
def recent_games(spark: SparkSession, folder: str) -> DataFrame:
    """A listing is capped at 500 rows: the limit is the feature."""
    final = table(spark, folder, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 300_000))
    return final.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) AS best_vendor, max(l_extendedprice) AS best_price FROM lineitem GROUP BY 1""")
def best_price(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_extendedprice", -F.col("l_suppkey"))).alias("best_vendor"), F.max("l_extendedprice").alias("best_price"))


@query("""WITH n AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, arg_max(l_suppkey, (n, -l_suppkey)) AS s FROM n GROUP BY 1)
SELECT l.l_orderkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice FROM lineitem l JOIN s ON l.l_orderkey = s.l_orderkey AND l.l_suppkey = s.s""")
def preferred_source(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    counts = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    best = counts.groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("n", -F.col("l_suppkey"))).alias("l_suppkey"))
    return lines.join(best, ["l_orderkey", "l_suppkey"])


@query("""SELECT DISTINCT c_mktsegment, c_nationkey FROM customer""")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query(f"""{LOG}, s AS (SELECT user_id, season, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses, sum(value) AS pts FROM log GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, season ORDER BY ts DESC, event_id DESC) AS n FROM log), t AS (SELECT user_id, season, count(*) FILTER (WHERE won) AS last10_wins FROM r WHERE n <= 10 GROUP BY ALL)
SELECT user_id, season, wins, losses, round(wins / (wins + losses), 6) AS pct, last10_wins, round(pts, 2) AS points FROM s JOIN t USING (user_id, season)""")
def standings(spark: SparkSession, folder: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id", "season").orderBy(F.desc("ts"), F.desc("event_id")))
    log = game_log(spark, folder).withColumn("n", n)
    won = F.col("won")
    out = log.groupBy("user_id", "season").agg(F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.count_if(won & (F.col("n") <= 10)).alias("last10_wins"), F.round(F.sum("value"), 2).alias("points"))
    return rounded(out.withColumn("pct", F.col("wins") / (F.col("wins") + F.col("losses")))).select("user_id", "season", "wins", "losses", "pct", "last10_wins", "points")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS all_statuses FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def rollup_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("all_statuses")).select("o_orderstatus", "o_orderpriority", "n", "all_statuses")


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def intersect_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""WITH d AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
SELECT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b, count(*) AS meetings, round(sum(a.value - b.value), 4) AS margin FROM d a JOIN d b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def unordered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Meetings of each pair of types; a user has one row for each type, so pairs are bounded by the types."""
    one = rel.first_by(table(spark, folder, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    a = one.select("user_id", F.col("event_type").alias("a"), F.col("value").alias("av"))
    b = one.select("user_id", F.col("event_type").alias("b"), F.col("value").alias("bv"))
    return a.join(b, "user_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("meetings"), F.round(F.sum(F.col("av") - F.col("bv")), 4).alias("margin"))


@query("""SELECT l_returnflag AS position, l_suppkey AS opponent, count(*) AS games, round(avg(l_quantity), 6) AS allowed, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(avg(l_quantity), 9), l_suppkey) AS rank,
  round(avg(avg(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS group_mean, count(*) OVER (PARTITION BY l_returnflag) AS group_size FROM lineitem GROUP BY l_returnflag, l_suppkey""")
def defence_by_position(spark: SparkSession, folder: str) -> DataFrame:
    allowed = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("position"), F.col("l_suppkey").alias("opponent")).agg(F.count("*").alias("games"), F.round(F.avg("l_quantity"), 9).alias("allowed"))
    return rounded(markets.group_rank(allowed, ["position"], "allowed", "opponent").withColumn("rank", long("rank")))


@query("""SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'out' WHEN o_orderstatus = 'P' THEN 'at_risk' ELSE 'likely' END AS bucket, count(*) AS players, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 1) AS DOUBLE) AS minutes FROM orders GROUP BY ALL""")
def absence_summary(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.functions.text import status_bucket

    words = F.when(F.col("o_orderstatus") == "F", "Out").when(F.col("o_orderstatus") == "P", "Questionable").otherwise("Probable")
    orders = table(spark, folder, "orders").withColumn("bucket", status_bucket(words)).withColumn("minutes", F.col("o_totalprice").cast("decimal(18,2)"))
    return markets.absences(orders, ["o_custkey"], "bucket", ["minutes"]).withColumn("minutes", F.col("minutes").cast("double"))
