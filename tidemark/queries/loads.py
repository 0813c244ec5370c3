"""Loads that can be repeated: orders until 1999 are what a table holds, a third of them and later ones arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dml
from tidemark.queries.catalog import long, query, table
from tidemark.streaming import incremental

_OLD = "old AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')"
_NEW = "new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' OR o_orderkey % 3 = 0)"


def _old(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").filter("o_orderdate < timestamp_ntz '1999-01-01'").select("o_orderkey", "o_custkey", "o_orderstatus")


def _new(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")
    return table(spark, folder, "orders").filter("o_orderdate >= timestamp_ntz '1999-01-01' or o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", status)


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert(spark: SparkSession, folder: str) -> DataFrame:
    return dml.upsert(_old(spark, folder), _new(spark, folder), ["o_orderkey"], ["o_custkey"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    return dml.insert_absent(_old(spark, folder), _new(spark, folder), ["o_orderkey"], ["o_custkey"])


_NULLED = "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus"


@query(f"WITH {_OLD}, {_NEW}, k AS (SELECT o_orderkey, {_NULLED} FROM old) SELECT o_orderkey, coalesce(k.o_orderstatus, new.o_orderstatus) AS o_orderstatus FROM k FULL JOIN new USING (o_orderkey)")
def fill_null_merge(spark: SparkSession, folder: str) -> DataFrame:
    old = _old(spark, folder).select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return dml.fill_null(old, _new(spark, folder), ["o_orderkey"], ["o_orderstatus"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def append_on_change(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").withColumn("at", F.struct("ts", "event_id"))
    return dml.append_changes(log, ["user_id"], "at", ["event_type"]).select("user_id", "event_id", "event_type")


@query(f"""WITH {_OLD}, {_NEW} SELECT o.o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CASE WHEN o.o_orderkey % 7 = 0 THEN 1 WHEN n.o_orderstatus = 'F' AND o.o_orderstatus <> 'F' THEN 2 END AS seen
FROM old o LEFT JOIN new n USING (o_orderkey)""")
def stamp_once(spark: SparkSession, folder: str) -> DataFrame:
    old = _old(spark, folder).select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, 1).alias("seen"))
    return dml.stamp_once(old, _new(spark, folder), ["o_orderkey"], "o_orderstatus", "F", "seen", F.lit(2))


@query(f"""WITH {_OLD}, {_NEW} SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderstatus ELSE n.o_orderstatus END AS grade FROM old o LEFT JOIN new n USING (o_orderkey)""")
def grade_once(spark: SparkSession, folder: str) -> DataFrame:
    seen = _old(spark, folder).select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("grade"))
    return dml.grade_once(seen, _new(spark, folder).select("o_orderkey", F.col("o_orderstatus").alias("grade")), ["o_orderkey"], "grade")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)")
def replace_groups(spark: SparkSession, folder: str) -> DataFrame:
    return dml.replace_groups(_old(spark, folder), _new(spark, folder), ["o_custkey"])


@query("SELECT o_orderkey, coalesce(m.keep, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey, c_custkey - 1 AS keep FROM customer WHERE c_custkey % 10 = 9) m ON o_custkey = m.c_custkey")
def remap_ids(spark: SparkSession, folder: str) -> DataFrame:
    merged = table(spark, folder, "customer").filter("c_custkey % 10 = 9").select(F.col("c_custkey").alias("gone"), (F.col("c_custkey") - 1).alias("stays"))
    return dml.remap(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), merged, "o_custkey", "gone", "stays")


@query("""SELECT event_type, max(ts) AS last_started, arg_max(user_id, ts) AS last_status, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS recent_runs, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND value > 40) AS recent_failures FROM events GROUP BY 1""")
def job_health(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events").withColumn("status", F.when(F.col("value") > 40, "failed").otherwise("ok"))
    health = dml.run_health(runs, "event_type", "ts", "status", F.expr("timestamp_ntz '2024-01-30'"))
    return health.drop("last_status").join(runs.groupBy("event_type").agg(F.max_by("user_id", "ts").alias("last_status")), "event_type")


@query("SELECT event_id, value FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20')")
def high_water_mark(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    loaded = events.filter("event_id % 2 = 0 and ts < timestamp_ntz '2024-01-20'")
    return incremental.high_water(events, loaded, "ts").select("event_id", "value")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30 12:00:00'")
def as_of_scan(spark: SparkSession, folder: str) -> DataFrame:
    """What was known at an instant; the bound reaches the scan."""
    from datetime import datetime, timezone

    from tidemark.sources.tables import ParquetSource

    source = ParquetSource(spark, folder, frozenset({"labels"}))
    return source.as_of("orders", datetime(1998, 6, 30, 12, tzinfo=timezone.utc), "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT user_id, count(*) AS delivered, count(DISTINCT event_id) AS kept FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def redelivered(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of which some come twice: each event counts once."""
    events = table(spark, folder, "events").select("user_id", "event_id")
    twice = events.unionByName(events.filter("event_id % 3 = 0")).groupBy("user_id", "event_id").agg(F.count("*").alias("n"))
    return twice.groupBy("user_id").agg(long(F.sum("n")).alias("delivered"), F.count("*").alias("kept"))
