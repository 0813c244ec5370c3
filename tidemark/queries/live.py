"""Streams with state, captures written and replayed, tables loaded bucket by bucket, loaders that the guard judges."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.plans.plan_guard import ForbiddenSourceError
from tidemark.queries.captures import _DIVERGENCES, _divergence_tables
from tidemark.queries.catalog import long, query, rounded, table
from tidemark.queries.loads import _NEW, _OLD, _new, _old
from tidemark.sources import replay
from tidemark.sources.buckets import BucketTable
from tidemark.sources.tables import ParquetSource
from tidemark.streaming import incremental as inc
from tidemark.streaming import stateful as st


def _folder(spark: SparkSession, name: str) -> str:
    return f"{staging.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows as they land in a folder, all in one batch: they lie there in no order of time, so the watermark of a
    first batch would make rows of a second one late."""
    landed = _folder(spark, "landed")
    df.write.parquet(landed)
    return inc.landed(spark, landed, df.schema, files_per_trigger=2**31 - 1)


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now."""
    folder = _folder(spark, name)
    inc.to_table(stream, f"{folder}/rows", f"{folder}/marks").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


#: Instants that a watermark of a day behind the newest event has passed.
_PAST = "epoch_us({0}) // 1000 + CASE WHEN epoch_us({0}) % 1000 > 0 THEN 1 ELSE 0 END <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - 86400000"


@query(f"""WITH q AS (SELECT user_id AS key, event_type AS vendor, ts AS t, arg_max(value, event_id) AS v FROM events GROUP BY ALL),
m AS (SELECT DISTINCT key, t FROM q), g AS (SELECT m.key, m.t, q.vendor, q.v, row_number() OVER (PARTITION BY m.key, m.t, q.vendor ORDER BY q.t DESC) AS n FROM m JOIN q ON m.key = q.key AND q.t <= m.t)
SELECT key AS user_id, t AS "at", round(avg(v), 6) AS consensus, round(stddev_samp(v), 6) AS spread, count(*) AS vendors FROM g WHERE n = 1 AND {_PAST.format("t")} GROUP BY ALL""")
def streamed_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of every vendor's latest value after each instant, out of state that is kept for a key."""
    st.use_rocksdb(spark)
    out = _drained(spark, st.running_consensus(_stream(spark, _events(spark, folder)), "user_id", "event_type", "ts", "value", "event_id", "1 day", idle=365 * 86_400), "consensus")
    return rounded(out.withColumn("at", F.col("at").cast("timestamp_ntz")), 6)


@query(_DIVERGENCES.replace("l_suppkey AS vendor", "CAST(l_suppkey AS VARCHAR) AS vendor") + """ SELECT game_id, side, book_vendor, book_odds, edge, recheck_odds, survived, closing_odds, clv, won FROM graded""")
def streamed_divergences(spark: SparkSession, folder: str) -> DataFrame:
    """Divergences found, looked at again and graded as events come, out of a game's state; what batch gives."""
    st.use_rocksdb(spark)
    quotes, venues, games, now = _divergence_tables(spark, folder)
    games = games.withColumn("result_at", F.lit("2010-01-01").cast("timestamp_ntz"))
    clock = games.limit(1).select(F.lit(-1).cast("long").alias("game_id"), F.explode(F.array(F.lit("2020-01-01").cast("timestamp_ntz"), F.lit("2040-01-01").cast("timestamp_ntz"))).alias("start_time"), F.lit(None).cast("boolean").alias("home_won"), F.lit(None).cast("timestamp_ntz").alias("result_at"))
    events = st.events_of(quotes, venues.withColumn("at", now), games.unionByName(clock))
    out = _drained(spark, st.divergences(_stream(spark, events), 100_000, "1 day", patience=20 * 365 * 86_400), "divergences")
    return rounded(out.select("game_id", "side", "book_vendor", "book_odds", "edge", "recheck_odds", "survived", "closing_odds", "clv", "won"), 9)


#: The same where two streams meet: the slower one's watermark, and the two days that a row looks back.
_SEEN = "epoch_us(ts) // 1000 <= (SELECT epoch_us(least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'view'))) // 1000 FROM events) - 259200000"


@query(f"""WITH q AS (SELECT user_id, ts AS seen, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), f AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click' AND {_SEEN})
SELECT f.user_id, f.event_id, f.ts, CASE WHEN f.ts - q.seen <= INTERVAL 48 HOUR THEN q.value END AS value, CASE WHEN f.ts - q.seen <= INTERVAL 48 HOUR THEN q.seen END AS observed_at FROM f ASOF LEFT JOIN q ON f.user_id = q.user_id AND f.ts > q.seen""")
def streamed_freshest(spark: SparkSession, folder: str) -> DataFrame:
    """Each click with the user's newest view of the two days before, as two streams that meet."""
    events = _events(spark, folder)
    fills = _stream(spark, events.filter("event_type = 'click'").select("user_id", "event_id", "ts"))
    views = _stream(spark, events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value", F.col("event_id").alias("tie")))
    out = _drained(spark, st.freshest(fills, views, ["user_id"], "ts", "seen", "value", "tie", "48 hours", "1 day"), "freshest")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "observed_at")})


@query("""SELECT event_type AS provider, max(ts) OVER (PARTITION BY event_type, event_id // 2000) AS captured_at, event_id, user_id, round(value, 6) AS value FROM events""")
def replayed_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Events recorded as captures of up to 2,000 pages, a JSON document each, and replayed from them."""
    replay.register(spark)
    e = table(spark, folder, "events")
    page = F.to_json(F.struct("event_id", "user_id", "value"))
    taken = e.groupBy(F.col("event_type").alias("provider"), F.floor(F.col("event_id") / 2000).alias("part")).agg(F.max(F.col("ts").cast("timestamp")).alias("captured_at"), F.collect_list(page).alias("pages"))
    path = _folder(spark, "captures")
    taken.select("provider", "captured_at", "pages").write.format("captures").mode("append").save(path)
    read = spark.read.format("captures").load(path).filter("error is null")
    read = read.withColumn("b", F.from_json("body", "event_id long, user_id long, value double"))
    return rounded(read.select("provider", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "b.event_id", "b.user_id", "b.value"), 6)


@query(f"""WITH {_OLD}, {_NEW} SELECT o.o_orderkey, o.o_custkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CASE WHEN n.o_orderstatus <> o.o_orderstatus THEN 2 END AS seen FROM old o LEFT JOIN new n USING (o_orderkey)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)""")
def bucket_loads(spark: SparkSession, folder: str) -> DataFrame:
    """A table in buckets: first load, an update of what changes, an insert of what is absent."""
    made = BucketTable(spark, _folder(spark, "orders"), "o_orderkey long, o_custkey long, o_orderstatus string, seen int", ["o_orderkey"], 16)
    blank = F.lit(None).cast("int").alias("seen")
    made.upsert(_old(spark, folder).select("*", blank), ["o_custkey"])
    made.update_changed(_new(spark, folder), ["o_orderstatus"], "seen", F.lit(2))
    made.insert_absent(_new(spark, folder).select("*", blank), ["o_custkey"])
    return made.read()


#: Loaders as somebody might write them, by what the guard must say.
LOADERS = {
    "bounded": "SELECT * FROM {events} WHERE ts < TIMESTAMP_NTZ '2024-01-15'",
    "bounded below": "SELECT user_id, max(at) AS at FROM (SELECT user_id, ts AS at FROM {events}) x WHERE at <= TIMESTAMP_NTZ '2024-01-10' GROUP BY user_id",
    "joined": "SELECT o.o_orderkey FROM {orders} o JOIN {customer} c ON c_custkey = o_custkey AND o_orderdate <= TIMESTAMP_NTZ '1997-01-01'",
    "unbounded": "SELECT * FROM {events}",
    "bounded above": "SELECT * FROM (SELECT user_id, max(ts) AS ts FROM {events} GROUP BY user_id) WHERE ts < TIMESTAMP_NTZ '2024-01-10'",
    "too late": "SELECT * FROM {events} WHERE ts < TIMESTAMP_NTZ '2024-01-20'",
    "present state": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT s_suppkey FROM {supplier})",
}


@query("""SELECT 'bounded' AS loader, true AS allowed, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'bounded below', true, count(DISTINCT user_id) FROM events WHERE ts <= TIMESTAMP '2024-01-10'
UNION ALL SELECT 'joined', true, count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate <= TIMESTAMP '1997-01-01' UNION ALL SELECT unnest(['unbounded', 'bounded above', 'too late', 'present state']), false, NULL""")
def source_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Which loaders the guard lets read, told from their analysed plans, and how much those give."""
    source = ParquetSource(spark, folder, frozenset({"supplier"}), {"events": "ts", "orders": "o_orderdate"})
    out = None
    for name, sql in LOADERS.items():
        try:
            found = source.query(sql, datetime(2024, 1, 15, tzinfo=timezone.utc), {"customer": "segments don't change"}).agg(F.count("*").alias("n")).select(F.lit(name).alias("loader"), F.lit(True).alias("allowed"), "n")
        except ForbiddenSourceError:
            found = spark.range(1).select(F.lit(name).alias("loader"), F.lit(False).alias("allowed"), long(F.lit(None)).alias("n"))
        out = out.unionByName(found) if out is not None else found
    return out

