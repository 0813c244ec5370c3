"""What the guard sees in analysed plans: views, aliases, subqueries, bounds, steps that aren't row by row."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import columns
from tidemark.plans import pipeline as p
from tidemark.plans.plan_guard import ForbiddenSourceError, SourceRules
from tidemark.plans.provenance import LeakageError, StepContractError
from tidemark.sources.tables import ParquetSource

AS_OF = datetime(2024, 1, 10, tzinfo=timezone.utc)
RULES = SourceRules({"standings": "it is overwritten"}, {"players.age": "it is today's"}, {"log": "seen"}, {"players": "birth dates don't change"})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    log = spark.range(20).selectExpr("id", "id % 3 as k", "timestamp_seconds(1704067200 + id * 86400) as seen", "to_date(timestamp_seconds(1704067200 + id * 86400)) as day")
    log.write.parquet(f"{folder}/log.parquet")
    spark.range(3).selectExpr("id as k", "30 + id as age", "'p' as name").write.parquet(f"{folder}/players.parquet")
    spark.range(3).selectExpr("id as k", "id as wins").write.parquet(f"{folder}/standings.parquet")
    spark.range(3).selectExpr("id as k").write.parquet(f"{folder}/other.parquet")
    for name in ("log", "players", "standings", "other"):
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    spark.sql("select k as who, wins as w from standings").createOrReplaceTempView("hidden")
    spark.sql("select id, k, seen as at from log where seen <= timestamp '2024-01-05 00:00:00'").createOrReplaceTempView("early")
    return str(folder)


GOOD = [
    "select k, count(*) n from log where seen <= timestamp '2024-01-10 00:00:00' group by k",
    "select * from (select id, seen as s from log) x where x.s < timestamp '2024-01-09'",
    "select l.id, p.name from log l join players p on l.k = p.k where l.seen <= timestamp '2024-01-05' and p.name = 'p'",
    "select id, lag(id) over (partition by k order by at) b from early",
    "with c as (select * from log where timestamp '2024-01-10' >= seen) select a.id, b.id from c a join c b on a.k = b.k",
    "select id from log where seen between timestamp '2024-01-01' and timestamp '2024-01-02' union all select id from log where cast(seen as timestamp) < timestamp '2024-01-03'",
    "select (select max(id) from log where seen < timestamp '2024-01-03') m, name from players",
    "select l.id from log l join players p on l.k = p.k and l.seen <= timestamp '2024-01-04'",
    "select name from players",
]
BAD = [
    ("select * from hidden", "standings"),
    ("select name from players where k in (select who from hidden)", "standings"),
    ("select * from log", "without a bound"),
    ("select * from log where seen <= timestamp '2024-01-11'", "after the as-of"),
    ("select * from log where seen <= timestamp '2024-01-05' or k = 1", "without a bound"),
    ("select * from log where seen >= timestamp '2024-01-05'", "without a bound"),
    ("select * from log where day <= date '2024-01-05'", "without a bound"),
    ("select * from (select *, avg(id) over (partition by k) m from log) where seen <= timestamp '2024-01-05'", "without a bound"),
    ("select * from (select k, max(seen) seen from log group by k) where seen <= timestamp '2024-01-05'", "without a bound"),
    ("select * from (select * from log order by seen desc limit 5) where seen <= timestamp '2024-01-05'", "without a bound"),
    ("select name from players where k in (select k from log)", "without a bound"),
    ("select l.id from log l left join log r on l.k = r.k and r.seen < timestamp '2024-01-03' where l.seen < timestamp '2024-01-03'", "without a bound"),
    ("select id from early union all select id from log", "without a bound"),
    ("select age from players", "players.age"),
    ("select name from players where age > 30", "players.age"),
    ("select * from players", "players.age"),
    ("select name, rank() over (order by age) r from (select name, age from players)", "players.age"),
    ("select * from other", "no reason"),
]


@pytest.mark.parametrize("sql", GOOD)
def test_bounded_plans_pass(spark, tables, sql):
    assert RULES.check(spark.sql(sql), AS_OF).count() > 0


@pytest.mark.parametrize(("sql", "why"), BAD)
def test_others_are_refused(spark, tables, sql, why):
    with pytest.raises(ForbiddenSourceError, match=why):
        RULES.check(spark.sql(sql), AS_OF)


def test_frames_are_looked_at_as_sql_is(spark, tables):
    log = spark.read.parquet(f"{tables}/log.parquet")
    bound = F.lit("2024-01-05").cast("timestamp")
    assert RULES.check(log.withColumnRenamed("seen", "s").filter(F.col("s") <= bound).groupBy("k").count(), AS_OF).count() == 3
    for wrong in (log, log.groupBy("k").agg(F.max("seen").alias("seen")).filter(F.col("seen") <= bound), log.filter(F.col("seen") <= bound).union(log)):
        with pytest.raises(LeakageError):
            RULES.check(wrong, AS_OF)


def test_sources_take_sql(spark, tables):
    source = ParquetSource(spark, tables, frozenset({"standings"}), {"log": "seen"})
    assert source.query("select id from {log} where seen < timestamp '2024-01-03'", AS_OF).count() == 2
    assert source.query("select count(*) c from {players}", AS_OF, {"players": "birth dates"}).first()["c"] == 3
    for sql in ("select id from {log}", "select * from {standings}"):
        with pytest.raises(ForbiddenSourceError):
            source.query(sql, AS_OF)


def _chain(spark, tables, *steps, rules=RULES, bound="2024-01-05"):
    load = lambda _: spark.read.parquet(f"{tables}/log.parquet").filter(F.col("seen") <= F.lit(bound).cast("timestamp")).withColumn("t", F.col("seen"))
    return p.Pipeline("guarded", (p.source("load", load, "seen", ("id", "k", "seen", "day", "t")), *steps), "t", rules=rules)


def test_pipelines_hold_their_sources_to_the_rules(spark, tables):
    context = p.Context(AS_OF)
    assert _chain(spark, tables).run(context).df.count() == 5
    with pytest.raises(ForbiddenSourceError):
        _chain(spark, tables, bound="2024-02-01").run(context)
    # Without rules the rows themselves are what is looked at.
    with pytest.raises(LeakageError, match="late__seen"):
        _chain(spark, tables, bound="2024-02-01", rules=None).run(context)


STEPS = {
    "Window": lambda df: df.withColumn("x", F.lag("id").over(Window.partitionBy("k").orderBy("id"))),
    "Aggregate": lambda df: df.groupBy(*df.columns).agg(F.lit(1).alias("x")),
    "Join": lambda df: df.join(df.groupBy("k").agg(F.max("id").alias("x")), "k"),
    "Generate": lambda df: df.withColumn("x", F.explode(F.array(F.lit(1)))),
    "Filter": lambda df: df.filter("k < 99").withColumn("x", F.lit(1)),
    "MapInArrow": lambda df: df.withColumn("x", F.lit(1)).mapInArrow(lambda b: b, "id long, k long, seen timestamp, day date, t timestamp, x int"),
    "a subquery": lambda df: df.withColumn("x", F.lit(1)).selectExpr("*").where("1 = 1").drop("x").withColumn("x", df.select(F.max("id")).scalar()),
}


@pytest.mark.parametrize("what", STEPS)
def test_row_local_steps_look_at_one_row(spark, tables, what):
    step = p.row_local("step", STEPS[what], ["x"])
    with pytest.raises(StepContractError, match=what if what != "a subquery" else "a subquery|Filter"):
        _chain(spark, tables, step).run(p.Context(AS_OF))


def test_expressions_over_a_row_pass(spark, tables):
    half = F.udf(lambda x: x / 2, "double")
    steps = [
        p.row_local("one", lambda df: df.withColumns({"x": F.col("id") + 1, "y": half("id")}), ["x", "y"]),
        p.row_local("two", lambda df: columns.one_hot(columns.flag_nulls(df, ["x"]), "k", ["0"]), ["x_is_null", "k_is_0", "k_is_other"]),
        p.row_local("none", lambda df: df, []),
        p.keep("some", lambda _: F.col("id") < 3),
    ]
    assert _chain(spark, tables, *steps).run(p.Context(AS_OF)).df.count() == 3
    with pytest.raises(StepContractError, match="Aggregate"):
        _chain(spark, tables, p.Step("keep", p.keep("k", lambda _: F.lit(True)).provenance, lambda df, _: df.distinct().groupBy(*df.columns).agg(F.lit(1).alias("n")).drop("n"))).run(p.Context(AS_OF))
