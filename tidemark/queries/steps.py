"""Row-local steps, encodings, scaling and the quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import columns as c
from tidemark.operators import quality as ql
from tidemark.operators import style
from tidemark.operators.history import dealt
from tidemark.queries.catalog import LOG, game_log, long, query, rounded, table, tasks


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with labels, where there are any: nulls from a left join."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


_LABELLED = "WITH d AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)) "


@query(f"{_LABELLED} SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, quality IS NULL AS quality_is_null FROM d")
def fill_and_flag_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return c.fill_nulls(c.flag_nulls(_labelled(spark, folder), ["quality"]), {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic", "quality_is_null")


@query(f"{_LABELLED} SELECT doc_id FROM d WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def drop_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    return c.drop_nulls(_labelled(spark, folder), ["quality", "toxic"]).select("doc_id")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def coerce_types(spark: SparkSession, folder: str) -> DataFrame:
    out = c.coerce(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), {"o_totalprice": "decimal(12,2)", "o_custkey": "string"})
    return c.coerce(out, {"o_totalprice": "double"})


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1")
def deduplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return c.deduplicate(table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey", "o_orderdate"], F.col("o_orderkey"))


@query(f"{_LABELLED} SELECT doc_id, coalesce(lang = 'en', false) AS lang_is_en, coalesce(lang = 'fr', false) AS lang_is_fr, coalesce(lang NOT IN ('en', 'fr'), false) AS lang_is_other FROM d")
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return c.one_hot(_labelled(spark, folder), "lang", ["en", "fr"]).select("doc_id", "lang_is_en", "lang_is_fr", "lang_is_other")


@query("SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL")
def observed_categories(spark: SparkSession, folder: str) -> DataFrame:
    return c.observed_categories(table(spark, folder, "orders"), "o_orderstatus")


@query("SELECT o_orderkey, round((o_totalprice - 250000) / 1000, 6) AS o_totalprice_scaled FROM orders")
def scale_given(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(c.scale(table(spark, folder, "orders"), {"o_totalprice": (250_000.0, 1000.0)}).select("o_orderkey", "o_totalprice_scaled"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice_scaled FROM orders")
def scale_fitted(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(c.fit_scale(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_scaled"))


@query(f"""{LOG} SELECT event_id, round(value - k, 6) AS margin, value > k AS won, CASE WHEN value > k THEN 'home' ELSE 'away' END AS side, value - k >= 15 AS blowout_win, value - k <= -15 AS blowout_loss, abs(value - k) <= 5 AS close_game,
  round((value + k) / 2, 6) AS pace_mean, least(value, k) AS pace_min, greatest(value, k) AS pace_max, round(abs(value - k), 6) AS pace_gap FROM log""")
def row_local_profile(spark: SparkSession, folder: str) -> DataFrame:
    log = game_log(spark, folder).drop("won")
    margin, won = c.outcome(F.col("value"), F.col("k"))
    made = {"margin": margin, "won": won, "side": c.home_away(won), **c.margin_profile(margin), **c.pair_profile(F.col("value"), F.col("k"), "pace")}
    return rounded(log.withColumns(made).select("event_id", *made))


@query("""WITH p AS (SELECT l_orderkey, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS a, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS b, sum(l_quantity) FILTER (WHERE l_linenumber = 3) AS c, sum(l_quantity) FILTER (WHERE l_linenumber = 4) AS d, max(l_tax) AS clutch FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(a / (a+b+c+d), 6) AS period_1_share, round(b / (a+b+c+d), 6) AS period_2_share, round(c / (a+b+c+d), 6) AS period_3_share, round(d / (a+b+c+d), 6) AS period_4_share, round((c+d) / (a+b+c+d), 6) AS second_half_share, round(clutch / (a+b+c+d), 6) AS clutch_share FROM p""")
def scoring_profile(spark: SparkSession, folder: str) -> DataFrame:
    q = [F.sum(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).alias(f"q{i}") for i in range(1, 5)]
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*q, F.max("l_tax").alias("clutch"))
    made = c.scoring_profile([F.col(f"q{i}") for i in range(1, 5)], F.col("clutch"))
    return rounded(orders.withColumns(made).select("l_orderkey", *made))


@query("""WITH o AS (SELECT l_orderkey, max(l_extendedprice) AS run, max(l_quantity) AS lead, count(*) - 6 AS ot, count(DISTINCT l_suppkey) AS changes, sum(l_quantity) AS points FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN lead > 0 THEN round(run / lead, 9) END AS run_per_lead, ot > 0 AS went_to_overtime, CASE WHEN points > 0 THEN round(100 * changes / points, 9) END AS lead_changes_per_100 FROM o""")
def game_volatility(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("run"), F.max("l_quantity").alias("lead"), (F.count("*") - 6).alias("ot"), F.countDistinct("l_suppkey").alias("changes"), F.sum("l_quantity").alias("points"))
    made = c.volatility(*[F.col(x) for x in ("run", "lead", "ot", "changes", "points")])
    return rounded(orders.withColumns(made).select("l_orderkey", *made), 9)


@query(f"""{LOG} SELECT event_id, round(value - k, 6) AS divergence, round(value - 50, 6) AS movement, round(abs(value - k), 6) AS abs_divergence, round(k - value, 6) AS edge FROM log""")
def market_divergence(spark: SparkSession, folder: str) -> DataFrame:
    made = {**c.market_divergence(F.col("value"), F.col("k"), F.lit(50)), "edge": c.line_edge(F.col("k"), F.col("value"))}
    return rounded(game_log(spark, folder).withColumns(made).select("event_id", *made))


@query("""WITH s AS (SELECT stddev_samp(l_quantity) AS a, stddev_samp(l_discount) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sqrt(pow((l_quantity - l_linenumber) / a, 2) + pow((l_discount - l_tax) / b, 2)), 6) AS style_distance, round(sqrt((pow((l_quantity - l_linenumber) / 10, 2) + pow((l_discount - l_tax) / 0.1, 2)) / 2), 6) AS style_volatility FROM lineitem, s""")
def style_distance(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    out = c.style_distance(lines, [("l_quantity", "l_linenumber"), ("l_discount", "l_tax")])
    swing = c.style_volatility([(F.col("l_quantity"), F.col("l_linenumber"), 10.0), (F.col("l_discount"), F.col("l_tax"), 0.1)])
    return rounded(out.withColumn("style_volatility", swing).drop("l_quantity", "l_discount", "l_tax").withColumns({x: F.col(x) for x in ("l_extendedprice",)}))


@query("""WITH v AS (SELECT vec_id, label, embedding[1] AS x, embedding[2] AS y FROM embeddings), m AS (SELECT label, avg(x::DOUBLE) mx, stddev_samp(x::DOUBLE) sx, avg(y::DOUBLE) my, stddev_samp(y::DOUBLE) sy FROM v GROUP BY 1)
SELECT vec_id, round((x::DOUBLE - mx) / sx, 5) AS x_z, round((y::DOUBLE - my) / sy, 5) AS y_z FROM v JOIN m ON v.label IS NOT DISTINCT FROM m.label""")
def z_scores(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return rounded(style.standardise(e, ["x", "y"], ["label"]).select("vec_id", "x_z", "y_z"), 5)


_ENDS = "WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0) "


@query(f"""{_ENDS}, p AS (SELECT q.vec_id, e.vec_id AS neighbour, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label = q.label)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank, neighbour, round(distance, 5) AS distance FROM p QUALIFY rank <= 5""")
def nearest_in_style(spark: SparkSession, folder: str) -> DataFrame:
    """A stated set of queries (ids divisible by 20) against all vectors of their group."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    out = style.neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "v", 5, ["label"])
    return rounded(out.withColumn("rank", long("rank")), 5)


@query("""SELECT q.vec_id, round(min(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 5) AS uniqueness FROM embeddings q JOIN embeddings e ON e.label <> q.label GROUP BY 1""")
def uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's distance to the nearest one of another label."""
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return rounded(style.uniqueness(e, e, "vec_id", "label", "v"), 5)


_PARTS = """o AS (SELECT DISTINCT 'orphan' AS "check", CAST(l_orderkey AS VARCHAR) AS key, 'no parent' AS detail FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F'))"""


@query(f"WITH {_PARTS} SELECT * FROM o")
def check_orphans(spark: SparkSession, folder: str) -> DataFrame:
    live = table(spark, folder, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey")
    return ql.orphans(table(spark, folder, "lineitem"), live, "l_orderkey", "o_orderkey", "orphan")


_DUPLICATES = "SELECT 'duplicate' AS \"check\", concat(l_orderkey, '|', l_linenumber) AS key, concat(count(*), ':', min(l_partkey), ':', max(l_partkey)) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"


@query(_DUPLICATES)
def check_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return ql.duplicates(dealt(lines, tasks(lines), "l_orderkey"), ["l_orderkey", "l_linenumber"], "l_partkey", "duplicate")


_TOTALS = "SELECT 'totals' AS \"check\", CAST(o_orderkey AS VARCHAR) AS key, CAST(sum(CAST(l_quantity AS BIGINT)) - o_custkey AS VARCHAR) AS detail FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey HAVING abs(sum(CAST(l_quantity AS BIGINT)) - o_custkey) > 500"


@query(_TOTALS)
def check_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key_"), F.col("o_custkey").alias("total"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key_"), "l_quantity")
    n = tasks(lines)
    return ql.reconcile(dealt(orders, n, "key_"), dealt(lines, n, "key_"), "key_", "total", F.col("l_quantity").cast("long"), "totals", 500)


@query("""WITH l AS (SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS last FROM lineitem GROUP BY 1)
SELECT 'last play' AS "check", CAST(o_orderkey AS VARCHAR) AS key, CAST(last AS VARCHAR) AS detail FROM orders JOIN l ON l_orderkey = o_orderkey WHERE last IS DISTINCT FROM o_custkey""")
def check_last_play(spark: SparkSession, folder: str) -> DataFrame:
    games = table(spark, folder, "orders").select(F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("final"))
    plays = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "game")
    return ql.last_play(games, plays, "game", F.struct("l_shipdate", "l_linenumber", "l_partkey"), "l_partkey", "final", "last play")


@query("""SELECT 'bounds' AS "check", concat(l_orderkey, '|', l_linenumber) AS key, rule AS detail FROM lineitem, LATERAL (VALUES ('high discount', l_discount > 0.09), ('free', l_tax = 0), ('large', l_quantity > 49)) r(rule, broken) WHERE broken""")
def check_bounds(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"high discount": F.col("l_discount") > 0.09, "free": F.col("l_tax") == 0, "large": F.col("l_quantity") > 49}
    return ql.bounds(table(spark, folder, "lineitem"), F.concat_ws("|", "l_orderkey", "l_linenumber"), rules, "bounds")


_EXPECTED = {"F": 5000, "O": 5000, "P": 5000, "X": 1}


@query(f"""WITH w(k, want) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _EXPECTED.items())}), h AS (SELECT o_orderstatus AS k, count(*) AS have FROM orders GROUP BY 1)
SELECT 'count' AS "check", k AS key, concat(coalesce(have, 0), '/', want) AS detail FROM w LEFT JOIN h USING (k) WHERE coalesce(have, 0) <> want""")
def check_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ql.counts_per(table(spark, folder, "orders"), "o_orderstatus", _EXPECTED, "count")


@query("""SELECT 'after end' AS "check", concat(l_orderkey, '|', l_linenumber) AS key, CAST(CAST(epoch(l_shipdate) - epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS detail FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE epoch(l_shipdate) - epoch(o_orderdate) > 86400 * 1000""")
def check_after_end(spark: SparkSession, folder: str) -> DataFrame:
    ends = table(spark, folder, "orders").select(F.col("o_orderkey").alias("game"), "o_orderdate")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "game").withColumn("id", F.concat_ws("|", "game", "l_linenumber"))
    return ql.after_end(lines, ends, "game", "l_shipdate", "o_orderdate", "id", 86_400 * 1000, "after end")


@query("""SELECT 'member' AS "check", CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS detail FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1""")
def check_membership(spark: SparkSession, folder: str) -> DataFrame:
    # 25 nations.
    return ql.membership(table(spark, folder, "customer"), table(spark, folder, "nation"), "c_nationkey", "n_nationkey", F.col("n_regionkey") == 1, "c_custkey", "member")


def _acknowledged(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("member", "1"), ("member", "no such key"), ("count", "F")], "check string, key string")


_KNOWN = "a(\"check\", key) AS (VALUES ('member', '1'), ('member', 'no such key'), ('count', 'F'))"
_FOUND = f"""f AS (SELECT 'member' AS "check", CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS detail FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL {_DUPLICATES} UNION ALL {_TOTALS})"""


def _found(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [check_membership(spark, folder), check_duplicates(spark, folder), check_totals(spark, folder)]


@query(f"""WITH {_KNOWN}, {_FOUND} SELECT f.*, a.key IS NOT NULL AS known FROM f LEFT JOIN a ON a."check" = f."check" AND a.key = f.key""")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return ql.run_checks(_found(spark, folder), _acknowledged(spark))


@query(f"""WITH {_KNOWN}, {_FOUND} SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE a."check" = f."check" AND a.key = f.key)""")
def stale_acknowledgements(spark: SparkSession, folder: str) -> DataFrame:
    found = _found(spark, folder)
    return ql.stale(found[0].unionByName(found[1]).unionByName(found[2]), _acknowledged(spark))
