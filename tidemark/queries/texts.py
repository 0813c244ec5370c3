"""Text, names, parsed fields, JSON, HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.functions import text as tx
from tidemark.operators import relational as rel
from tidemark.queries.catalog import long, query, rounded, table

_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH n AS (SELECT DISTINCT p_name, {_TRIGRAMS.format("p_name")} AS t FROM part), s AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS s FROM n a JOIN n b ON a.p_name <> b.p_name)
SELECT a, b, round(s, 9) AS similarity, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM s WHERE s >= 0.3 QUALIFY rank <= 8""")
def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    """The eight most similar names of each, with a similarity of 0.3 at least."""
    names = table(spark, folder, "part").select("p_name").distinct().withColumn("t", tx.trigrams(F.col("p_name")))
    scored = rel.similar_sets(names, "p_name", "t", 0.3)
    return rounded(rel.top_per(scored, ["a"], 8, F.desc("similarity"), F.col("b")).withColumn("rank", long("rank")), 9)


_RULES = (("trade", ("trade", "exch")), ("waive", ("waiv", "release")), ("sign", ("sign", "the")), ("injury", ("injur", "out")))
_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{label}'" for label, ws in _RULES) + " ELSE 'other' END"


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN 'other' ELSE {_CASE} END AS kind FROM documents")
def classify_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.classify(F.col("text"), _RULES).alias("kind"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), '') AS tracked FROM pages""")
def html_fields(spark: SparkSession, folder: str) -> DataFrame:
    html = F.col("html")
    return table(spark, folder, "pages").select("page_id", tx.extract(html, '<html lang="([a-z]+)"').alias("lang"), tx.extract(html, r"track\(([0-9]+)\)").alias("tracked"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


_PARSED = "WITH t AS (SELECT event_id, CAST(floor(value) AS INT) AS a, CAST(json_extract_string(props, '$.k') AS INT) AS b FROM events) "


@query(f"""{_PARSED} SELECT event_id, round(a + (b % 60) / 60.0, 9) AS minutes, a * 60 + b % 60 AS clock, least(a, b) AS made, CASE WHEN a >= b THEN NULL ELSE b END AS attempted, CASE WHEN b % 7 <> 0 THEN b END AS number FROM t""")
def parsed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Clock texts, made-attempted pairs and optional integers, written and parsed again."""
    t = table(spark, folder, "events").select("event_id", F.floor("value").cast("int").alias("a"), F.get_json_object("props", "$.k").cast("int").alias("b"))
    clock = F.format_string("%d:%02d", F.col("a"), F.col("b") % 60)
    pair = tx.made_attempted(F.when(F.col("a") >= F.col("b"), "--").otherwise(F.concat_ws("-", "a", "b")))
    number = tx.optional_int(F.when(F.col("b") % 7 == 0, "--").otherwise(F.col("b").cast("string")))
    out = t.select("event_id", odds.minutes(clock).alias("minutes"), odds.clock_seconds(clock).alias("clock"), F.coalesce(pair["made"], F.col("b")).alias("made"), pair["attempted"].alias("attempted"), number.alias("number"))
    return rounded(out, 9)


@query("""SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents""")
def folded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, of whatever script."""
    return table(spark, folder, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


_ALIASES = {"automobile": "cars", "building": "houses"}


@query("""WITH k AS (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer), r(key, id) AS (VALUES ('cars', 1), ('building', 2), ('houses', 3), ('machinery', 4))
SELECT c_custkey, CAST(arg_min(id, p) AS INT) AS id FROM (SELECT c_custkey, id, 0 AS p FROM k JOIN r ON s = key UNION ALL SELECT c_custkey, id, 1 FROM k JOIN r ON key = CASE s WHEN 'automobile' THEN 'cars' WHEN 'building' THEN 'houses' END) GROUP BY 1""")
def name_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The first rung on which a name is known: as it is, by alias, turned round, and that by alias."""
    known = spark.createDataFrame([("cars", 1), ("building", 2), ("houses", 3), ("machinery", 4)], "key string, id int")
    rungs = table(spark, folder, "customer").select("c_custkey", F.explode(tx.name_candidates(F.col("c_mktsegment"), _ALIASES)).alias("c")).select("c_custkey", "c.*")
    return rungs.join(known, "key").groupBy("c_custkey").agg(F.min_by("id", "priority").alias("id"))


@query("""SELECT o_orderkey, CAST(CASE WHEN date_diff('day', DATE '1998-02-01', make_date(1998, month(o_orderdate), least(day(o_orderdate), 28))) > 60 THEN make_date(1997, month(o_orderdate), least(day(o_orderdate), 28)) ELSE make_date(1998, month(o_orderdate), least(day(o_orderdate), 28)) END AS VARCHAR) AS day FROM orders""")
def inferred_year(spark: SparkSession, folder: str) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", tx.year_wrap(F.month(date), F.least(F.dayofmonth(date), F.lit(28)), F.to_date(F.lit("1998-02-01"))).cast("string").alias("day"))


@query("""SELECT l_orderkey, l_partkey, max(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS A, max(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY ALL""")
def pivot_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rel.pivot_pairs(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey"], "l_returnflag", "l_extendedprice", ["A", "R"])


@query("""WITH r AS (SELECT conv_id, role, count(*) AS n, arg_max(text, turn) AS last FROM conversations GROUP BY ALL) SELECT conv_id, role, n, md5(last) AS last_md5 FROM r""")
def conversation_roles(spark: SparkSession, folder: str) -> DataFrame:
    last = F.md5(F.encode(F.max_by("text", "turn"), "utf-8"))
    return table(spark, folder, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), last.alias("last_md5"))
