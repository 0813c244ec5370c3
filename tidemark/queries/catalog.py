"""Where queries register themselves, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql``: None where SQL has no words for it."""

    def keep(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a table that a task gets in a shuffle.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """Tasks for a table's rows: their number is in the footers, so no row is read."""
    return math.ceil(df.count() / TASK_ROWS)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def game_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log of games: ten-day seasons, a weight from the JSON, a result."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.floor(F.dayofmonth("ts") / 10).cast("int").alias("season"), (F.col("value") > 40).alias("won"))


#: The same in SQL, to be followed by a query.
LOG = """WITH log AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CAST(floor(day(ts) / 10) AS INT) AS season, value > 40 AS won
  FROM events)
"""
