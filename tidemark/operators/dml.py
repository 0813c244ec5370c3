"""Idempotent loads on plain files: each function gives the new state of a table as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last in ``order`` counts."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return old.alias("o").join(last.alias("n"), _same(keys, "o", "n"), "left_anti").unionByName(last)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key (nulls equal) isn't there; of several the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.alias("n").join(old.alias("o"), _same(keys, "n", "o"), "left_anti")


def fill_null(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Old values stay, nulls are filled from new rows, new keys are added."""
    joined = old.alias("o").join(new.alias("n"), _same(keys, "o", "n"), "full")
    return joined.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in columns])


def update_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], stamp: str, now: Column) -> DataFrame:
    """``columns`` of the old rows that ``new`` (one row for a key) has otherwise, with ``stamp``; rows that are the
    same keep theirs, and keys that aren't there aren't added."""
    joined = old.alias("o").join(new.withColumn("__there", F.lit(True)).alias("n"), _same(keys, "o", "n"), "left")
    differs = F.col("n.__there").isNotNull() & changed({c: F.col(f"o.{c}") for c in columns}, {c: F.col(f"n.{c}") for c in columns})
    made = {c: F.when(differs, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in columns} | {stamp: F.when(differs, now).otherwise(F.col(f"o.{stamp}"))}
    return joined.select(*[made.get(c, F.col(f"o.{c}")).alias(c) for c in old.columns])


def append_changes(log: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """The observations that differ from the one before (nulls equal): what a history table holds."""
    w = Window.partitionBy(*keys).orderBy(at)
    now = F.struct(*values)
    first = F.row_number().over(w) == 1
    return log.withColumn("__new", first | ~now.eqNullSafe(F.lag(now).over(w))).filter("__new").drop("__new")


def stamp_once(old: DataFrame, new: DataFrame, keys: Sequence[str], status: str, final: str, stamp: str, now: Column) -> DataFrame:
    """Status from ``new``; ``stamp`` is set when the status becomes final and then never again."""
    joined = old.alias("o").join(new.select(*keys, status).alias("n"), list(keys), "left")
    became = F.col(f"o.{stamp}").isNull() & (F.col(f"n.{status}") == final) & ~F.col(f"o.{status}").eqNullSafe(F.lit(final))
    made = {status: F.coalesce(F.col(f"n.{status}"), F.col(f"o.{status}")), stamp: F.when(became, now).otherwise(F.col(f"o.{stamp}"))}
    return joined.select(*[made[c].alias(c) if c in made else F.col(c if c in keys else f"o.{c}") for c in old.columns])


def grade_once(observations: DataFrame, grades: DataFrame, keys: Sequence[str], graded: str) -> DataFrame:
    """Grades onto observations that have none."""
    joined = observations.alias("o").join(grades.alias("g"), list(keys), "left")
    return joined.select(*[F.coalesce(f"o.{c}", f"g.{c}").alias(c) if c == graded else F.col(c if c in keys else f"o.{c}") for c in observations.columns])


def replace_groups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete and insert: groups that ``new`` has are taken from it whole."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def remap(df: DataFrame, mapping: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """``column`` with merged ids replaced."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).select(df.columns)


def run_health(runs: DataFrame, job: str, started: str, status: str, now: Column, hours: int = 24) -> DataFrame:
    recent = F.col(started) >= now - F.make_interval(hours=F.lit(hours))
    return runs.groupBy(job).agg(F.max(started).alias("last_started"), F.max_by(status, started).alias("last_status"), F.count_if(recent).alias("recent_runs"), F.count_if(recent & (F.col(status) == "failed")).alias("recent_failures"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Declared column order, header, ISO-8601 times."""
    df.select(*columns).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").csv(path)


def changed(old: Mapping[str, Column], new: Mapping[str, Column]) -> Column:
    out = F.lit(False)
    for k, c in old.items():
        out = out | ~c.eqNullSafe(new[k])
    return out
