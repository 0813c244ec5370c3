"""Data-quality checks: each is a DataFrame of violations (check, key, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violations(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def orphans(df: DataFrame, parent: DataFrame, column: str, parent_column: str, check: str) -> DataFrame:
    """Ids that point nowhere, each once (crosswalk entries, foreign keys)."""
    ids = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return _violations(ids.join(parent, F.col(column) == F.col(parent_column), "left_anti"), check, F.col(column), F.lit("no parent"))


def duplicates(df: DataFrame, keys: Sequence[str], ident: str, check: str) -> DataFrame:
    """Keys with several ids; the detail gives how many and the least two, so no list grows."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ident).alias("low"), F.max(ident).alias("high")).filter("n > 1")
    return _violations(g, check, F.concat_ws("|", *keys), F.concat_ws(":", "n", "low", "high"))


def duplicate_members(df: DataFrame, keys: Sequence[str], ident: str, check: str) -> DataFrame:
    """The rows of such keys, one for each id: all of them, however many a key has."""
    several = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1")
    return _violations(df.join(several, list(keys)), check, F.concat_ws("|", *keys), F.col(ident))


def reconcile(totals: DataFrame, parts: DataFrame, key: str, total: str, part: Column, check: str, tolerance: float = 0.0) -> DataFrame:
    """Sums of parts that differ from the stated total (box scores, scoring plays, team totals)."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("__sum"))
    off = totals.join(sums, key).filter(~F.col(total).eqNullSafe(F.col("__sum")) & (F.coalesce(F.abs(F.col(total) - F.col("__sum")), F.lit(float("inf"))) > tolerance))
    return _violations(off, check, F.col(key), F.round(F.col("__sum") - F.col(total), 2))


def last_play(games: DataFrame, plays: DataFrame, key: str, order: Column, score: str, final: str, check: str) -> DataFrame:
    """The last play's score against the final one."""
    last = plays.groupBy(key).agg(F.max_by(score, order).alias("__last"))
    return _violations(games.join(last, key).filter(~F.col("__last").eqNullSafe(F.col(final))), check, F.col(key), F.col("__last"))


def bounds(df: DataFrame, key: Column, rules: Mapping[str, Column], check: str) -> DataFrame:
    """A row for each broken rule (named conditions that must not hold); one pass over the table."""
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return _violations(df.select("*", F.explode(broken).alias("__rule")), check, key, F.col("__rule"))


def counts_per(df: DataFrame, key: str, expected: Mapping[str, int], check: str) -> DataFrame:
    """Groups whose number of rows isn't the expected one, missing groups included."""
    spark = df.sparkSession
    want = spark.createDataFrame(list(expected.items()), "k string, want long")
    have = df.groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("have"))
    off = want.join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have <> want")
    return _violations(off, check, F.col("k"), F.concat_ws("/", "have", "want"))


def after_end(df: DataFrame, ends: DataFrame, key: str, at: str, end: str, ident: str, grace_seconds: int, check: str) -> DataFrame:
    late = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col(end).cast("timestamp"))
    return _violations(df.join(ends.select(key, end), key).filter(late > grace_seconds), check, F.col(ident), late)


def membership(df: DataFrame, dimension: DataFrame, column: str, dim_key: str, bad: Column, ident: str, check: str) -> DataFrame:
    """Rows that point at a dimension row of a kind that must not occur there."""
    return _violations(df.join(dimension.filter(bad).select(dim_key), F.col(column) == F.col(dim_key), "left_semi"), check, F.col(ident), F.col(column))


def run_checks(found: Sequence[DataFrame], acknowledged: DataFrame) -> DataFrame:
    """All violations with ``known``: whether (check, key) is acknowledged."""
    every = reduce(DataFrame.unionByName, found)
    known = acknowledged.select("check", "key", F.lit(True).alias("known"))
    return every.join(known, ["check", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def stale(found: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Acknowledgements that nothing matches any more.

    They are written by hand, so they go to what was found, of which only what they match is dealt out.
    """
    matched = found.select("check", "key").join(F.broadcast(acknowledged.select("check", "key")), ["check", "key"], "left_semi")
    return acknowledged.join(matched, ["check", "key"], "left_anti")
