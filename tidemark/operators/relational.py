"""Relational compositions that have no function of their own in Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in ``order`` (DISTINCT ON): an explicit order, never an arbitrary row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def by_precedence(df: DataFrame, keys: Sequence[str], source: str, precedence: Sequence[str], *then: Column) -> DataFrame:
    """One row for each key from the most trusted source there is; unnamed sources come last."""
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(precedence)], F.lit(len(precedence)))
    return first_by(df, keys, rank, *then)


def sides(df: DataFrame, names: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """A row for each side of an event: ``names`` gives by side the source column of each new column.

    Turns joins on "either side's id" into an equi-join.
    """
    one = [F.struct(F.lit(side).alias("side"), *[F.col(c).alias(n) for n, c in own.items()]) for side, own in names.items()]
    return df.select("*", F.explode(F.array(*one)).alias("__s")).select(*df.columns, "__s.*")


def open_close(df: DataFrame, keys: Sequence[str], time: str, value: str, tiebreak: str) -> DataFrame:
    """First and last value of each key, where the last is later than the first; one pass instead of a self-join."""
    at = F.struct(time, tiebreak)
    out = df.groupBy(*keys).agg(F.min_by(value, at).alias("open_value"), F.max_by(value, at).alias("close_value"), F.min(time).alias("open_at"), F.max(time).alias("close_at"))
    return out.filter("close_at > open_at")


def histogram2d(df: DataFrame, x: str, y: str, dx: float, dy: float, **measures: Column) -> DataFrame:
    """Counts (and ``measures``) on a grid of cells with the given widths."""
    cell = lambda c, d: (F.floor(F.col(c) / F.lit(d)) * d).cast("double")
    return df.groupBy(cell(x, dx).alias("x_bin"), cell(y, dy).alias("y_bin")).agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])


def ratio(num: Column, den: Column) -> Column:
    """Null, not an error or zero, where the denominator is zero or null."""
    return F.when(den != 0, num / den)


def left_with(left: DataFrame, right: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """Left join on ``keys`` and a condition on the right side that must not drop left rows."""
    return left.join(right.filter(where), list(keys), "left")


def nearest_event(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, window_seconds: int, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): the right event nearest in time, at most ``window_seconds`` away; ties to the smaller id.

    Time is cut into buckets as long as the window, and an event meets those of its own and both neighbouring
    ones, never all of its key.
    """
    width = max(1, window_seconds) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = right.select(*keys, micros(right_time).alias("__rt"), F.col(right_id).alias("__rid")).withColumn("__bucket", F.floor(F.col("__rt") / width))
    around = F.explode(F.array(*[F.floor(F.col("__lt") / width) + k for k in (-1, 0, 1)])).alias("__bucket")
    ours = left.select(*keys, F.col(left_id).alias("__lid"), micros(left_time).alias("__lt")).select("*", around)
    gap = F.abs(F.col("__lt") - F.col("__rt"))
    near = ours.join(r, [*keys, "__bucket"]).withColumn("__gap", gap).filter(F.col("__gap") <= window_seconds * 1_000_000)
    return near.groupBy(F.col("__lid").alias(left_id)).agg(F.min_by("__rid", F.struct("__gap", "__rid")).alias(right_id))


def top_per(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pivot_pairs(df: DataFrame, keys: Sequence[str], side: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row for each key with a column for each named side's value."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(side) == n, F.col(value))).alias(n) for n in names])


def similar_sets(df: DataFrame, ident: str, items: str, least: float) -> DataFrame:
    """(a, b, similarity): ordered pairs of rows whose sets (arrays without repeats) have a Jaccard similarity of
    ``least`` at least.

    Sets as similar as that share an item among the first n - ceil(least * n) + 1 of each, in any one order.
    Items are ordered by how rare they are, so common ones, which would bring everything together, are last and
    mostly never joined on.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(items).alias("items")).filter(F.size("items") > 0)
    each = rows.select("id", F.explode("items").alias("item"))
    often = each.groupBy("item").agg(F.count("*").alias("n"))
    ordered = each.join(often, "item").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    size = F.size("items")
    first = F.slice("items", 1, size - F.ceil(size * least - 1e-9).cast("int") + 1)
    keyed = ordered.select("id", size.alias("n"), F.explode(first).alias("item"))
    a, b = keyed.withColumnsRenamed({"id": "a", "n": "na"}), keyed.withColumnsRenamed({"id": "b", "n": "nb"})
    close = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    pairs = a.join(b, "item").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    sets = ordered.select("id", "items")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "ia"}), "a").join(sets.withColumnsRenamed({"id": "b", "items": "ib"}), "b")
    shared = F.size(F.array_intersect("ia", "ib"))
    scored = both.withColumn("shared", shared).select("a", "b", (F.col("shared") / (F.size("ia") + F.size("ib") - F.col("shared"))).alias("similarity")).filter(F.col("similarity") >= least)
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
