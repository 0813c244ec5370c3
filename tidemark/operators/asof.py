"""As-of joins: to each left row the newest right row of its key at a strictly earlier instant.

Both sides are put into one stream and the last right row is carried forward, so each side is sorted once and
nothing is multiplied.  With ``bucket_seconds`` a key's stream is dealt out by time buckets, and each bucket
starts from the last right row of the buckets before it: then no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import dealt


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], tiebreak: str, bucket_seconds: int | None = None, prefix: str = "", tasks: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of ``right`` and the instant they were observed at (``{prefix}observed_at``).

    No earlier row: nulls.  Among right rows of one instant the one with the largest ``tiebreak`` counts.
    Keys must not be null to match.  ``tasks``: see ``dealt``.
    """
    got = F.struct(F.col(right_time).alias("observed_at"), *[F.col(c) for c in columns])
    ours = left.select(*keys, F.struct(*left.columns).alias("__left"), _micros(F.col(left_time)).alias("__at"), F.lit(0).alias("__side"))
    theirs = right.select(*keys, got.alias("__right"), _micros(F.col(right_time)).alias("__at"), F.lit(1).alias("__side"), F.col(tiebreak).alias("__tie"))
    if bucket_seconds:
        bucket = F.floor(F.col("__at") / (bucket_seconds * 1_000_000)).alias("__bucket")
        ours, theirs = ours.select("*", bucket), theirs.select("*", bucket)
        ends = theirs.groupBy(*keys, "__bucket").agg(F.max_by("__right", F.struct("__at", "__tie")).alias("__right"))
        marks = ours.select(*keys, "__bucket").distinct().join(ends, [*keys, "__bucket"], "full")
        before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.withColumn("__right", F.last("__right", ignorenulls=True).over(before)).filter(F.col("__right").isNotNull())
        carried = carried.select(*keys, "__right", F.lit(None).cast("long").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tiebreak].dataType).alias("__tie"), "__bucket")
        theirs = theirs.unionByName(carried)
    parts = [*keys, "__bucket"] if bucket_seconds else list(keys)
    stream = dealt(theirs.unionByName(ours, allowMissingColumns=True), tasks, *parts)
    order = Window.partitionBy(*parts).orderBy(F.col("__at").asc_nulls_first(), "__side", F.col("__tie").asc_nulls_first())
    seen = F.last("__right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = stream.withColumn("__seen", F.when(known, seen)).filter("__side = 0")
    return out.select("__left.*", *[F.col(f"__seen.{c}").alias(f"{prefix}{c}") for c in ["observed_at", *columns]])


def last_at(moments: DataFrame, right: DataFrame, keys: Sequence[str], moment: str, right_time: str, columns: Sequence[str], tiebreak: str, tasks: int | None = None) -> DataFrame:
    """(keys, moment, columns, observed_at): what ``asof_join`` finds for each of ``moments``, as a table of its own;
    moments without an earlier row give no row."""
    met = dealt(right, tasks, *keys).join(dealt(moments.select(*keys, moment), tasks, *keys).distinct(), list(keys)).filter(F.col(right_time) < F.col(moment))
    newest = F.max_by(F.struct(*columns, F.col(right_time).alias("observed_at")), F.struct(right_time, tiebreak)).alias("__newest")
    return met.groupBy(*keys, moment).agg(newest).select(*keys, moment, "__newest.*")


def told_at(left: DataFrame, told: DataFrame, keys: Sequence[str], moment: str, columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of what is told of its keys and moment (``last_at``, ``history.latest_at``), or nulls.
    Only keys are joined by, so that rows which are dealt by them stay where they are."""
    rows = told.groupBy(*keys).agg(F.collect_list(F.struct(F.col(moment).alias("__moment"), *columns)).alias("__told"))
    met = left.join(rows, list(keys), "left")
    one = F.get(F.filter("__told", lambda x: x["__moment"] == F.col(moment)), F.lit(0))
    return met.withColumn("__one", one).select(*left.columns, *[F.col("__one")[c].alias(c) for c in columns])


def _latest(keys: Sequence[str], *order: Column) -> Column:
    """The last right row before a row in ``order``: a running value, where a frame that looks ahead would be
    gone through again for each row."""
    return F.last("__right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def _stream(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, got: Column, tiebreak: str, left_side: int, bucket_seconds: int | None) -> tuple[DataFrame, list[str]]:
    """Both sides in one stream, and by what it is dealt out.  With buckets each one has, beside its own rows, the last
    right row of the buckets before it and the first of those after it."""
    ours = left.select(*keys, F.struct(*left.columns).alias("__left"), _micros(F.col(left_time)).alias("__at"), F.lit(left_side).alias("__side"))
    theirs = right.select(*keys, got.alias("__right"), _micros(F.col(right_time)).alias("__at"), F.lit(1 - left_side).alias("__side"), F.col(tiebreak).alias("__tie"))
    if not bucket_seconds:
        return theirs.unionByName(ours, allowMissingColumns=True), list(keys)
    bucket = F.floor(F.col("__at") / (bucket_seconds * 1_000_000)).alias("__bucket")
    ours, theirs = ours.select("*", bucket), theirs.select("*", bucket)
    row, order = F.struct("__right", "__at", "__side", "__tie"), F.struct("__at", "__tie")
    ends = theirs.groupBy(*keys, "__bucket").agg(F.max_by(row, order).alias("__last"), F.min_by(row, order).alias("__first"))
    marks = ours.select(*keys, "__bucket").distinct().withColumn("__asked", F.lit(True))
    both = marks.alias("m").join(ends.alias("e"), _same_keys([*keys, "__bucket"]), "full")
    both = both.select(*[F.coalesce(f"m.{k}", f"e.{k}").alias(k) for k in [*keys, "__bucket"]], "m.__asked", "e.__last", "e.__first")
    by = Window.partitionBy(*keys)
    earlier = F.last("__last", ignorenulls=True).over(by.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("__first", ignorenulls=True).over(by.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1))
    lent = both.withColumns({"__b": earlier, "__a": later}).filter("__asked").select(*keys, "__bucket", F.explode(F.array("__b", "__a")).alias("__x")).filter("__x is not null")
    theirs = theirs.unionByName(lent.select(*keys, "__x.*", "__bucket"))
    return theirs.unionByName(ours, allowMissingColumns=True), [*keys, "__bucket"]


def _same_keys(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"m.{k}").eqNullSafe(F.col(f"e.{k}"))
    return out


def nearest_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, tolerance_seconds: float, tiebreak: str, bucket_seconds: int | None = None) -> DataFrame:
    """``left`` with the value of the right row closest in time, at most ``tolerance_seconds`` away (ties: the earlier)."""
    got = F.struct(_micros(F.col(right_time)).alias("at"), F.col(value).alias("value"))
    stream, parts = _stream(left, right, keys, left_time, right_time, got, tiebreak, 1, bucket_seconds)
    back = _latest(parts, F.col("__at"), F.col("__side"), F.col("__tie").asc_nulls_first())
    ahead = _latest(parts, F.desc("__at"), F.desc("__side"), F.col("__tie").desc_nulls_last())
    both = stream.withColumns({"__back": back, "__ahead": ahead}).filter("__side = 1")
    gap_b, gap_a = F.col("__at") - F.col("__back.at"), F.col("__ahead.at") - F.col("__at")
    pick = F.when(gap_b.isNotNull() & (gap_a.isNull() | (gap_b <= gap_a)), F.col("__back")).otherwise(F.col("__ahead"))
    near = F.abs(pick["at"] - F.col("__at")) <= int(tolerance_seconds * 1_000_000)
    return both.select("__left.*", F.when(near, pick["value"]).alias(f"nearest_{value}"))


def next_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, tiebreak: str, bucket_seconds: int | None = None) -> DataFrame:
    """``left`` with the first right value at a strictly later instant."""
    stream, parts = _stream(left, right, keys, left_time, right_time, F.struct(F.col(value).alias("value")), tiebreak, 1, bucket_seconds)
    ahead = _latest(parts, F.desc("__at"), F.desc("__side"), F.col("__tie").desc_nulls_first())
    return stream.withColumn("__next", ahead).filter("__side = 1").select("__left.*", F.col("__next.value").alias(f"next_{value}"))


def checkpoints(events: DataFrame, quotes: DataFrame, keys: Sequence[str], start: str, quote_time: str, value: str, tiebreak: str, offsets: dict[str, int]) -> DataFrame:
    """The last quote before each of several moments ahead of an event: offsets in seconds by name."""
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("seconds")) for n, s in offsets.items()])).alias("__o")
    moments = events.select("*", names)
    at = F.timestamp_micros(_micros(F.col(start)) - F.col("__o.seconds").cast("long") * 1_000_000)
    moments = moments.select(*events.columns, F.col("__o.name").alias("checkpoint"), at.alias("checkpoint_at"))
    return asof_join(moments, quotes, keys, "checkpoint_at", quote_time, [value], tiebreak)
