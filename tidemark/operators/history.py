"""What was known before: trailing aggregates that never see rows of the same instant.

All of them sort a key's rows once, and several of them one after another share that sort.  An aggregate over rows
before is taken at the first row of each instant, where those rows are all strictly earlier, and handed to the other
rows of that instant.  Only
bounded frames or running aggregates are used, so no history is held as an array.  What ``together`` is asked for
shares its passes.  With ``block_rows`` no task has more than so many rows of a key (see ``hot``).
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import hot


@dataclass(frozen=True)
class History:
    """``keys``: whose history; ``time``: event time; ``tiebreak``: order among rows of one instant."""

    keys: Sequence[str]
    time: str
    tiebreak: str

    @property
    def instant(self) -> Column:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    def blocks(self, df: DataFrame, rows: int, *more: str) -> hot.Blocks:
        return hot.Blocks(df, [*self.keys, *more], self.instant, self.tiebreak, rows)

    def by(self, *more: str):
        return Window.partitionBy(*self.keys, *more)

    def rows(self, *more: str):
        return self.by(*more).orderBy(self.time, self.tiebreak)

    def before(self, *more: str):
        """All rows before a row; at the first row of an instant those at strictly earlier instants."""
        return self.rows(*more).rowsBetween(Window.unboundedPreceding, -1)

    def peers(self, *more: str):
        """The rows of an instant, in the order that ``rows`` has: no further sort."""
        return self.by(*more, self.time).orderBy(self.tiebreak)


def _add(df: DataFrame, history: History, made: Mapping[str, Column], more: Sequence[str] = ()) -> DataFrame:
    """Hands aggregates that hold for the first row of an instant to all of its rows."""
    packed = df.withColumn("__made", F.struct(*[c.alias(n) for n, c in made.items()]))
    packed = packed.withColumn("__made", F.first("__made").over(history.peers(*more)))
    return packed.select(*df.columns, *[F.col("__made")[n].alias(n) for n in made])


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ``tasks`` parts, if that is more than a shuffle of the session has: then a task's share
    stays the same however many rows there are.  Windows, joins and groups by these keys or more go on with it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartition(tasks, *keys) if tasks and tasks > least else df


@dataclass(frozen=True)
class Past:
    """What is known before each row, to be made with others in one pass (``together``).

    ``adds``: the columns in the end; ``made``: aggregates of a window over a key's rows in order, as they hold at
    the first row of an instant, in parts by ``more`` too; ``apart`` and then ``steps``: columns of each row that they
    need, the former by windows of their own; ``then``: columns out of ``made``.
    """

    adds: tuple[str, ...]
    made: Callable[[Any], Mapping[str, Column]]
    more: tuple[str, ...] = ()
    apart: Callable[[], Mapping[str, Column]] | None = None
    steps: Callable[[Any], Mapping[str, Column]] | None = None
    then: Callable[[], Mapping[str, Column]] | None = None


def together(df: DataFrame, history: History, pasts: Sequence[Past], ends: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """``df`` with the columns of all ``pasts``, and as each of ``ends`` the last strictly earlier instant: one sort and
    one pass for all that has the same parts, while rows are still narrow."""
    out = dealt(df, tasks, history.keys[0])
    if ends:
        last = Past(tuple(ends), lambda rows: {"__ended": F.max(history.time).over(rows.rowsBetween(Window.unboundedPreceding, -1))}, then=lambda: {e: F.col("__ended") for e in ends})
        pasts = [*pasts, last]
    for more in sorted({x.more for x in pasts}, key=len, reverse=True):
        mine, rows = [x for x in pasts if x.more == more], history.rows(*more)
        for columns in ({n: c for x in mine if x.apart for n, c in x.apart().items()}, {n: c for x in mine if x.steps for n, c in x.steps(rows).items()}):
            out = out.withColumns(columns) if columns else out
        out = _add(out, history, {n: c for x in mine for n, c in x.made(rows).items()}, more)
    made = {n: c for x in pasts if x.then for n, c in x.then().items()}
    out = out.withColumns(made) if made else out
    return out.select(*df.columns, *[c for x in pasts for c in x.adds])


def ended(df: DataFrame, history: History, name: str) -> DataFrame:
    """The last strictly earlier instant, where a window over what was before ends."""
    return _add(df, history, {name: F.max(history.time).over(history.before())})


def _bounded(df: DataFrame, history: History, n: int, made: Callable[[Any], Mapping[str, Column]], block_rows: int | None) -> DataFrame:
    """Hands out ``made`` (of an ordered window, looking at most ``n`` rows back), from blocks if asked for."""
    if not block_rows:
        return _add(df, history, made(history.rows()))
    names = list(made(history.rows()))
    blocks = history.blocks(df, block_rows).bounded(n, lambda w: {f"__made_{k}": c for k, c in made(w).items()})
    return blocks.handed({k: F.col(f"__made_{k}") for k in names})


def rolling(df: DataFrame, history: History, values: Sequence[str], n: int, label: str = "roll", block_rows: int | None = None) -> DataFrame:
    """Mean of each value over the last ``n`` earlier rows (nulls skipped), rows in the window, and its end."""
    return _bounded(df, history, n, past_rolling(history, values, n, label).made, block_rows)


def past_rolling(history: History, values: Sequence[str], n: int, label: str) -> Past:
    def made(rows) -> dict[str, Column]:
        frame = rows.rowsBetween(-n, -1)
        means = {f"{v}_{label}": F.avg(F.col(v).cast("double")).over(frame) for v in values}
        return {**means, f"{label}_rows": F.count(F.lit(1)).over(frame), f"{label}_window_end": F.max(history.time).over(frame)}

    return Past((*[f"{v}_{label}" for v in values], f"{label}_rows", f"{label}_window_end"), made)


def expanding(df: DataFrame, history: History, values: Sequence[str], season: str | None = None, label: str = "mean", block_rows: int | None = None) -> DataFrame:
    """Mean over all earlier rows, of the same season if one is named."""
    more = [season] if season else []
    if block_rows:
        cells = {f"__s_{v}": (F.sum, F.col(v).cast("double")) for v in values} | {f"__n_{v}": (F.sum, F.col(v).isNotNull().cast("long")) for v in values}
        blocks = history.blocks(df, block_rows, *more).running({**cells, "__rows": (F.sum, F.lit(1).cast("long")), "__end": (F.max, F.col(history.time))})
        made = {f"{v}_{label}": F.when(F.col(f"__n_{v}") > 0, F.col(f"__s_{v}") / F.col(f"__n_{v}")) for v in values}
        return blocks.handed({**made, f"{label}_rows": F.coalesce("__rows", F.lit(0)), f"{label}_window_end": F.col("__end")})
    return together(df, history, [past_expanding(history, values, season, label)])


def past_expanding(history: History, values: Sequence[str], season: str | None, label: str) -> Past:
    def made(rows) -> dict[str, Column]:
        w = rows.rowsBetween(Window.unboundedPreceding, -1)
        means = {f"{v}_{label}": F.avg(F.col(v).cast("double")).over(w) for v in values}
        return {**means, f"{label}_rows": F.count(F.lit(1)).over(w), f"{label}_window_end": F.max(history.time).over(w)}

    return Past((*[f"{v}_{label}" for v in values], f"{label}_rows", f"{label}_window_end"), made, (season,) if season else ())


def exponential(df: DataFrame, history: History, value: str, half_life: float, floor: float = 1e-6, label: str = "ewm", block_rows: int | None = None) -> DataFrame:
    """Weights halve every ``half_life`` rows back, counted over null rows too, and end below ``floor``."""
    lookback, asked = _lookback(half_life, floor), past_exponential(value, half_life, floor, label)
    if not block_rows:
        return together(df, history, [asked])
    blocks = history.blocks(df, block_rows).bounded(lookback, asked.steps, lambda w: {f"__made_{k}": c for k, c in asked.made(w).items()})
    return blocks.handed({k: F.col(f"__made_{k}") for k in asked.adds})


def _lookback(half_life: float, floor: float) -> int:
    return max(1, math.floor(math.log(floor) / math.log(0.5 ** (1 / half_life))) + 1)


def past_exponential(value: str, half_life: float, floor: float, label: str) -> Past:
    """Sums over a bounded frame, no list of it: a row is weighed by its place in a span of rows that is as long as the
    frame, and as a frame meets two spans at most, those of even and of odd number are summed for themselves."""
    n, decay, x = _lookback(half_life, floor), 0.5 ** (1 / half_life), F.col(value).cast("double")
    at, cell = f"__place_{label}", lambda k, name: f"__{name}{k}_{label}"

    def steps(rows) -> dict[str, Column]:
        place = F.row_number().over(rows)
        weight = F.pow(F.lit(decay), n - place % n)
        own = lambda k, c: F.when((F.floor(place / n) % 2 == k) & x.isNotNull(), c)
        return {at: place, **{cell(k, name): own(k, c) for k in (0, 1) for name, c in (("num", weight * x), ("den", weight))}}

    def made(rows) -> dict[str, Column]:
        frame, even = rows.rowsBetween(-n, -1), F.floor(F.col(at) / n) % 2 == 0
        # From the span's end to the row before this one; the span before is one span further.
        here, there = F.pow(F.lit(decay), F.col(at) % n - n - 1), F.pow(F.lit(decay), F.col(at) % n - 1)

        def total(name: str) -> Column:
            sums = [F.coalesce(F.sum(cell(k, name)).over(frame), F.lit(0.0)) for k in (0, 1)]
            return sums[0] * F.when(even, here).otherwise(there) + sums[1] * F.when(even, there).otherwise(here)

        num, den = total("num"), total("den")
        return {f"{value}_{label}": F.when(den > 0, num / den), f"{label}_rows": F.count(F.lit(1)).over(frame)}

    return Past((f"{value}_{label}", f"{label}_rows"), made, steps=steps)


def dispersion(df: DataFrame, history: History, value: str, n: int, label: str = "sd", block_rows: int | None = None) -> DataFrame:
    """Sample standard deviation over the last ``n`` earlier rows; null under two values."""
    return _bounded(df, history, n, past_dispersion(value, n, label).made, block_rows)


def past_dispersion(value: str, n: int, label: str) -> Past:
    return Past((f"{value}_{label}",), lambda rows: {f"{value}_{label}": F.stddev_samp(F.col(value).cast("double")).over(rows.rowsBetween(-n, -1))})


def slope(df: DataFrame, history: History, value: str, n: int, label: str = "slope", block_rows: int | None = None) -> DataFrame:
    """Least-squares slope of the last ``n`` rows' values on their place among those that aren't null."""
    asked = past_slope(value, n, label)
    if block_rows:
        blocks = history.blocks(df, block_rows).bounded(n, asked.steps, asked.made)
        return blocks.handed({f"{value}_{label}": F.col(f"{value}_{label}")})
    return together(df, history, [asked])


def past_slope(value: str, n: int, label: str) -> Past:
    at = f"__place_{label}"

    def steps(rows) -> dict[str, Column]:
        # Places may be counted from anywhere: a block counts its own.
        return {at: F.count(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)).cast("double")}

    def made(rows) -> dict[str, Column]:
        frame = rows.rowsBetween(-n, -1)
        return {f"{value}_{label}": F.when(F.count(value).over(frame) >= 2, F.regr_slope(F.col(value).cast("double"), F.col(at)).over(frame))}

    return Past((f"{value}_{label}",), made, steps=steps)


def split_rolling(df: DataFrame, history: History, value: str, where: Column, n: int, label: str = "split") -> DataFrame:
    """Mean over the last ``n`` earlier rows for which ``where`` holds."""
    flagged = df.withColumn("__flag", F.coalesce(where, F.lit(False)))
    return together(flagged, history, past_splits(history, value, "__flag", n, {label: True})).drop("__flag")


def past_splits(history: History, value: str, flag: str, n: int, labels: Mapping[str, bool]) -> list[Past]:
    """Means over the last ``n`` earlier rows where ``flag`` is what a label says; all labels share a sort."""
    mean, many = f"__{flag}_mean{n}", f"__{flag}_rows{n}"

    def apart() -> dict[str, Column]:
        frame = history.rows(flag).rowsBetween(-(n - 1), 0)
        return {mean: F.avg(F.col(value).cast("double")).over(frame), many: F.count(F.lit(1)).over(frame)}

    def past(label: str, wanted: bool) -> Past:
        def made(rows) -> dict[str, Column]:
            w = rows.rowsBetween(Window.unboundedPreceding, -1)
            return {f"__last_{label}": F.last(F.when(F.col(flag) == wanted, F.struct(F.col(mean).alias("mean"), F.col(many).alias("rows"))), ignorenulls=True).over(w)}

        def then() -> dict[str, Column]:
            got = F.col(f"__last_{label}")
            return {f"{value}_{label}": got["mean"], f"{label}_rows": F.coalesce(got["rows"], F.lit(0)).cast("long")}

        return Past((f"{value}_{label}", f"{label}_rows"), made, apart=apart, then=then)

    return [past(label, wanted) for label, wanted in labels.items()]


def streak(df: DataFrame, history: History, won: Column, season: str | None = None, name: str = "streak", block_rows: int | None = None) -> DataFrame:
    """Signed length of the run of wins or losses before the row; a null result breaks it."""
    more = [season] if season else []
    if block_rows:
        blocks = history.blocks(df.withColumn("__won", won), block_rows, *more)
        blocks.columns = df.columns
        blocks = blocks.bounded(1, lambda w: {"__last": F.lag("__won").over(w), "__changed": ~F.col("__won").eqNullSafe(F.lag("__won").over(w))})
        # Where the run of the row before began: the last place, up to that row, at which the result changed.
        blocks = blocks.running({"__since": (F.max, F.when(F.col("__changed"), F.col("__rank"))), "__upto": (F.max, F.col("__rank"))})
        run = F.col("__rank") - F.coalesce("__since", F.lit(0))
        signed = F.when(F.col("__upto").isNull() | F.col("__last").isNull(), 0).when(F.col("__last"), run).otherwise(-run)
        return blocks.handed({name: signed.cast("long")})
    return together(df.withColumn("__won", won), history, [past_streak("__won", season, name)]).drop("__won")


def past_streak(won: str, season: str | None, name: str) -> Past:
    rank, last, since = (f"__{x}_{name}" for x in ("rank", "last", "since"))

    def steps(rows) -> dict[str, Column]:
        before = F.lag(won).over(rows)
        return {rank: F.row_number().over(rows), last: before, since: ~F.col(won).eqNullSafe(before)}

    def made(rows) -> dict[str, Column]:
        # Where the run of the row before began: the last place, up to that row, at which the result changed.
        began = F.max(F.when(F.col(since), F.col(rank))).over(rows.rowsBetween(Window.unboundedPreceding, -1))
        run = F.col(rank) - F.coalesce(began, F.lit(1))
        return {name: F.when(F.col(last).isNull(), 0).when(F.col(last), run).otherwise(-run).cast("long")}

    return Past((name,), made, (season,) if season else (), steps=steps)


def season_to_date(df: DataFrame, history: History, won: Column, season: str, block_rows: int | None = None) -> DataFrame:
    """Games, wins and share before the row in its season; the share counts games without a result."""
    if block_rows:
        one = F.lit(1).cast("long")
        blocks = history.blocks(df, block_rows, season).running({"__games": (F.sum, one), "__wins": (F.sum, F.when(won, one).otherwise(0))})
        games, wins = F.coalesce("__games", F.lit(0)), F.coalesce("__wins", F.lit(0))
        return blocks.handed({"prior_games": games, "prior_wins": wins, "prior_pct": F.when(games > 0, wins / games)})
    return together(df, history, [past_season(won, season)])


def past_season(won: Column, season: str) -> Past:
    def made(rows) -> dict[str, Column]:
        w = rows.rowsBetween(Window.unboundedPreceding, -1)
        games, wins = F.count(F.lit(1)).over(w), F.coalesce(F.sum(F.when(won, 1).otherwise(0)).over(w), F.lit(0))
        return {"prior_games": games, "prior_wins": wins, "prior_pct": F.when(games > 0, wins / games)}

    return Past(("prior_games", "prior_wins", "prior_pct"), made, (season,))


def rest(df: DataFrame, history: History, back_to_back_hours: float = 36) -> DataFrame:
    """Days since the previous distinct instant, and whether it was less than so many hours ago."""
    return together(df, history, [past_rest(history, back_to_back_hours)])


def past_rest(history: History, back_to_back_hours: float = 36) -> Past:
    def then() -> dict[str, Column]:
        gap = history.instant - F.unix_micros(F.col("__before").cast("timestamp"))
        return {"rest_days": gap / 86_400_000_000, "is_back_to_back": F.coalesce(gap < int(back_to_back_hours * 3_600_000_000), F.lit(False))}

    return Past(("rest_days", "is_back_to_back"), lambda rows: {"__before": F.max(history.time).over(rows.rowsBetween(Window.unboundedPreceding, -1))}, then=then)


def rolling_rate(df: DataFrame, history: History, num: str, den: str, n: int, scale: float = 1.0, label: str = "rate", block_rows: int | None = None) -> DataFrame:
    """scale * sum(num) / sum(den) over the last ``n`` earlier rows where both are known; null for a zero sum."""
    both = F.col(num).isNotNull() & F.col(den).isNotNull()

    def made(rows) -> dict[str, Column]:
        top, bottom = (F.sum(F.when(both, F.col(c).cast("double"))).over(rows.rowsBetween(-n, -1)) for c in (num, den))
        return {label: F.when(bottom != 0, scale * top / bottom)}

    return _bounded(df, history, n, made, block_rows)


def rolling_weighted(df: DataFrame, history: History, value: str, weight: str, n: int, label: str = "wmean", block_rows: int | None = None) -> DataFrame:
    """sum(w x) / sum(w) over the last ``n`` earlier rows with w > 0 and x known."""
    good = F.col(value).isNotNull() & (F.col(weight) > 0)
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")

    def made(rows) -> dict[str, Column]:
        frame = rows.rowsBetween(-n, -1)
        bottom = F.sum(F.when(good, w)).over(frame)
        return {label: F.when(bottom > 0, F.sum(F.when(good, w * x)).over(frame) / bottom)}

    return _bounded(df, history, n, made, block_rows)


def rolling_share(df: DataFrame, history: History, value: str, pool: Sequence[str], n: int, label: str = "share", block_rows: int | None = None) -> DataFrame:
    """Own sum over the sum of all rows of the same pool (such as team and game), both over the last ``n`` rows."""
    pooled = df.withColumn("__pool", F.sum(value).over(Window.partitionBy(*pool)))
    return rolling_rate(pooled, history, value, "__pool", n, label=label, block_rows=block_rows).drop("__pool")


def head_to_head(df: DataFrame, history: History, won: Column, margin: str, prefix: str = "h2h", season: str | None = None, n: int | None = None) -> DataFrame:
    """Games, wins, share and mean margin of the same ordered pair (``history.keys``) before the row."""
    return together(df, history, [past_head_to_head(won, margin, prefix, season, n)])


def past_head_to_head(won: Column, margin: str, prefix: str, season: str | None = None, n: int | None = None) -> Past:
    def made(rows) -> dict[str, Column]:
        w = rows.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)
        games, wins = F.count(F.lit(1)).over(w), F.coalesce(F.sum(F.when(won, 1).otherwise(0)).over(w), F.lit(0))
        return {f"{prefix}_games": games, f"{prefix}_wins": wins, f"{prefix}_pct": F.when(games > 0, wins / games), f"{prefix}_margin": F.avg(margin).over(w)}

    return Past(tuple(f"{prefix}_{x}" for x in ("games", "wins", "pct", "margin")), made, (season,) if season else ())


def mirror(df: DataFrame, event: Sequence[str], own: str, opponent: str, columns: Sequence[str], prefix: str = "opponent_", tasks: int | None = None) -> DataFrame:
    """The opponent's columns of the same event; null where its row is missing, or an id is null.

    Both rows of a pair meet in one window, so ``df`` is gone through once however often it is mirrored.  They are a
    pair when each names the other; of repeated rows of one side the largest counts.
    """
    us, them = F.col(own), F.col(opponent)
    pair = Window.partitionBy(*event, F.least(us, them), F.greatest(us, them))
    known = us.isNotNull() & them.isNotNull()
    for c in event:
        known = known & F.col(c).isNotNull()
    told = F.struct(*[F.col(c) for c in columns])
    smaller, larger = F.max(F.when(us <= them, told)).over(pair), F.max(F.when(us >= them, told)).over(pair)
    met = dealt(df, tasks, *event).withColumn("__other", F.when(known, F.when(us <= them, larger).otherwise(smaller)))
    return met.select(*df.columns, *[F.col("__other")[c].alias(f"{prefix}{c}") for c in columns])


def running_latest(df: DataFrame, group: Sequence[str], vendor: str, time: str, value: str, tiebreak: str, median: bool = True) -> DataFrame:
    """After each instant the mean, sample deviation, number and (if asked for) median of every vendor's latest
    value so far; a null value leaves the one before it in force.

    Each quote is what it changes in its group's count, sum and sum of squares, so that running sums give the
    mean and deviation; a deviation that is lost in the last digits of the values is 0.  A median has no such
    sums: for it a group's rows go through a task in order, which holds one value for each vendor.
    """
    by_vendor = Window.partitionBy(*group, vendor).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    by_group = Window.partitionBy(*group).orderBy(time)
    latest = df.groupBy(*group, vendor, time).agg(F.max_by(F.col(value).cast("double"), tiebreak).alias("__v"))
    if median:
        return _medians(latest, group, vendor, time)
    # Values are taken from the group's first one, which costs no digits.
    shifted = latest.withColumn("__base", F.first("__v", ignorenulls=True).over(by_group)).withColumn("__x", F.col("__v") - F.col("__base"))
    was = F.last("__x", ignorenulls=True).over(by_vendor)
    known = F.col("__x").isNotNull()
    steps = shifted.withColumn("__was", was)
    change = {
        "__n": F.when(known & F.col("__was").isNull(), 1).otherwise(0),
        "__s": F.when(known, F.col("__x") - F.coalesce("__was", F.lit(0.0))).otherwise(0.0),
        "__ss": F.when(known, F.col("__x") ** 2 - F.coalesce(F.col("__was") ** 2, F.lit(0.0))).otherwise(0.0),
    }
    moments = steps.groupBy(*group, time).agg(*[F.sum(c).alias(n) for n, c in change.items()], F.max("__base").alias("__base"))
    upto = by_group.rowsBetween(Window.unboundedPreceding, 0)
    sums = moments.withColumns({n: F.sum(n).over(upto) for n in change}).filter("__n > 0")
    n, s, ss = F.col("__n"), F.col("__s"), F.col("__ss")
    left = ss - s * s / n
    spread = F.when(n > 1, F.when(left > 1e-14 * (ss + n * F.col("__base") ** 2), F.sqrt(left / (n - 1))).otherwise(0.0))
    return sums.select(*group, time, (F.col("__base") + s / n).alias("consensus"), spread.alias("spread"), n.cast("long").alias("vendors"))


def latest_at(moments: DataFrame, quotes: DataFrame, group: Sequence[str], moment: str, vendor: str, time: str, value: str, tiebreak: str, tasks: int | None = None) -> DataFrame:
    """(group, moment, consensus, spread, vendors, observed_at): what ``running_latest`` says last before each of
    ``moments``; those before which there is no value give no row.

    Quotes meet the moments first, so that those from a moment on go before anything is grouped, and all that follows
    goes on with the one shuffle by ``group``.
    """
    met = dealt(quotes, tasks, *group).join(dealt(moments.select(*group, moment), tasks, *group).distinct(), list(group)).filter(F.col(time) < F.col(moment))
    once = met.groupBy(*group, moment, vendor, time).agg(F.max_by(F.col(value).cast("double"), tiebreak).alias("__v"))
    latest = once.groupBy(*group, moment, vendor).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(time))).alias("__v"), F.max(time).alias("observed_at"))
    out = latest.groupBy(*group, moment).agg(F.avg("__v").alias("consensus"), F.stddev_samp("__v").alias("spread"), F.count("__v").alias("vendors"), F.max("observed_at").alias("observed_at"))
    return out.filter("vendors > 0")


MOMENTS = ("consensus", "spread", "median", "vendors")


def _medians(latest: DataFrame, group: Sequence[str], vendor: str, time: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(time, vendor)
    marked = latest.select(*group, time, F.col(vendor).cast("string").alias("__vendor"), "__v", (F.row_number().over(order) == 1).alias("__first"), (~F.col(time).eqNullSafe(F.lead(time).over(order)) | F.lead(F.lit(1)).over(order).isNull()).alias("__last"))
    shown = [*group, time]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str | None, float] = {}
        ranked: list[float] = []
        for batch in batches:
            made: list[tuple] = []
            kept: list[int] = []
            for i, (who, x, first, last) in enumerate(zip(*(batch[c].to_pylist() for c in ("__vendor", "__v", "__first", "__last")), strict=True)):
                if first:
                    now, ranked = {}, []
                if x is not None and x == x:
                    if who in now:
                        del ranked[bisect.bisect_left(ranked, now[who])]
                    now[who] = x
                    bisect.insort(ranked, x)
                if last and ranked:
                    kept.append(i)
                    made.append(_moments(ranked))
            own = batch.select(shown).take(pa.array(kept, pa.int64()))
            new = [pa.array([m[i] for m in made], pa.int64() if c == "vendors" else pa.float64()) for i, c in enumerate(MOMENTS)]
            yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*shown, *MOMENTS])

    dealt = marked.repartition(*group).sortWithinPartitions(*group, time, F.desc("__first"), "__last")
    kinds = dict(latest.dtypes)
    return dealt.mapInArrow(rows, ", ".join([*[f"`{c}` {kinds[c]}" for c in shown], "consensus double", "spread double", "median double", "vendors long"]))


def _moments(ranked: list[float]) -> tuple[float, float | None, float, int]:
    """Mean, sample deviation, median and number."""
    n = len(ranked)
    mean = math.fsum(ranked) / n
    spread = math.sqrt(math.fsum((x - mean) ** 2 for x in ranked) / (n - 1)) if n > 1 else None
    return mean, spread, (ranked[(n - 1) // 2] + ranked[n // 2]) / 2, n


def running_median(df: DataFrame, history: History, value: str, name: str, block_rows: int = 65_536) -> DataFrame:
    """Median of all values of the key up to the row, itself included; nulls count for nothing.

    Spark's median takes no ordered frame.  Numpy looks at blocks of ``block_rows`` rows (see ``hot``); the keys' sizes
    are counted before, by a job.
    """
    return hot.running_median(df, history.keys, history.instant, history.tiebreak, value, name, block_rows)


@dataclass(frozen=True)
class Fold:
    """``schema``: columns that are added; ``start``: a key's first state; ``emit``: their values before a row;
    ``observe``: the state after it (``row``: the row's values by name)."""

    schema: str
    start: Callable[[], Any]
    emit: Callable[[Any], tuple]
    observe: Callable[[Any, Mapping[str, Any]], Any]


def trailing_fold(df: DataFrame, history: History, fold: Fold) -> DataFrame:
    """A fold of one's own over each key's strictly earlier rows: rows of one instant see the same state.

    Python for each row, so it is for what no window aggregate says; a task holds one state and one instant's rows.
    Columns go through as they are.
    """
    order = history.rows()
    new = (F.row_number().over(order) == 1).alias("__first")
    begins = (~history.instant.eqNullSafe(F.lag(history.instant).over(order)) | (F.row_number().over(order) == 1)).alias("__begins")
    marked = df.select("*", new, begins)
    names, added = df.columns, df.sparkSession.createDataFrame([], fold.schema).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shown = None
        waiting: list[dict] = []
        kinds = to_arrow_schema(added)
        for batch in batches:
            made = []
            own = batch.select(names)
            for row, first, starts in zip(own.to_pylist(), batch["__first"].to_pylist(), batch["__begins"].to_pylist(), strict=True):
                if starts:
                    for seen in [] if first else waiting:
                        state = fold.observe(state, seen)
                    waiting = []
                    if first:
                        state = fold.start()
                    shown = fold.emit(state)
                waiting.append(row)
                made.append(shown)
            new = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*names, *kinds.names])

    schema = StructType([*df.schema.fields, *added.fields])
    dealt = marked.repartition(*history.keys).sortWithinPartitions(*history.keys, F.desc("__first"), history.instant, F.desc("__begins"), history.tiebreak)
    return dealt.mapInArrow(rows, schema)


def change_only(df: DataFrame, history: History, value: str, least: float = 1e-9) -> DataFrame:
    """Rows at which ``value`` moved, the first one, and the last one."""
    before, after = F.lag(value).over(history.rows()), F.lead(F.lit(1)).over(history.rows())
    kept = df.withColumn("__keep", before.isNull() | (F.abs(F.col(value) - before) > least) | after.isNull())
    return kept.filter("__keep").drop("__keep")


def resample_last(df: DataFrame, keys: Sequence[str], time: str, value: str, seconds: int, tiebreak: str) -> DataFrame:
    """The last value in each time bucket; empty buckets are left out."""
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.max_by(value, F.struct(time, tiebreak)).alias(value))


def changes(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """First differences, stamped at the later point."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w)).filter(F.col("change").isNotNull())


def islands(df: DataFrame, history: History, state: str) -> DataFrame:
    """A row for each run of equal ``state``: first and last instant and length."""
    rows = history.rows()
    run = F.sum((~F.col(state).eqNullSafe(F.lag(state).over(rows))).cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("run", run).groupBy(*history.keys, "run", state).agg(F.min(history.time).alias("first_at"), F.max(history.time).alias("last_at"), F.count("*").alias("length"))
