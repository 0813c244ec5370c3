"""Histories of keys that hold a large share of all rows.

A window over a key is one task's work.  Here rows are first placed: ranges of a sort over all tasks, whose counts
give each row its place in its key.  Places are cut into blocks of so many rows, and a block is what a task gets,
with the last rows of the block before it (for bounded windows) or the totals of all blocks before it (for running
ones).  What holds at the first row of an instant is then handed to the other rows of that instant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import materialize

#: Rows of a task's sort, over what an even deal would give it: so many ranges for each shuffle partition.
RANGES = 4
#: Rows that are read at once where blocks are looked at by numpy.
CHUNK = 200_000


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Keys are equal, null to null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _joined(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the other columns of ``small``, which has a row for each of ``keys``."""
    more = [c for c in small.columns if c not in keys]
    return df.alias("l").join(small.alias("r"), same("l", "r", keys), how).select("l.*", *[F.col(f"r.{c}") for c in more])


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """``df`` with, for each of ``counts``, how many rows of the key that are before this one fulfil it.

    Rows are sorted over all tasks by key and ``order``, and written so that the ranges stay; a key in several ranges
    goes on with the counts of those before.
    """
    spark = df.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    marked = df.withColumns({n: c.cast("long") for n, c in counts.items()})
    dealt = materialize(marked.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()), "placed")
    sums = dealt.groupBy(*keys, "__range").agg(*[F.sum(n).alias(f"{n}_") for n in counts])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_") for n in counts])
    own = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = _joined(dealt, starts, [*keys, "__range"], "inner")
    return met.select(*df.columns, *[(F.col(f"{n}_") + F.coalesce(F.sum(n).over(own), F.lit(0))).alias(n) for n in counts])


class Blocks:
    """The rows of ``df`` by blocks of ``rows`` rows of a key (``keys``; ``instant``: the time in whole units)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], instant: Column, tiebreak: str, rows: int):
        self.columns, self.keys, self.rows = df.columns, list(keys), rows
        placed_ = placed(df.withColumn("__at", instant), self.keys, ["__at", tiebreak], {"__rank": F.lit(1)})
        self.df = placed_.withColumn("__block", F.floor(F.col("__rank") / rows))

    def window(self):
        return Window.partitionBy(*self.keys, "__block").orderBy("__rank")

    def bounded(self, n: int, *made: Callable[[Window], Mapping[str, Column]]) -> Blocks:
        """With columns over a window that reaches at most ``n`` rows back: each block has the ``n`` before it.  Of
        several ``made`` the later ones may use what the ones before gave."""
        if n > self.rows:
            raise ValueError(f"a block of {self.rows} rows is too small for a window of {n}")
        here, after = (F.struct((F.col("__block") + k).alias("block"), F.lit(bool(k)).alias("lent")) for k in (0, 1))
        lent = F.when(F.col("__rank") % self.rows >= self.rows - n, F.array(here, after)).otherwise(F.array(here))
        both = self.df.withColumn("__in", F.explode(lent)).withColumn("__block", F.col("__in.block"))
        for columns in made:
            both = both.withColumns(columns(self.window()))
        return self._with(both.filter("not __in.lent").drop("__in"))

    def running(self, cells: Mapping[str, tuple[Callable[[Column], Column], Column]]) -> Blocks:
        """With columns that are an aggregate (sum or max) of a value over all rows of the key before the row."""
        totals = self.df.groupBy(*self.keys, "__block").agg(*[f(x).alias(f"{n}__total") for n, (f, x) in cells.items()])
        before = Window.partitionBy(*self.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(*self.keys, "__block", *[f(F.col(f"{n}__total")).over(before).alias(f"{n}__before") for n, (f, _) in cells.items()])
        own = self.window().rowsBetween(Window.unboundedPreceding, -1)
        both = _joined(self.df.withColumns({n: f(x).over(own) for n, (f, x) in cells.items()}), carried, [*self.keys, "__block"])
        put = {n: F.greatest(n, f"{n}__before") if f is F.max else F.coalesce(F.col(n) + F.col(f"{n}__before"), n, f"{n}__before") for n, (f, _) in cells.items()}
        return self._with(both.withColumns(put).drop(*[f"{n}__before" for n in cells]))

    def handed(self, made: Mapping[str, Column]) -> DataFrame:
        """The rows, each with what ``made`` is at the first row of its instant."""
        peers = Window.partitionBy(*self.keys, "__at").orderBy("__rank")
        packed = self.df.withColumn("__made", F.first(F.struct(*[c.alias(n) for n, c in made.items()])).over(peers))
        return packed.select(*self.columns, *[F.col("__made")[n].alias(n) for n in made])

    def _with(self, df: DataFrame) -> Blocks:
        out = object.__new__(Blocks)
        out.columns, out.keys, out.rows, out.df = self.columns, self.keys, self.rows, df
        return out


# --- running medians -----------------------------------------------------------------------------------


def quantiles(values: np.ndarray, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[start:stop], for many of these at once: a wavelet matrix over the values'
    ranks, gone down bit by bit."""
    order = np.argsort(values, kind="stable")
    level = np.empty(len(values), np.int64)
    level[order] = np.arange(len(values))
    start, stop, k, found = start.copy(), stop.copy(), k.copy(), np.zeros(len(k), np.int64)
    for bit in range(max(1, len(values)).bit_length() - 1, -1, -1):
        ones = (level >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        low, high = zeros[start], zeros[stop]
        left = k < high - low
        start, stop = np.where(left, low, zeros[-1] + start - low), np.where(left, high, zeros[-1] + stop - high)
        k = np.where(left, k, k - (high - low))
        found |= np.where(left, 0, 1 << bit)
        level = np.concatenate([level[ones == 0], level[ones == 1]])
    return values[order[np.minimum(found, len(values) - 1)]]


def block_medians(x: np.ndarray, own: np.ndarray, begins: np.ndarray, known: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The median at each row of some blocks, one after another; NaN where nothing is known yet.

    A block is the values of earlier blocks that its medians can be (``own`` false; ``below``: how many smaller ones
    aren't there), and then its own rows in order; ``known`` is how many values are before a row, looked at where a
    block begins.  A value that isn't known is NaN.
    """
    after = np.concatenate([[True], own[:-1]])
    group = np.cumsum(after & (begins | ~own)) - 1
    there = ~np.isnan(x)
    upto = np.cumsum(there)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    start = (upto - there)[first][group]
    lent = np.bincount(group[~own], minlength=len(first))[group]
    before, smaller = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    before[group[own & begins]] = known[own & begins]
    smaller[group[~own]] = below[~own]
    total = before[group] + (upto - start - lent)
    asked = np.flatnonzero(own & (total > 0))
    out = np.full(len(x), np.nan)
    if len(asked):
        n, less = total[asked], smaller[group][asked]
        low, high = (quantiles(x[there], start[asked], upto[asked], k - less) for k in ((n - 1) // 2, n // 2))
        out[asked] = np.where(low == high, low, (low + high) / 2)
    return out


def _read(df: DataFrame, columns: Sequence[str], name: str, schema) -> DataFrame:
    """``block_medians`` over partitions in which a block's rows follow each other."""

    def medians(table: pa.Table) -> pa.RecordBatch:
        x, own, begins, known, below = (table[c].to_numpy() for c in ("__x", "__own", "__begins", "__known", "__below"))
        made = block_medians(x.astype(float), own, begins, known, below)
        kept = table.select(list(columns)).append_column(name, pa.array(made, pa.float64(), from_pandas=True)).filter(pa.array(own))
        return kept.combine_chunks().to_batches()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            own, begins = table["__own"].to_numpy(), table["__begins"].to_numpy()
            new = np.flatnonzero((begins | ~own)[1:] & own[:-1]) + 1
            if len(new):
                yield from medians(table.slice(0, new[-1]))
                held = table.slice(new[-1]).combine_chunks().to_batches()
                n = sum(b.num_rows for b in held)
        if n:
            yield from medians(pa.Table.from_batches(held))

    return df.mapInArrow(rows, schema)


def running_median(df: DataFrame, keys: Sequence[str], instant: Column, tiebreak: str, value: str, name: str, rows: int) -> DataFrame:
    """The median of all of a key's values up to each row, itself included; nulls and NaN count for nothing.

    A key of up to ``rows`` rows is one block.  A larger key is cut into blocks by time and, in another sort, into
    as many by value; a table of how many values of a time's block lie in a value's block (of a 64th of the key's rows
    at most, as blocks grow with the root of their number) says between which values a block's medians can be, and
    those of earlier blocks go to the block: about four for each row of its own.  So no task holds a key.
    """
    columns, schema = df.columns, df.withColumn(name, F.lit(None).cast("double")).schema
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    marked = df.withColumns({"__x": x, "__at": instant})
    sizes = materialize(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count("__x").alias("__values")).filter(F.col("__n") > rows), "large-keys")
    hot = not sizes.isEmpty()
    cold = marked.alias("l").join(sizes.alias("r"), same("l", "r", keys), "left_anti") if hot else marked
    nothing = F.lit(0).cast("long")
    begins = F.row_number().over(Window.partitionBy(*keys).orderBy("__at", tiebreak)) == 1
    cold = cold.withColumns({"__own": F.lit(True), "__begins": begins, "__known": nothing, "__below": nothing})
    dealt = cold.repartition(*keys).sortWithinPartitions(*keys, F.desc("__begins"), "__at", tiebreak)
    out = _read(dealt, columns, name, schema)
    if not hot:
        return out
    large = _joined(marked, sizes, keys, "inner")
    large = placed(large, keys, ["__at", tiebreak], {"__rank": F.lit(1), "__known": F.col("__x").isNotNull()})
    per = F.greatest(F.lit(rows), F.ceil(8 * F.sqrt("__n")))
    large = materialize(large.withColumn("__per", per).withColumn("__block", F.floor(F.col("__rank") / F.col("__per"))), "large-rows")
    values = large.filter("__x is not null").select(*keys, "__x", "__rank", "__block", "__per", "__n", "__values")
    values = placed(values, keys, ["__x", "__rank"], {"__place": F.lit(1)}).withColumn("__level", F.floor(F.col("__place") / F.col("__per")))
    values = materialize(values.drop("__place", "__rank"), "large-values")
    lent = _lent(values, sizes.withColumn("__per", per), keys)
    own = large.select(*columns, "__x", "__at", "__block", "__rank", F.lit(True).alias("__own"), (F.col("__rank") % F.col("__per") == 0).alias("__begins"), "__known", nothing.alias("__below"))
    lent = lent.select(*keys, "__x", "__block", F.lit(False).alias("__own"), F.lit(False).alias("__begins"), nothing.alias("__known"), "__below")
    both = own.unionByName(lent, allowMissingColumns=True)
    return out.unionByName(_read(both.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", "__own", "__rank"), columns, name, schema))


def _lent(values: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each block the values of earlier blocks among which its medians are, and how many smaller ones there are."""
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(n) / F.col("__per")) - 1, F.lit(0)).cast("long")))
    grid = sizes.select(*keys, "__per", "__values", count("__n").alias("__block")).select(*keys, "__per", "__block", count("__values").alias("__level"))
    cells = values.groupBy(*keys, "__block", "__level").agg(F.count(F.lit(1)).alias("__c"))
    grid = _joined(grid, cells, [*keys, "__block", "__level"])
    earlier = Window.partitionBy(*keys, "__level").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__held", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
    block = Window.partitionBy(*keys, "__block")
    grid = grid.withColumns({"__upto": F.sum("__held").over(block.orderBy("__level")), "__all": F.sum("__held").over(block)})
    middle, reach = F.floor(F.col("__all") / 2), F.floor(F.col("__per") / 2) + 2
    under = F.col("__upto") - F.col("__held")
    chosen = grid.withColumn("__under", under).filter((F.col("__held") > 0) & (F.col("__upto") > middle - reach) & (F.col("__under") <= middle + reach))
    chosen = chosen.select(*keys, "__level", F.col("__block").alias("__to"), F.min("__under").over(block).alias("__below"))
    met = values.alias("l").join(chosen.alias("r"), same("l", "r", [*keys, "__level"]) & (F.col("l.__block") < F.col("r.__to")))
    return met.select(*[F.col(f"l.{k}") for k in keys], "l.__x", F.col("r.__to").alias("__block"), "r.__below")

