"""Row-local steps: cleaning, flags, encodings, scaling.  Null means not observed and stays null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def flag_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_null": F.col(c).isNull() for c in columns})


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Casts that fail on what can't be cast."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def deduplicate(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """A flag for each category and one for others; a null row has none."""
    made = {f"{column}_is_{c}": F.coalesce(F.col(column) == c, F.lit(False)) for c in categories}
    return df.withColumns({**made, f"{column}_is_other": F.coalesce(~F.col(column).isin(list(categories)), F.lit(False))})


def observed_categories(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column)).distinct().orderBy(column)


def scale(df: DataFrame, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f"{c}_scaled": (F.col(c) - m) / s for c, (m, s) in moments.items()})


def fit_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, fitted on ``df``; 0 where nothing varies.  The fit is one row."""
    fitted = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(fitted))
    made = {f"{c}_scaled": F.when(F.col(c).isNotNull(), F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0)) for c in columns}
    return out.withColumns(made).drop(*fitted.columns)


def home_away(flag: Column) -> Column:
    return F.when(flag, "home").when(~flag, "away")


def outcome(scored: Column, allowed: Column) -> tuple[Column, Column]:
    """Margin and whether it was a win; null if either score is."""
    return scored - allowed, scored > allowed


def margin_profile(margin: Column, blowout: int = 15, close: int = 5) -> dict[str, Column]:
    return {"blowout_win": margin >= blowout, "blowout_loss": margin <= -blowout, "close_game": F.abs(margin) <= close}


def rest_advantage(own: Column, other: Column, own_b2b: Column, other_b2b: Column) -> dict[str, Column]:
    return {"rest_advantage": own - other, "back_to_back_edge": other_b2b.cast("int") - own_b2b.cast("int")}


def pair_profile(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """Mean, least, greatest and absolute gap of a pair; all null if either is."""
    both = a.isNotNull() & b.isNotNull()
    made = {"mean": (a + b) / 2, "min": F.least(a, b), "max": F.greatest(a, b), "gap": F.abs(a - b)}
    return {f"{prefix}_{k}": F.when(both, c) for k, c in made.items()}


def scoring_profile(periods: Sequence[Column], clutch: Column) -> dict[str, Column]:
    """Each period's share of the regulation sum, the second half's, and the clutch share."""
    total = sum(periods[1:], periods[0])
    share = lambda c: F.when(total > 0, c / total)
    half = len(periods) // 2
    return {**{f"period_{i}_share": share(p) for i, p in enumerate(periods, 1)}, "second_half_share": share(sum(periods[half + 1 :], periods[half])), "clutch_share": share(clutch)}


def volatility(run: Column, lead: Column, overtime: Column, changes: Column, points: Column) -> dict[str, Column]:
    return {"run_per_lead": F.when(lead > 0, run / lead), "went_to_overtime": overtime > 0, "lead_changes_per_100": F.when(points > 0, 100 * changes / points)}


def line_edge(line: Column, mean: Column) -> Column:
    return line - mean


def market_divergence(predicted: Column, book: Column, opening: Column) -> dict[str, Column]:
    return {"divergence": predicted - book, "movement": predicted - opening, "abs_divergence": F.abs(predicted - book)}


def style_distance(df: DataFrame, pairs: Sequence[tuple[str, str]], name: str = "style_distance") -> DataFrame:
    """Euclidean distance over pairs of columns scaled by the first one's sample deviation (1 where it can't be
    had), over the dimensions that are known; null if none is."""
    fitted = df.agg(*[F.stddev_samp(a).alias(f"__d{i}") for i, (a, _) in enumerate(pairs)])
    out = df.join(F.broadcast(fitted))
    gaps = [(F.col(a) - F.col(b)) / F.when(F.col(f"__d{i}") > 0, F.col(f"__d{i}")).otherwise(1.0) for i, (a, b) in enumerate(pairs)]
    seen = sum((g.isNotNull().cast("int") for g in gaps), F.lit(0))
    total = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    return out.withColumn(name, F.when(seen > 0, F.sqrt(total))).drop(*fitted.columns)


def style_volatility(pairs: Sequence[tuple[Column, Column, float]]) -> Column:
    """Root mean square of (short - long) / scale over the dimensions that are known."""
    gaps = [(a - b) / s for a, b, s in pairs]
    seen = sum((g.isNotNull().cast("int") for g in gaps), F.lit(0))
    total = sum((F.coalesce(g * g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    return F.when(seen > 0, F.sqrt(total / seen))
