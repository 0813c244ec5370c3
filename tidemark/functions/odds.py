"""Prices, probabilities and what they are worth: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_implied(odds: Column) -> Column:
    """Zero odds don't exist and fail."""
    checked = F.when(odds == 0, F.raise_error(F.lit("american odds can't be 0"))).otherwise(odds).cast("double")
    return F.when(checked > 0, 100 / (checked + 100)).otherwise(-checked / (-checked + 100))


def american_to_profit(odds: Column) -> Column:
    """Profit on a stake of one."""
    return F.when(odds > 0, odds / 100).otherwise(100 / -odds)


def remove_vig(a: Column, b: Column) -> tuple[Column, Column]:
    """Both sides' shares of their sum."""
    return F.when(a + b > 0, a / (a + b)), F.when(a + b > 0, b / (a + b))


def clv(pick: Column, close: Column, pick_line: Column | None = None, close_line: Column | None = None) -> Column:
    """Closing minus taken implied probability; null when the line itself moved."""
    value = close - pick
    return value if pick_line is None else F.when(pick_line.eqNullSafe(close_line), value)


def home_probability(outcome: Column, home: Column, away: Column, price: Column) -> Column:
    return F.when(outcome == home, price).when(outcome == away, 1 - price)


def implied_price(bid: Column, ask: Column, last: Column) -> Column:
    return F.coalesce((bid + ask) / 2, last)


def t_of_r(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def t_of_mean(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n)))


def minutes(text: Column) -> Column:
    """``MM:SS`` as minutes; anything else is null."""
    good = text.rlike("^[0-9]+:[0-9]{2}$")
    return F.when(good, F.split_part(text, F.lit(":"), F.lit(1)).cast("double") + F.split_part(text, F.lit(":"), F.lit(2)).cast("double") / 60)


def clock_seconds(text: Column) -> Column:
    return F.round(minutes(text) * 60).cast("int")
