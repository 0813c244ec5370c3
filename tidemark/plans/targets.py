"""What a row's own game came to: columns that no model of that game may see."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Outcomes of the row's own game (fixed values); features are made of earlier rows' outcomes instead.
TARGETS = (
    "points_scored", "points_allowed", "point_margin", "won", "pace", "possessions", "offensive_rating", "defensive_rating",
    "efg", "tov_ratio", "oreb_pct", "ftr", "ast_pct", "opp_efg", "opp_tov_pct", "opp_oreb_pct", "opp_ftr",
    "period_1_points", "period_2_points", "period_3_points", "period_4_points", "overtime_points", "clutch_points", "largest_run", "lead_changes", "largest_lead",
)
#: The same under this library's own names.
OWN = ("margin", "tempo", "spread", "blowout_win", "blowout_loss", "close_game", "points", "minutes", "started")


def drop_targets(df: DataFrame, *more: str) -> DataFrame:
    """``df`` without its outcome columns (and ``more``); the guard can't tell them, as their instants are right."""
    return df.drop(*[c for c in df.columns if c in {*TARGETS, *OWN, *more}])
