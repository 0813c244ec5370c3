"""Named strategies: pipelines over team games, player games, quotes and fills.

``Tables`` says where rows come from; every strategy is then the same chain of declared steps on any store.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import asof, columns
from tidemark.operators import history as h
from tidemark.plans import pipeline as p

START = "start_time"
TEAM = h.History(("team_id",), START, "game_id")
PLAYER = h.History(("player_id",), START, "game_id")
PAIR = h.History(("team_id", "opponent_team_id"), START, "game_id")
FORM = ("points_scored", "points_allowed", "margin")
STYLE = ("pace", "tempo", "spread")
PLAY_COLUMNS = (*(f"period_{i}_points" for i in (1, 2, 3, 4)), "overtime_points", "clutch_points", "largest_run", "lead_changes", "largest_lead")


@dataclass(frozen=True)
class Tables:
    """Loaders: rows known by the context's instant.  ``quotes``: game_id, vendor, at, price, tie; ``fills``:
    game_id, at, price, tie; ``props``: player_id, at, line, tie; ``bios``: player_id, position, age; ``plays``:
    game_id, team_id and ``PLAY_COLUMNS``; ``standings``: team_id, season, at, wins, losses, tie.  ``style``: the
    dimensions that team games have; ``mix``: whether player games have ``MIX_COLUMNS``; ``tasks``: how many tasks games
    and quotes are dealt to at least."""

    team_games: Callable[[p.Context], DataFrame]
    player_games: Callable[[p.Context], DataFrame] | None = None
    quotes: Callable[[], DataFrame] | None = None
    fills: Callable[[], DataFrame] | None = None
    props: Callable[[], DataFrame] | None = None
    bios: Callable[[], DataFrame] | None = None
    plays: Callable[[], DataFrame] | None = None
    standings: Callable[[], DataFrame] | None = None
    style: tuple[str, ...] = STYLE
    mix: bool = False
    tasks: int | None = None


def past(name: str, who: h.History, change: Callable[[DataFrame], DataFrame], adds: Sequence[str], needs: Sequence[str] = ()) -> p.Step:
    """A windowed step whose window ends at the last earlier instant of ``who``."""
    end = f"{name}_window_end"

    def apply(df: DataFrame) -> DataFrame:
        out = change(df)
        return out if end in out.columns else h.ended(out, who, end)

    return p.windowed(name, apply, [*adds, end], [end], needs)


def pasts(name: str, who: h.History, made: Callable[[], Mapping[str, Sequence[h.Past]]], adds: Sequence[str], ends: Sequence[str], tasks: int | None = None, needs: Sequence[str] = ()) -> p.Step:
    """Windowed columns that are made in one pass: ``made`` has them by name, and each name in ``ends`` gets the last
    earlier instant of ``who`` as its window's end."""
    last = [f"{n}_window_end" for n in ends]

    def apply(df: DataFrame) -> DataFrame:
        return h.together(df, who, [x for parts in made().values() for x in parts], last, tasks)

    return p.windowed(name, apply, [*adds, *last], [*[c for c in adds if c.endswith("_window_end")], *last], needs)


def averaged(name: str, values: Sequence[str]) -> list[str]:
    """The columns of a rolling mean."""
    return [*[f"{v}_{name}" for v in values], f"{name}_rows", f"{name}_window_end"]


def rolling(name: str, who: h.History, values: Sequence[str], n: int) -> p.Step:
    return past(name, who, lambda df: h.rolling(df, who, values, n, name), [*[f"{v}_{name}" for v in values], f"{name}_rows"], values)


def mirror(name: str, made: Sequence[str], ends: Sequence[str], tasks: int | None = None) -> p.Step:
    """The opponent's columns of the same game, with the ends of the windows they come from."""
    told = [*made, *ends]
    return p.windowed(name, lambda df: h.mirror(df, ["game_id"], "team_id", "opponent_team_id", told, tasks=tasks), [f"opponent_{c}" for c in told], [f"opponent_{e}" for e in ends], told)


def row_local(name: str, made: Callable[[], dict], adds: Sequence[str], needs: Sequence[str] = ()) -> p.Step:
    return p.row_local(name, lambda df: df.withColumns(made()), adds, needs)


def _games(t: Tables) -> tuple[p.Step, ...]:
    """A team's games, with what a row alone says."""
    c = F.col
    return (
        p.source("load_team_games", t.team_games, "result_known_at", ("game_id", "team_id", "opponent_team_id", "season", "season_type", START, "result_known_at", "is_franchise", "is_home", "points_scored", "points_allowed", *t.style)),
        row_local("coerce", lambda: {v: c(v).cast("double") for v in t.style}, ()),
        p.keep("franchises", lambda _: c("is_franchise")),
        p.keep("season_types", lambda x: c("season_type").isin(list(x.season_types)) if x.season_types else F.lit(True)),
        p.keep("seasons", lambda x: c("season").isin(list(x.seasons)) if x.seasons else F.lit(True)),
        row_local("home_away", lambda: {"venue": columns.home_away(c("is_home"))}, ["venue"]),
        row_local("outcome", lambda: dict(zip(("margin", "won"), columns.outcome(c("points_scored"), c("points_allowed")), strict=True)), ["margin", "won"]),
    )


REST = ("rest_days", "is_back_to_back")
PRIOR = ("prior_games", "prior_wins", "prior_pct")


def situational_baseline(t: Tables) -> p.Pipeline:
    return p.Pipeline("situational_baseline", (*_games(t), pasts("rest", TEAM, lambda: {"rest": [h.past_rest(TEAM)]}, REST, ["rest"], t.tasks)), START)


def _form(
    t: Tables, name: str, own: Sequence[p.Step] = (), more: Callable[[], Mapping[str, Sequence[h.Past]]] = dict, adds: Sequence[str] = (), ends: Sequence[str] = (), needs: Sequence[str] = (),
    told: Sequence[str] = (), told_ends: Sequence[str] = (), after: Sequence[p.Step] = (),
) -> p.Pipeline:
    """Rest, record and form of both teams, and with them, as all that looks at a team's games is one pass and what a
    game's teams tell each other another: ``own`` steps before that pass, ``more`` of it (``adds``, ``ends``),
    ``told`` beside the form, and steps ``after``.  What is fitted on all rows comes first: what is before it gets
    written, and rows are narrow there."""
    form = [f"{v}_form5" for v in FORM]

    def made() -> Mapping[str, Sequence[h.Past]]:
        return {"season_to_date": [h.past_season(F.col("won"), "season")], "form5": [h.past_rolling(TEAM, FORM, 5, "form5")], "pace5": [h.past_rolling(TEAM, ["pace"], 5, "pace5")], **more()}

    made_here = [*PRIOR, *averaged("form5", FORM), *averaged("pace5", ["pace"]), *adds]
    steps = (
        *situational_baseline(t).steps, p.fitted("scale_rest", lambda df: columns.fit_scale(df, ["rest_days"]), ["rest_days_scaled"]),
        *own, pasts("team_history", TEAM, made, made_here, ["season_to_date", *ends], t.tasks, [*FORM, "pace", *needs]),
        mirror("opponent", [*PRIOR, *form, "pace_pace5", *told], ["season_to_date_window_end", "form5_window_end", "pace5_window_end", *told_ends], t.tasks),
        p.row_local("flag_rest", lambda df: columns.flag_nulls(df, ["rest_days"]), ["rest_days_is_null"]),
        p.row_local("venue_one_hot", lambda df: columns.one_hot(df, "venue", ["home", "away"]), ["venue_is_home", "venue_is_away", "venue_is_other"]),
        p.row_local("season_type_one_hot", lambda df: columns.one_hot(df, "season_type", ["regular-season", "post-season"]), ["season_type_is_regular-season", "season_type_is_post-season", "season_type_is_other"]),
        *after,
    )
    return p.Pipeline(name, steps, START)


def team_form(t: Tables) -> p.Pipeline:
    return _form(t, "team_form")


def team_form_multi(t: Tables) -> p.Pipeline:
    profile = ["blowout_win", "blowout_loss", "close_game"]

    def more() -> Mapping[str, Sequence[h.Past]]:
        return {
            "form10": [h.past_rolling(TEAM, FORM, 10, "form10")], "form20": [h.past_rolling(TEAM, FORM, 20, "form20")], "season_mean": [h.past_expanding(TEAM, FORM, "season", "season_mean")],
            "ewm5": [h.past_exponential("margin", 5.0, 1e-6, "ewm5")], "sd10": [h.past_dispersion("margin", 10, "sd10")], "slope10": [h.past_slope("margin", 10, "slope10")],
            "venue10": h.past_splits(TEAM, "margin", "is_home", 10, {"home10": True, "road10": False}), "streak": [h.past_streak("won", "season", "streak")], "profile10": [h.past_rolling(TEAM, profile, 10, "profile10")],
        }

    adds = [*averaged("form10", FORM), *averaged("form20", FORM), *averaged("season_mean", FORM), "margin_ewm5", "ewm5_rows", "margin_sd10", "margin_slope10", "margin_home10", "home10_rows", "margin_road10", "road10_rows", "streak", *averaged("profile10", profile)]
    own = [row_local("margin_profile", lambda: {k: v.cast("int") for k, v in columns.margin_profile(F.col("margin")).items()}, profile)]
    return _form(t, "team_form_multi", own, more, adds, ["ewm5", "sd10", "slope10", "home10", "road10", "streak"], profile)


def team_matchup(t: Tables) -> p.Pipeline:
    c = F.col
    played = ("games", "wins", "pct", "margin")
    met = pasts(
        "head_to_head", PAIR, lambda: {"h2h_season": [h.past_head_to_head(c("won"), "margin", "h2h_season", "season")], "h2h_all": [h.past_head_to_head(c("won"), "margin", "h2h_all")]},
        [f"{n}_{x}" for n in ("h2h_season", "h2h_all") for x in played], ["h2h_season", "h2h_all"], t.tasks,
    )
    after = (
        row_local("rest_advantage", lambda: columns.rest_advantage(c("rest_days"), c("opponent_rest_days"), c("is_back_to_back"), c("opponent_is_back_to_back")), ["rest_advantage", "back_to_back_edge"]),
        row_local("pace_interaction", lambda: columns.pair_profile(c("pace_pace5"), c("opponent_pace_pace5"), "pace"), ["pace_mean", "pace_min", "pace_max", "pace_gap"]),
    )
    return _form(t, "team_matchup", own=[met], told=REST, told_ends=["rest_window_end"], after=after)


def team_style(t: Tables) -> p.Pipeline:
    """Trailing style vectors of both teams over as many dimensions as there are, their gaps and distance, and how far
    a team's newest games are from its longer run."""
    c, short = F.col, [f"{v}_style5" for v in t.style]
    made = lambda: {"rest": [h.past_rest(TEAM)], "style5": [h.past_rolling(TEAM, t.style, 5, "style5")], "style15": [h.past_rolling(TEAM, t.style, 15, "style15")]}
    steps = (
        *_games(t), pasts("team_history", TEAM, made, [*REST, *averaged("style5", t.style), *averaged("style15", t.style)], ["rest"], t.tasks, t.style), mirror("opponent_style", short, ["style5_window_end"], t.tasks),
        row_local("style_gaps", lambda: {f"{v}_gap": c(f"{v}_style5") - c(f"opponent_{v}_style5") for v in t.style}, [f"{v}_gap" for v in t.style]),
        row_local("style_volatility", lambda: {"style_volatility": columns.style_volatility([(c(f"{v}_style5"), c(f"{v}_style15"), 1.0) for v in t.style])}, ["style_volatility"]),
        p.fitted("style_distance", lambda df: columns.style_distance(df, [(x, f"opponent_{x}") for x in short]), ["style_distance"]),
    )
    return p.Pipeline("team_style", steps, START)


def team_market(t: Tables) -> p.Pipeline:
    """What a game's quotes and fills say before its start is found for the game, of narrow rows, and is looked up last,
    where a game's rows lie together: so it goes through no other shuffle."""
    c, key = F.col, ["game_id"]

    def odds(df: DataFrame) -> DataFrame:
        names = {"consensus": "book_consensus", "spread": "book_spread", "vendors": "book_vendors", "observed_at": "book_observed_at"}
        told = h.latest_at(df, t.quotes(), key, START, "vendor", "at", "price", "tie", t.tasks).withColumnsRenamed(names)
        return asof.told_at(df, told, key, START, list(names.values()))

    def fills(df: DataFrame) -> DataFrame:
        told = asof.last_at(df, t.fills().withColumnRenamed("price", "prediction"), key, START, "at", ["prediction"], "tie", t.tasks).withColumnRenamed("observed_at", "prediction_observed_at")
        return asof.told_at(df, told, key, START, ["prediction", "prediction_observed_at"])

    return _form(t, "team_market", after=(
        p.asof("book", odds, ["book_consensus", "book_spread", "book_vendors", "book_observed_at"], "book_observed_at"),
        p.asof("prediction", fills, ["prediction", "prediction_observed_at"], "prediction_observed_at"),
        row_local("divergence", lambda: columns.market_divergence(c("prediction"), c("book_consensus"), c("book_consensus") - c("book_spread")), ["divergence", "movement", "abs_divergence"]),
    ))


def team_play_shape(t: Tables) -> p.Pipeline:
    """How a team's games ran.  Plays come with the games, as known when those are; games without plays stay."""
    c, key = F.col, ["game_id", "team_id"]
    shares = [f"period_{i}_share" for i in (1, 2, 3, 4)] + ["second_half_share", "clutch_share"]
    swings = ["run_per_lead", "went_to_overtime", "lead_changes_per_100"]
    periods = lambda: [c(f"period_{i}_points") for i in (1, 2, 3, 4)]
    own = (
        p.row_local("no_plays", lambda df: columns.fill_nulls(df, {"overtime_points": 0}), ()),
        row_local("scoring_profile", lambda: columns.scoring_profile(periods(), c("clutch_points")), shares),
        row_local("game_volatility", lambda: {k: v.cast("double") for k, v in columns.volatility(c("largest_run"), c("largest_lead"), c("overtime_points"), c("lead_changes"), c("points_scored") + c("points_allowed")).items()}, swings),
    )
    more = lambda: {"shape10": [h.past_rolling(TEAM, [*shares, *swings], 10, "shape10")], "run_sd10": [h.past_dispersion("run_per_lead", 10, "sd10")]}
    made = _form(t, "team_play_shape", own, more, [*averaged("shape10", [*shares, *swings]), "run_per_lead_sd10"], ["run_sd10"], [*shares, *swings])
    games = made.steps[0]
    load = lambda x: t.team_games(x).join(t.plays().select(*key, *PLAY_COLUMNS), key, "left")
    return made.replace_step(games.name, p.source(games.name, load, "result_known_at", (*games.provenance.adds, *PLAY_COLUMNS)))


def with_standings(made: p.Pipeline, t: Tables) -> p.Pipeline:
    """A team strategy with the record as it was known before each game, from all that was ever captured."""

    def known(df: DataFrame) -> DataFrame:
        out = asof.asof_join(df, t.standings(), ["team_id", "season"], START, "at", ["wins", "losses"], "tie", prefix="standings_")
        total = F.col("standings_wins") + F.col("standings_losses")
        return out.withColumn("standings_pct", F.when(total > 0, F.col("standings_wins") / total))

    return made.with_steps(p.asof("standings", known, ["standings_observed_at", "standings_wins", "standings_losses", "standings_pct"], "standings_observed_at"))


#: What a player's shots and rebounds are made of, and the share of the team's plays that end with the player.
MIX_COLUMNS = ("attempts", "long_attempts", "free_attempts", "rebounds", "offensive_rebounds", "usage")
PLAYER_COLUMNS = ("game_id", "player_id", "team_id", "season", "season_type", START, "result_known_at", "minutes", "points", "starter")


def player_form(t: Tables, least_minutes: float = 10.0) -> p.Pipeline:
    c = F.col
    bios = lambda df: df.join(t.bios(), ["player_id"], "left")
    steps = (
        p.source("load_player_games", t.player_games, "result_known_at", (*PLAYER_COLUMNS, *(MIX_COLUMNS if t.mix else ()))),
        p.keep("season_types", lambda x: c("season_type").isin(list(x.season_types)) if x.season_types else F.lit(True)),
        p.keep("seasons", lambda x: c("season").isin(list(x.seasons)) if x.seasons else F.lit(True)),
        # The team's rest: who sits a game out gains none.
        past("rest", TEAM, lambda df: h.rest(df, TEAM), ["rest_days", "is_back_to_back"]),
        rolling("form5", PLAYER, ["points", "minutes"], 5),
        p.lookup("bio", bios, ["position", "age"], "a player's birth date and position don't depend on results"),
        p.row_local("position_one_hot", lambda df: columns.one_hot(df, "position", ["BUILDING", "MACHINERY"]), ["position_is_BUILDING", "position_is_MACHINERY", "position_is_other"]),
        p.keep("minimum_minutes", lambda _: c("minutes_form5") >= least_minutes),
    )
    return p.Pipeline("player_form", steps, START)


def after_form(made: p.Pipeline, *steps: p.Step) -> p.Pipeline:
    """``steps`` before the minutes filter: no window may miss the rows that it drops."""
    for after, step in zip(("form5", *[x.name for x in steps]), steps, strict=False):
        made = made.insert_after(after, step)
    return made


def _mix() -> list[p.Step]:
    """Shares of sums over ten games, not means of shares: of shots that are long or free, of rebounds that are
    offensive; usage by minutes, and whether it was known."""
    rate = lambda name, num, den: past(name, PLAYER, lambda df: h.rolling_rate(df, PLAYER, num, den, 10, label=name), [name])
    return [
        rate("long_attempts_share", "long_attempts", "attempts"), rate("free_attempts_share", "free_attempts", "attempts"), rate("offensive_rebounds_share", "offensive_rebounds", "rebounds"),
        past("usage_weighted", PLAYER, lambda df: h.rolling_weighted(df, PLAYER, "usage", "minutes", 10, "usage_weighted"), ["usage_weighted"]),
        p.row_local("flag_usage", lambda df: columns.flag_nulls(df, ["usage"]), ["usage_is_null"]),
    ]


def player_rates(t: Tables, least_minutes: float = 5.0) -> p.Pipeline:
    """With the mixes of shots and rebounds and usage, where the player games have them."""
    c = F.col
    made = after_form(
        player_form(t).renamed("player_rates"),
        row_local("starts", lambda: {"started": c("starter").cast("double")}, ["started"]),
        past("per_36", PLAYER, lambda df: h.rolling_rate(df, PLAYER, "points", "minutes", 10, 36.0, "points_per_36"), ["points_per_36"]),
        *(_mix() if t.mix else ()),
        past("weighted", PLAYER, lambda df: h.rolling_weighted(df, PLAYER, "points", "minutes", 10, "points_weighted"), ["points_weighted"]),
        past("share", PLAYER, lambda df: h.rolling_share(df, PLAYER, "minutes", ["team_id", "game_id"], 10, "minutes_share"), ["minutes_share"]),
        rolling("starts10", PLAYER, ["started"], 10),
        p.row_local("flag_rate", lambda df: columns.flag_nulls(df, ["points_per_36"]), ["points_per_36_is_null"]),
    )
    return made.replace_step("minimum_minutes", p.keep("minimum_minutes", lambda _: c("minutes") >= least_minutes))


def player_market(t: Tables) -> p.Pipeline:
    c = F.col
    line = lambda df: asof.asof_join(df, t.props(), ["player_id"], START, "at", ["line"], "tie").withColumnRenamed("observed_at", "line_observed_at")
    return after_form(player_form(t).renamed("player_market"), rolling("form3", PLAYER, ["points"], 3)).with_steps(
        p.asof("prop_line", line, ["line", "line_observed_at"], "line_observed_at"),
        row_local("line_edge", lambda: {"line_edge": columns.line_edge(c("line"), c("points_form5"))}, ["line_edge"]),
    )


STRATEGIES: dict[str, Callable[[Tables], p.Pipeline]] = {
    f.__name__: f for f in (situational_baseline, team_form, team_form_multi, team_matchup, team_style, team_market, team_play_shape, player_form, player_rates, player_market)
}


def build(name: str, tables: Tables) -> p.Pipeline:
    return STRATEGIES[name](tables)
