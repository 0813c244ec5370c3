"""Trades, quotes and what they say: execution summaries, divergences, lead and lag, line-up reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.odds import t_of_mean, t_of_r
from tidemark.operators.relational import ratio


def vwap(df: DataFrame, keys: Sequence[str], price: str, size: str) -> DataFrame:
    w = F.sum(F.col(price) * F.col(size))
    return df.groupBy(*keys).agg(ratio(w, F.sum(size)).alias("vwap"), F.sum(size).alias("volume"), F.count("*").alias("fills"))


def execution_summary(df: DataFrame, keys: Sequence[str], price: str, size: str, is_buy: Column) -> DataFrame:
    """Size-weighted price, effective spread, buy share, imbalance and range of each key's fills.

    The mean price is joined back (a row for each key), not windowed, so a hot key's fills stay spread out.
    """
    means = vwap(df, keys, price, size).select(*keys, "vwap")
    joined = df.join(means, list(keys))
    s, buy = F.col(size), F.sum(F.when(is_buy, F.col(size)).otherwise(0))
    off = F.sum(F.abs(F.col(price) - F.col("vwap")) * s)
    return joined.groupBy(*keys).agg(
        F.max("vwap").alias("vwap"), ratio(2 * off, F.sum(s)).alias("effective_spread"), ratio(buy, F.sum(s)).alias("buy_share"),
        ratio(2 * buy - F.sum(s), F.sum(s)).alias("imbalance"), (F.max(price) - F.min(price)).alias("price_range"), F.count("*").alias("fills"),
    )


def closing_price(fills: DataFrame, keys: Sequence[str], at: str, price: str, cutoff: str, tiebreak: str) -> DataFrame:
    """The last price strictly before the cutoff."""
    return fills.filter(F.col(at) < F.col(cutoff)).groupBy(*keys).agg(F.max_by(price, F.struct(at, tiebreak)).alias("closing_price"))


def last_before(quotes: DataFrame, keys: Sequence[str], at: str, cutoff: str, values: Sequence[str], tiebreak: str) -> DataFrame:
    """Each key's last quote up to the cutoff, itself included."""
    last = F.max_by(F.struct(*values), F.struct(at, tiebreak)).alias("last")
    return quotes.filter(F.col(at) <= F.col(cutoff)).groupBy(*keys).agg(last).select(*keys, "last.*")


def divergences(prices: DataFrame, venue_volume: str, book: str, venue_fair: str, book_implied: str, keys: Sequence[str], least_volume: float = 1000) -> DataFrame:
    """Where the venue's fair price is above the best book's implied one, on venues with enough volume; ties go to the
    smaller book, then to the smaller fair price, and what isn't known comes last."""
    order = F.struct(*[c for n in (book_implied, book, venue_fair) for c in (F.col(n).isNull().alias(f"{n}_unknown"), F.col(n))])
    best = prices.filter(F.col(venue_volume) >= least_volume).groupBy(*keys).agg(F.min_by(F.struct(book, book_implied, venue_fair), order).alias("b"))
    return best.select(*keys, "b.*").withColumn("edge", F.col(venue_fair) - F.col(book_implied)).filter("edge > 0")


def divergence_report(graded: DataFrame, keys: Sequence[str], edge: str, clv: str, survived: str, profit: str, enough: int = 120) -> DataFrame:
    sd, mean, n = F.stddev_samp(clv), F.avg(clv), F.count(clv)
    share = F.avg(F.when(F.col(survived), 1.0).when(~F.col(survived), 0.0))
    return graded.groupBy(*keys).agg(F.count("*").alias("n"), share.alias("survival"), F.avg(edge).alias("mean_edge"), mean.alias("mean_clv"), t_of_mean(mean, sd, n).alias("t_clv"), F.avg(profit).alias("roi"), (F.count("*") >= enough).alias("ready"))


def divergence_summary(observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many were seen, checked, survived, graded and won (``edge``, ``clv``, ``survived``, ``won``)."""
    return observed.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.count("clv").alias("clv_graded"), F.count_if("survived").alias("price_survived"), F.count("survived").alias("survival_checked"),
        F.avg("edge").alias("mean_edge"), F.avg("clv").alias("mean_clv"), F.count_if("won").alias("won"), F.count("won").alias("settled"),
    )


def clv_report(scored: DataFrame, keys: Sequence[str], clv: str, tails: Sequence[float] = (0.01, 0.03, 0.05)) -> DataFrame:
    x = F.col(clv)
    moved = F.sum(F.when(x.isNull(), 1).otherwise(0))
    parts = [F.avg(F.when(x.isNotNull(), (F.abs(x) > t).cast("double"))).alias(f"share_over_{round(t * 100)}pct") for t in tails]
    return scored.groupBy(*keys).agg(F.count(x).alias("scored"), moved.alias("line_moved"), F.avg(x).alias("mean_clv"), F.stddev_samp(x).alias("sd_clv"), F.avg(F.when(x.isNotNull(), (x == 0).cast("double"))).alias("unmoved_share"), *parts)


def cross_correlation(leader: DataFrame, follower: DataFrame, key: str, bucket: str, x: str, y: str, lags: Sequence[int], least: int = 30) -> DataFrame:
    """Pearson's r of leader changes with follower changes ``lag`` buckets later, pooled over keys.

    ``lags`` is short; each leader row meets one follower row for each lag.
    """
    shifted = leader.select(key, bucket, x, F.explode(F.array(*[F.lit(k).cast("long") for k in lags])).alias("lag")).withColumn(bucket, F.col(bucket) + F.col("lag"))
    pairs = shifted.join(follower.select(key, bucket, y), [key, bucket])
    r = F.nanvl(F.corr(x, y), F.lit(None).cast("double"))
    out = pairs.groupBy("lag").agg(F.count("*").alias("n"), r.alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= least, F.col("r"))).withColumn("t", t_of_r(F.col("r"), F.col("n")))


def cluster_bootstrap(pairs: DataFrame, cluster: str, x: str, y: str, resamples: int = 2000, seed: int = 20260803) -> DataFrame:
    """One row: r of all pairs and the share of resamples (of whole clusters) with r <= 0.

    Each cluster is reduced to its sums first.  A resample draws each cluster a Poisson(1) number of times,
    which needs no list of clusters in one place; the draws are an MD5 of seed, resample and cluster.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    sums = pairs.filter(X.isNotNull() & Y.isNotNull()).groupBy(cluster).agg(F.count("*").cast("double").alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(Y * Y).alias("syy"), F.sum(X * Y).alias("sxy"))
    # Sums are few and small, but each makes thousands of draws: as many tasks as a shuffle has, not as few as it has bytes.
    sums = sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), cluster)
    drawn = sums.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples))))
    name = F.concat_ws(":", F.lit(str(seed)), F.col("resample").cast("string"), F.col(cluster).cast("string"))
    # The draw is u = (the first ten digits + 0.5) / 2^40, and hexadecimal digits are in order as texts too.
    u, total, p = F.substring(F.md5(name), 1, 10), 0.0, 0.36787944117144233  # Poisson(1) at 0 (fixed value)
    times = None
    for k in range(11):
        total += p
        under = u <= f"{math.floor(total * (1 << 40) - 0.5):010x}"
        times = F.when(under, k) if times is None else times.when(under, k)
        p /= k + 1
    drawn = drawn.withColumn("times", F.when(F.col("resample") == 0, 1).otherwise(times.otherwise(11)))
    s = {c: F.sum(F.col(c) * F.col("times")) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")}
    by = drawn.groupBy("resample").agg(*[c.alias(k) for k, c in s.items()])
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    by = by.select("resample", F.when(var > 0, cov / F.sqrt(var)).alias("r"))
    real = F.col("resample") > 0
    return by.agg(F.max(F.when(~real, F.col("r"))).alias("r"), F.avg(F.when(real & F.col("r").isNotNull(), (F.col("r") <= 0).cast("double"))).alias("p_not_positive"), F.count(F.when(real, F.col("r"))).alias("resamples"))


def hit_rates(log: DataFrame, key: str, order: Sequence[Column], value: str, line: Column, windows: Sequence[int] = (5, 10, 20), least: int = 4) -> DataFrame:
    """Overs, unders and rate over the newest rows: pushes count for neither, and few decided games have no rate."""
    w = Window.partitionBy(key).orderBy(*order)
    ranked = log.withColumn("__n", F.row_number().over(w)).withColumn("__d", F.sign(F.col(value) - line))
    spans = [(f"last_{n}", F.col("__n") <= n) for n in windows] + [("season", F.lit(True))]
    made = []
    for name, inside in spans:
        over, under = (F.coalesce(F.sum(F.when(inside & (F.col("__d") == s), 1)), F.lit(0)) for s in (1, -1))
        made += [over.alias(f"{name}_over"), under.alias(f"{name}_under"), F.when(over + under >= least, over / (over + under)).alias(f"{name}_rate")]
    return ranked.groupBy(key).agg(*made)


def current_streak(log: DataFrame, key: str, order: Sequence[Column], value: str, line: Column) -> DataFrame:
    """Length of the newest run of overs (positive) or unders (negative); pushes are skipped."""
    w = Window.partitionBy(key).orderBy(*order)
    decided = log.withColumn("__d", F.sign(F.col(value) - line).cast("int")).filter("__d <> 0")
    marked = decided.withColumn("__first", F.first("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__broken", F.max((F.col("__d") != F.col("__first")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("__broken = 0").groupBy(key).agg(F.sum("__d").alias("streak"))


def gap_balance(df: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(gap) > 0).alias("above"), F.count_if(F.col(gap) < 0).alias("below"), F.median(gap).alias("median_gap"))


def group_rank(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Ascending rank in the group (ties by name), the group's mean and size."""
    w = Window.partitionBy(*group)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(value, name)), "group_mean": F.avg(value).over(w), "group_size": F.count("*").over(w)})


def absences(df: DataFrame, keys: Sequence[str], bucket: str, measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, bucket).agg(F.count("*").alias("players"), *[F.round(F.sum(m), 1).alias(m) for m in measures])


def race(standings: DataFrame, group: Sequence[str], team: str, wins: str, losses: str, games: int, places: int) -> DataFrame:
    """Seeds, games behind, magic numbers and whether a place is clinched or out of reach.

    The win total of the contender on the last place is found by rank, not by pairing teams.
    """
    rate = ratio(F.col(wins), F.col(wins) + F.col(losses))
    w = Window.partitionBy(*group)
    out = standings.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("most", F.col(wins) + games - F.col(wins) - F.col(losses))
    out = out.withColumn("seed", F.row_number().over(w.orderBy(F.desc("rate"), F.desc(wins), losses, team)))
    lead = F.first(F.struct(wins, losses)).over(w.orderBy("seed"))
    out = out.withColumn("games_behind", ((lead[wins] - F.col(wins)) + (F.col(losses) - lead[losses])) / 2)
    out = out.withColumn("__n", F.row_number().over(w.orderBy(F.desc("most"), team)))
    # The best total that a rival outside the places can still reach: the places-th of the others.
    edge = F.max(F.when(F.col("__n") == places + 1, F.col("most"))).over(w)
    own = F.max(F.when(F.col("__n") == places, F.col("most"))).over(w)
    rival = F.when(F.col("__n") <= places, edge).otherwise(own)
    held = F.max(F.when(F.col("seed") == places, F.col(wins))).over(w)
    magic = F.greatest(rival + 1 - F.col(wins), F.lit(0))
    return out.withColumns({"magic_number": magic, "clinched": F.coalesce(magic == 0, F.lit(True)), "eliminated": F.coalesce((F.col("seed") > places) & (F.col("most") < held), F.lit(False))}).drop("__n")


def zone_edges(players: DataFrame, defences: DataFrame, league: DataFrame, zone: str, least: int = 15, edge: float = 0.03) -> DataFrame:
    """Zones where a player and the defence met are both above the league's rate; ``*_made`` over ``*_tried``."""
    rate = lambda m, a: F.when(F.col(a) >= least, F.col(m) / F.col(a))
    joined = players.join(defences, ["opponent", zone]).join(league, zone)
    joined = joined.withColumns({"own_edge": rate("player_made", "player_tried") - F.col("league_rate"), "allowed_edge": rate("defence_made", "defence_tried") - F.col("league_rate")})
    return joined.filter((F.col("own_edge") > edge) & (F.col("allowed_edge") > edge)).withColumn("edge_sum", F.col("own_edge") + F.col("allowed_edge"))


def outcome_side(outcome: Column, home: Column, away: Column) -> Column:
    """``home`` or ``away`` if an outcome is that team's name, its first word or its last; null if it is neither's."""
    names = lambda c: F.array(c, F.split_part(c, F.lit(" "), F.lit(1)), F.split_part(c, F.lit(" "), F.lit(-1)))
    return F.when(F.array_contains(names(home), outcome), "home").when(F.array_contains(names(away), outcome), "away")


def home_fills(fills: DataFrame, games: DataFrame) -> DataFrame:
    """Fills (game_id, at, outcome, price, size) of a game's two outcomes as what they say of the home team: a price of
    the other outcome is one less it.  ``games``: game_id, home_name, away_name; other outcomes, and null ones, go."""
    met = fills.join(games.select("game_id", "home_name", "away_name"), "game_id")
    home, away = F.col("outcome") == F.col("home_name"), F.col("outcome") == F.col("away_name")
    return met.filter(home | away).withColumn("home_probability", F.when(home, F.col("price")).otherwise(1 - F.col("price"))).select(*fills.columns, "home_probability")


def game_prices(snapshots: DataFrame, games: DataFrame, winners: Column) -> DataFrame:
    """Snapshots of the games' winner markets with the ``side`` they price.

    ``snapshots``: game_id, outcome, implied_probability and more; ``games``: game_id, home_name, away_name;
    ``winners``: which markets are about the winner.  What prices no side, or nothing, is left out.
    """
    joined = snapshots.filter(F.col("implied_probability").isNotNull() & winners).join(games.select("game_id", "home_name", "away_name"), "game_id")
    sided = joined.withColumn("side", outcome_side(F.col("outcome"), F.col("home_name"), F.col("away_name")))
    return sided.filter("side is not null").select(*snapshots.columns, "side")


def venue_series(prices: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The mean home probability of all prices at each instant; the away side's are turned round."""
    p = F.col("implied_probability")
    return prices.groupBy(*keys, at).agg(F.avg(F.when(F.col("side") == "home", p).otherwise(1 - p)).alias("home_probability"))


def latest_markets(snapshots: DataFrame, starts: DataFrame, now: Column, market: Sequence[str]) -> DataFrame:
    """Each market's newest snapshot up to its game's start, or up to ``now`` where the game isn't known."""
    joined = snapshots.join(starts.select("game_id", "start_time"), "game_id", "left").filter(F.col("captured_at") <= F.coalesce("start_time", now))
    return joined.groupBy(*market).agg(F.max_by(F.struct(*[c for c in snapshots.columns if c not in market]), "captured_at").alias("s")).select(*market, "s.*")


def ranked_gaps(rates: DataFrame, rate: str, price: str, decided: Column, ruled_out: DataFrame, key: str, n: int, least: int = 6, band: tuple[float, float] = (0.03, 0.97)) -> DataFrame:
    """The ``n`` rows whose rate and price differ most; not of keys in ``ruled_out``, nor with a price outside
    ``band`` or few decided games.  Ties go to the smaller key."""
    fair = F.col(rate).isNotNull() & F.col(price).between(*band) & (decided >= least)
    kept = rates.filter(fair).join(ruled_out.select(key), key, "left_anti").withColumn("gap", F.round(F.col(rate) - F.col(price), 3))
    return kept.orderBy(F.desc(F.abs("gap")), key).limit(n)


def confident(candidates: DataFrame, name: str, candidate: str, score: str, least: float = 0.75, margin: float = 0.15) -> DataFrame:
    """(name, candidate, score): the best candidate, where it is good and clearly ahead of the next.

    Two of the same score are never clear; a lone candidate is compared with 0, unscored ones don't count.
    """
    top = candidates.filter(F.col(score).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(score), candidate))).filter("__n <= 2")
    both = top.groupBy(name).agg(F.max(F.when(F.col("__n") == 1, F.struct(candidate, score))).alias("__a"), F.coalesce(F.max(F.when(F.col("__n") == 2, F.col(score))), F.lit(0.0)).alias("__b"))
    return both.filter((F.col(f"__a.{score}") >= least) & (F.col(f"__a.{score}") - F.col("__b") >= margin)).select(name, "__a.*")
