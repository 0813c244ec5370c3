"""Streams that keep state for a key: a running consensus, and divergences from find to grade.

Rows come late and out of order.  Each waits in state until the watermark has passed its instant, when a timer fires,
and only then is looked at, instant after instant; so a stream gives the rows that the batch operators give.  State
ends by timers too.  Streams that use it need Spark's RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.divergence import SIDES
from tidemark.streaming.incremental import once  # noqa: F401  redelivered rows go before they reach state


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _implied(odds: int) -> float:
    """A price of American odds (see ``functions.odds``), for single values in state."""
    return 100 / (odds + 100) if odds > 0 else -odds / (-odds + 100)


#: Rows that wait together as one value of the state store.
TOGETHER = 1000
#: What gives a column's values back from texts.
READ = {"string": str, "int": int, "double": float, "boolean": lambda x: x in (True, "true")}
#: Parts that keys are dealt to; each has one state.  A checkpoint can't be gone on with under another number.
PARTS = 4096


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed their instant (``at``, in microseconds), then hands a key's rows of
    each instant to ``seen``, in order.  Rows that are the same are one.

    Each word between Python and the state store is a round trip, so keys (``ident``) share a state in parts: rows wait
    many to a value, and what is known of a part's keys (a dictionary for each, of JSON's kinds, gone once it is empty)
    is read once when a timer fires and written once after it.  Rows come and go as pandas frames, as turning each into
    a ``Row`` costs more than all that is done with it; ``_parted`` makes their columns (of ``schema``) texts, as pandas
    doesn't tell null from NaN.
    """

    def __init__(self, ident: str, schema: str):
        columns = [c.split() for c in schema.split(", ")]
        self.fields = [ident, "at", *[c for c, _ in columns]]
        self.read = [READ[kind] for _, kind in columns]
        self.done: set[tuple] = set()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.known = handle.getValueState("known", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, part = None, []
        for frame in rows:
            cells = list(zip(*[np.atleast_1d(frame[f]).tolist() for f in self.fields], strict=True))
            least = min(map(itemgetter(1), cells))
            first = least if first is None else min(first, least)
            part += cells
            while len(part) >= TOGETHER:
                self.waiting.appendValue((json.dumps(part[:TOGETHER]),))
                part = part[TOGETHER:]
        if part:
            self.waiting.appendValue((json.dumps(part),))
        if first is not None:
            self.handle.registerTimer(math.ceil(first / 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A timer sees to all that the watermark has passed, for those that fire with it too, and sets the next one.
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if (key, until) in self.done:
            return
        self.done.add((key, until))
        due, later = self._waited(until)
        found = self.known.get()
        state = json.loads(found[0]) if found else {"wake": None, "keys": []}
        wake, keys, out = state["wake"], dict(state["keys"]), []
        for ident in [*keys, *[i for i in due if i not in keys]]:
            own = keys.setdefault(ident, {})
            for at, rows in self._instants(due.get(ident, ())):
                out += self.over(ident, at // 1000, own)
                out += self.seen(ident, at, rows, own)
            out += self.over(ident, until, own)
            if not own:
                del keys[ident]
        comes = [math.ceil(min(later, key=itemgetter(1))[1] / 1000)] if later else []
        nearest = min([*comes, *[own["ends"] for own in keys.values() if "ends" in own]], default=None)
        self._set(wake, nearest, until)
        text = json.dumps({"wake": nearest, "keys": list(keys.items())}) if keys or nearest is not None else None
        if text is None and found:
            self.known.clear()
        elif text is not None and (not found or text != found[0]):
            self.known.update((text,))
        if out:
            yield pd.DataFrame(out, columns=out[0].__fields__, dtype=object)

    def _waited(self, until: int) -> tuple[dict[Any, list[list]], list[list]]:
        """Rows by key that the watermark has passed, and the others, which go on waiting."""
        due: dict[Any, list[list]] = {}
        later = []
        for (text,) in self.waiting.get():
            for row in json.loads(text):
                if row[1] > until * 1000:
                    later.append(row)
                elif row[0] in due:
                    due[row[0]].append(row)
                else:
                    due[row[0]] = [row]
        if due and later:
            self.waiting.put([(json.dumps(later[i : i + TOGETHER]),) for i in range(0, len(later), TOGETHER)])
        elif due:
            self.waiting.clear()
        return due, later

    def _instants(self, rows: Sequence[list]) -> Iterator[tuple[int, list[tuple]]]:
        """A key's different rows by instant, in order; those of one instant in the order of how they are written."""
        for at, together in groupby(sorted(rows, key=itemgetter(1)), key=itemgetter(1)):
            cells = [[None if x is None else read(x) for read, x in zip(self.read, row[2:], strict=True)] for row in together]
            yield at, [tuple(row) for row in cells] if len(cells) == 1 else [tuple(row) for _, row in sorted({repr(row): row for row in cells}.items())]

    def _set(self, wake: int | None, nearest: int | None, until: int) -> None:
        """A part has one timer (in milliseconds) for the nearest that comes or ends."""
        if nearest != wake:
            if wake is not None and wake > until:
                self.handle.deleteTimer(wake)
            if nearest is not None:
                self.handle.registerTimer(nearest)

    def seen(self, ident: Any, at: int, rows: list[tuple], state: dict) -> Iterator[Row]:
        yield from ()

    def over(self, ident: Any, until: int, state: dict) -> Iterator[Row]:
        """What ends by an instant (in milliseconds) at which nothing need have come."""
        yield from ()

    def close(self) -> None:
        pass


def _parted(stream: DataFrame, ident: str, schema: str, lateness: str) -> GroupedData:
    """Rows with ``ident``, ``time`` and columns of ``schema``, grouped by parts of keys, for state that those share."""
    # pandas has no instants beyond these; they move the watermark as its own bounds would.
    time = F.greatest(F.least("time", F.lit("2262-01-01").cast("timestamp")), F.lit("1678-01-01").cast("timestamp"))
    texts = [F.col(c).cast(kind).cast("string").alias(c) for c, kind in (c.split() for c in schema.split(", "))]
    told = stream.select(ident, time.alias("time"), _micros(F.col("time")).alias("at"), *texts).filter(F.col(ident).isNotNull() & F.col("at").isNotNull())
    return told.withWatermark("time", lateness).withColumn("__part", F.pmod(F.xxhash64(ident), F.lit(PARTS)).cast("int")).groupBy("__part")


QUOTE = "vendor string, tie double, value double"


class Consensus(InOrder):
    """Every vendor's latest value, and their mean, deviation and number after each instant.  A key that has been
    silent for ``idle`` seconds is forgotten."""

    def __init__(self, idle: int):
        super().__init__("key", QUOTE)
        self.idle = idle

    def seen(self, ident: Any, at: int, rows: list[tuple], state: dict) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for vendor, tie, value in rows:
            if vendor not in newest or (tie is not None and (newest[vendor][0] is None or tie > newest[vendor][0])):
                newest[vendor] = (tie, value)
        latest = dict(state.get("latest", ()))
        for vendor, (_, value) in newest.items():
            if value is not None and value == value:
                latest[vendor] = value
        state.update(latest=list(latest.items()), ends=math.ceil(at / 1000) + self.idle * 1000)
        values = list(latest.values())
        if values:
            mean = math.fsum(values) / len(values)
            spread = math.sqrt(math.fsum((x - mean) ** 2 for x in values) / (len(values) - 1)) if len(values) > 1 else None
            yield Row(key=ident, at=at, consensus=mean, spread=spread, vendors=len(values))

    def over(self, ident: Any, until: int, state: dict) -> Iterator[Row]:
        if state and state["ends"] <= until:
            state.clear()
        yield from ()


def running_consensus(stream: DataFrame, key: str, vendor: str, time: str, value: str, tiebreak: str, lateness: str, idle: int = 7 * 86_400) -> DataFrame:
    """key, at, consensus, spread, vendors: as ``operators.history.running_latest`` gives them, once the watermark has
    passed; rows later than ``lateness`` are lost, as in any stream."""
    told = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(vendor).alias("vendor"), F.col(tiebreak).alias("tie"), F.col(value).alias("value"))
    out = _parted(told, "key", QUOTE, lateness).transformWithStateInPandas(Consensus(idle), "key string, at long, consensus double, spread double, vendors long", "append", "EventTime")
    return out.select(F.col("key").cast(stream.schema[key].dataType).alias(key), F.timestamp_micros("at").alias("at"), "consensus", "spread", "vendors")


# --- divergences ---------------------------------------------------------------------------------------

#: A row of a game: a book's quote, a venue's price (when divergences are looked for), the game's start, its result.
EVENT = "kind string, who string, home int, away int, fair double, volume double, won boolean"
GRADED = "game_id long, venue string, side string, book_vendor string, book_odds int, book_implied double, venue_fair double, edge double, observed_at long, recheck_odds int, survived boolean, closing_odds int, clv double, won boolean"


class Divergences(InOrder):
    """A game's divergences: found at a venue's price against the books' newest quotes, looked at again at the next
    quote, graded with the result; ``patience`` seconds after the start those without one are given as they are."""

    def __init__(self, least_volume: float, patience: int):
        super().__init__("game_id", EVENT)
        self.least_volume, self.patience = least_volume, patience

    def seen(self, ident: Any, at: int, rows: list[tuple], state: dict) -> Iterator[Row]:
        quotes = [(who, home, away) for kind, who, home, away, *_ in rows if kind == "quote"]
        self._recheck(at, quotes, state)
        newest = dict(state.get("quotes", ()))
        for who, *prices in sorted(quotes, key=lambda q: (q[0], q[1] is not None, q[1] or 0, q[2] is not None, q[2] or 0)) if len(quotes) > 1 else quotes:
            newest[who] = prices
        if quotes:
            state["quotes"] = list(newest.items())
        if any(kind == "start" for kind, *_ in rows):
            state.update(start=at, ends=math.ceil(at / 1000) + self.patience * 1000)
        if "start" not in state or at < state["start"]:
            self._close(quotes, state)
        for kind, who, _, _, fair, volume, _ in rows:
            if kind == "venue":
                self._detect(at, who, fair, volume, newest, state)
        for kind, *_, won in rows:
            if kind == "result":
                yield from self._graded(ident, won, state)

    def _recheck(self, at: int, quotes: list[tuple], state: dict) -> None:
        """The first quote of a side at an instant after the one at which it was found."""
        for f in state.get("found", ()) if quotes else ():
            if f["again"] is None and at > f["at"]:
                k = SIDES.index(f["side"]) + 1
                offered = [(q[0], q[k]) for q in quotes if q[k] is not None]
                if offered:
                    f["again"] = min(offered)[1]

    def _close(self, quotes: list[tuple], state: dict) -> None:
        for k, side in enumerate(SIDES, 1):
            offered = [q[k] for q in quotes if q[k] is not None]
            if offered:
                state.setdefault("closing", {})[side] = max(offered)

    def _detect(self, at: int, venue: str, fair: float | None, volume: float | None, books: dict, state: dict) -> None:
        if fair is None or volume is None or volume < self.least_volume:
            return
        for k, side in enumerate(SIDES):
            offered = [(-q[k], v) for v, q in books.items() if q[k] is not None]
            if offered:
                less, vendor = min(offered)
                own = fair if side == "home" else 1 - fair
                edge = own - _implied(-less)
                if edge > 0:
                    state.setdefault("found", []).append({"venue": venue, "side": side, "vendor": vendor, "odds": -less, "fair": own, "edge": edge, "at": at, "again": None})

    def _graded(self, game: int, won: bool | None, state: dict) -> Iterator[Row]:
        closing = state.get("closing", {})
        for f in state.get("found", ()):
            side, again, implied = f["side"], f["again"], _implied(f["odds"])
            close = closing.get(side) if won is not None else None
            known = close is not None
            survived = _implied(again) <= implied if again is not None else None
            yield Row(game_id=game, venue=f["venue"], side=side, book_vendor=f["vendor"], book_odds=f["odds"], book_implied=implied, venue_fair=f["fair"], edge=f["edge"], observed_at=f["at"], recheck_odds=again, survived=survived, closing_odds=close, clv=_implied(close) - implied if known else None, won=won == (side == "home") if known else None)
        state.clear()

    def over(self, ident: Any, until: int, state: dict) -> Iterator[Row]:
        if "start" in state and state["ends"] <= until:
            yield from self._graded(ident, None, state)


def events_of(quotes: DataFrame, venues: DataFrame, games: DataFrame) -> DataFrame:
    """One stream of a game's events (game_id, time and ``EVENT``) out of four kinds of rows, streams or not.

    ``quotes``: game_id, vendor, at, home_odds, away_odds; ``venues``: game_id, venue, at, fair_home, volume;
    ``games``: game_id, start_time, and result_at and home_won of those that are over.
    """
    names = [c.split() for c in EVENT.split(", ")]

    def rows(df: DataFrame, kind: str, time: str, **cells: str) -> DataFrame:
        own = [F.lit(kind).alias("kind")] + [(F.col(cells[n]) if n in cells else F.lit(None)).cast(t).alias(n) for n, t in names if n != "kind"]
        return df.select(F.col("game_id").cast("long").alias("game_id"), F.col(time).cast("timestamp").alias("time"), *own).filter("game_id is not null and time is not null")

    parts = [rows(quotes, "quote", "at", who="vendor", home="home_odds", away="away_odds"), rows(venues, "venue", "at", who="venue", fair="fair_home", volume="volume"), rows(games, "start", "start_time"), rows(games.filter("home_won is not null"), "result", "result_at", won="home_won")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def divergences(events: DataFrame, least_volume: float, lateness: str, patience: int = 86_400) -> DataFrame:
    """``events`` (of ``events_of``) as graded divergences: what ``operators.divergence`` gives for them in batch."""
    out = _parted(events, "game_id", EVENT, lateness).transformWithStateInPandas(Divergences(least_volume, patience), GRADED, "append", "EventTime")
    return out.withColumn("observed_at", F.timestamp_micros("observed_at"))


# --- the freshest quote --------------------------------------------------------------------------------


def freshest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, tiebreak: str, lookback: str, lateness: str) -> DataFrame:
    """``left`` with the newest right value of its keys that is strictly earlier, by ``lookback`` at most, and when it
    was seen; null where there is none.  Both are streams.

    An interval join under both watermarks: a right row is kept until no left row can look back to it.  A left row
    comes out once the slower stream's watermark has passed it by ``lookback``; equal left rows are one.
    """
    ours = left.withWatermark(left_time, lateness).alias("l")
    theirs = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(right_time).alias("__seen"), F.col(value).alias("__value"), F.col(tiebreak).alias("__tie")).withWatermark("__seen", lateness).alias("r")
    near = (F.col("__seen") < F.col(f"l.{left_time}")) & (F.col("__seen") >= F.col(f"l.{left_time}") - F.expr(f"interval {lookback}"))
    for k in keys:
        near = near & (F.col(f"l.{k}") == F.col(f"__{k}"))
    met = ours.join(theirs, near, "leftOuter")
    newest = F.max_by(F.struct(F.col("__value").alias("value"), F.col("__seen").alias("seen")), F.struct("__seen", "__tie")).alias("__n")
    out = met.groupBy(*left.columns).agg(newest)
    return out.select(*left.columns, F.col("__n.value").alias(value), F.col("__n.seen").alias("observed_at"))
