"""A key's state is read and written a bounded number of times, however many rows it has."""

from types import SimpleNamespace
from unittest.mock import MagicMock

import pandas as pd
from pyspark.sql import Row

from tidemark.streaming import stateful as st


class Store:
    """List, map and value states of one key; every word with them is counted."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def __getattr__(self, kind):
        if kind in ("registerTimer", "deleteTimer"):
            return self.counted(lambda *a: None)
        return lambda name, *schemas: self.state(name, kind)

    def counted(self, f):
        def call(*a):
            self.calls += 1
            return f(*a)

        return call

    def state(self, name, kind):
        at = self.held.setdefault(name, {} if kind == "getMapState" else [])
        put = lambda rows: at.__setitem__(slice(None), rows)
        if kind == "getMapState":
            does = {"updateValue": at.__setitem__, "removeKey": at.pop, "iterator": lambda: list(at.items()), "values": lambda: list(at.values()), "exists": lambda: bool(at)}
        elif kind == "getListState":
            does = {"appendValue": at.append, "get": lambda: iter(list(at)), "put": put, "exists": lambda: bool(at)}
        else:
            does = {"update": lambda v: put([v]), "get": lambda: at[0] if at else None, "exists": lambda: bool(at)}
        return MagicMock(**{n: self.counted(f) for n, f in {**does, "clear": at.clear}.items()})


def calls(processor, rows, key):
    store = Store()
    processor.init(store)
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
    list(processor.handleInputRows(key, iter(rows), watermark))
    out = list(processor.handleExpiredTimer(key, watermark, SimpleNamespace(getExpiryTimeInMs=lambda: 1)))
    assert out
    return store.calls


def test_calls_do_not_grow_with_rows():
    quotes = [Row(key=1, at=i * 1000, vendor=f"v{i % 3}", tie=1.0, value=float(i)) for i in range(200)]
    few, many = (calls(st.Consensus(60), quotes[:n], (1,)) for n in (5, 200))
    assert few == many <= 8
    made = [Row(game_id=1, at=i * 1000, kind="quote", who=f"v{i % 3}", home=150, away=-150, fair=None, volume=None, won=None) for i in range(200)]
    end = [Row(game_id=1, at=i * 1000, kind=k, who="pm", home=None, away=None, fair=0.9, volume=10.0, won=True) for i, k in ((300, "venue"), (301, "start"), (302, "result"))]
    few, many = (calls(st.Divergences(1, 60), made[:n] + end, (1,)) for n in (5, 200))
    assert few == many <= 8


def games(n):
    """Frames of ``n`` games' rows as a stream hands them over: columns are texts."""
    kinds = [("quote", "v", "150", "-170", None, None, None), ("venue", "pm", None, None, "0.9", "10.0", None), ("venue", "nan", None, None, "0.9", "NaN", None), ("venue", "null", None, None, "0.9", None, None), ("start", None, None, None, None, None, None), ("result", None, None, None, None, None, "true")]
    rows = [(g, 10**6 * (g + i), *k) for i, k in enumerate(kinds) for g in range(n)]
    return pd.DataFrame(rows, columns=["game_id", "at", "kind", "who", "home", "away", "fair", "volume", "won"])


def test_calls_do_not_grow_with_the_keys_of_a_part():
    made = {n: st.Divergences(1, 60) for n in (5, 100)}
    few, many = (calls(p, [games(n)], (7,)) for n, p in made.items())
    assert few == many <= 8


def test_keys_of_a_part_have_their_own_state():
    store, processor = Store(), st.Divergences(1, 60)
    processor.init(store)
    instant = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    list(processor.handleInputRows((7,), iter([games(9)]), instant(0)))
    found = []
    for ms in (2_500, 7_200, 60_000):  # some games are over, some begun, some to come
        found += list(processor.handleExpiredTimer((7,), instant(ms), SimpleNamespace(getExpiryTimeInMs=lambda: 1)))
        found += list(processor.handleExpiredTimer((7,), instant(ms), SimpleNamespace(getExpiryTimeInMs=lambda: 1)))  # fires with it
    out = pd.concat(found)
    # NaN is above every least volume, as in batch; null isn't.
    assert sorted(zip(out["game_id"], out["venue"], out["side"], out["won"], strict=True)) == [(g, v, "home", True) for g in range(9) for v in ("nan", "pm")]
    assert not any(store.held.values())
